"""Tables as files with a log of numbered commits, and keyed tables whose changes cost what they touch."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .tables import join_null_safe, upsert


class ConcurrentCommit(RuntimeError):
    """Another writer made the commit that this one was about to make."""


class Folder:
    """The few file operations that a commit needs, on any path that Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        path = self._hadoop.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self._conf)

    def names(self, name: str) -> list[str]:
        path, files = self._at(name)
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def text(self, name: str) -> str:
        return self.spark.read.text(f"{self.root}/{name}", wholetext=True).first()[0]

    def create(self, name: str, text: str) -> bool:
        """Makes a file with the whole text or, if it is there already, nothing: written aside and renamed without overwriting."""
        aside, files = self._at(f"{name}.{uuid.uuid4().hex}.tmp")
        out = files.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        path, _ = self._at(name)
        options = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            self._hadoop.FileContext.getFileContext(aside.toUri(), self._conf).rename(aside, path, options)
        except Exception as e:
            files.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        path, files = self._at(name)
        files.delete(path, True)


class CommitLog:
    """Numbered manifests under ``root``/log. A commit is one new file, so a table is as before it or as after it.

    ``txn`` holds the last batch number of every stream that has committed, so a batch
    that is run again can tell that it was there.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.folder = Folder(spark, root)

    def last(self) -> tuple[int, dict]:
        """The highest commit and its manifest; (0, {}) before the first."""
        numbers = [n for n in self.folder.names("log") if n.endswith(".json")]
        return (int(numbers[-1][:-5]), json.loads(self.folder.text(f"log/{numbers[-1]}"))) if numbers else (0, {})

    def commit(self, number: int, manifest: dict) -> None:
        if not self.folder.create(f"log/{number:012d}.json", json.dumps(manifest)):
            raise ConcurrentCommit(f"commit {number} of {self.folder.root} was made by another writer")

    def trim(self, keep: int) -> list[dict]:
        """Drops all but the newest ``keep`` manifests and returns those."""
        numbers = [n for n in self.folder.names("log") if n.endswith(".json")]
        for n in numbers[:-keep]:
            self.folder.delete(f"log/{n}")
        return [json.loads(self.folder.text(f"log/{n}")) for n in numbers[-keep:]]


def is_done(manifest: dict, txn: tuple[str, int] | None) -> bool:
    return txn is not None and manifest.get("txn", {}).get(txn[0], -1) >= txn[1]


def with_txn(manifest: dict, txn: tuple[str, int] | None) -> dict:
    return manifest | {"txn": manifest.get("txn", {}) | ({txn[0]: txn[1]} if txn else {})}


def write_snapshot(df: DataFrame, root: str, txn: tuple[str, int] | None = None) -> str:
    """Writes a whole new version of a table and commits it; with a ``txn`` (stream, batch) that is committed already, nothing."""
    log = CommitLog(df.sparkSession, root)
    number, manifest = log.last()
    if is_done(manifest, txn):
        return manifest["data"]
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{log.folder.root}/{version}")
    log.commit(number + 1, with_txn(manifest, txn) | {"data": version})
    return version


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    log = CommitLog(spark, root)
    return spark.read.parquet(f"{log.folder.root}/{log.last()[1]['data']}")


class KeyedStore:
    """A table in hashed buckets by key, changed by deltas that replace all rows of a key.

    Base files and deltas lie under ``root``/data/commit=<id>/bucket=<n>. A delta holds
    the new rows of the keys it touches and a mark for each of them, so a key's rows are
    those of the last delta with its mark, else the base's. A change reads and writes
    the buckets of its keys only; reading the table merges only buckets that have
    deltas; ``compact`` rewrites buckets that have many. Null is a key like any other.
    One writer at a time: a commit that another one made first raises ConcurrentCommit.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.log = spark, CommitLog(spark, root)
        self.number, self.manifest = self.log.last()
        if not self.number:
            raise FileNotFoundError(f"no table at {root}")
        self.schema = StructType.fromJson(self.manifest["schema"])
        self.keys: list[str] = self.manifest["keys"]

    @classmethod
    def create(cls, rows: DataFrame, root: str, keys: list[str], buckets: int = 64) -> KeyedStore:
        """A new table with these rows; ``keys`` needn't be unique."""
        log = CommitLog(rows.sparkSession, root)
        schema = StructType([StructField(f.name, f.dataType, True) for f in rows.schema])
        manifest = {"schema": schema.jsonValue(), "keys": keys, "buckets": buckets, "files": {}, "txn": {}}
        store = cls.__new__(cls)
        store.spark, store.log, store.number, store.manifest, store.schema, store.keys = rows.sparkSession, log, 0, manifest, schema, keys
        files = store._write(rows.withColumn("_mark", F.lit(False)), base=True, version=0)
        log.commit(1, manifest | {"files": files})
        return cls(rows.sparkSession, root)

    def refresh(self) -> None:
        self.number, self.manifest = self.log.last()

    def done(self, txn: tuple[str, int]) -> bool:
        """Whether the table holds this batch of the stream."""
        return is_done(self.manifest, txn)

    def _bucket(self, rows: DataFrame) -> Column:
        own = [F.col(k).cast(self.schema[k].dataType) for k in self.keys]
        return F.pmod(F.xxhash64(*own), F.lit(self.manifest["buckets"])).cast("int")

    def _write(self, rows: DataFrame, base: bool, version: int) -> dict:
        commit = uuid.uuid4().hex
        own = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema], "_mark")
        own.withColumn("bucket", self._bucket(own)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.log.folder.root}/data/commit={commit}")
        buckets = [int(n[7:]) for n in self.log.folder.names(f"data/commit={commit}") if n.startswith("bucket=")]
        return {commit: {"version": version, "base": base, "buckets": buckets}}

    def _files(self, wanted: Iterable[int] | None, base: bool, merged: set[int] | None = None) -> list[tuple[str, int]]:
        """(commit, bucket) of base files or deltas in the wanted buckets; ``merged`` leaves out those buckets."""
        own = None if wanted is None else set(wanted)
        return [(c, b) for c, f in self.manifest["files"].items() if f["base"] == base for b in f["buckets"] if (own is None or b in own) and b not in (merged or ())]

    def _load(self, files: list[tuple[str, int]]) -> DataFrame:
        schema = StructType([*self.schema, StructField("_mark", BooleanType())])
        if not files:
            return self.spark.createDataFrame([], schema).withColumns({"commit": F.lit(""), "bucket": F.lit(0)})
        top = f"{self.log.folder.root}/data"
        return self.spark.read.schema(schema.add("commit", "string").add("bucket", "integer")).option("basePath", top).parquet(*[f"{top}/commit={c}/bucket={b}" for c, b in files])

    def read(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """The table, or the part of it in some buckets."""
        names = [f.name for f in self.schema]
        buckets = None if buckets is None else list(buckets)
        deltas = self._files(buckets, base=False)
        changed = {b for _, b in deltas}
        plain = self._load(self._files(buckets, base=True, merged=changed)).select(*names)
        if not deltas:
            return plain
        versions = F.create_map(*[F.lit(x) for c, f in self.manifest["files"].items() for x in (c, f["version"])])
        rows = self._load([*self._files(changed, base=True), *deltas]).withColumn("_version", versions[F.col("commit")])
        last = rows.where("_mark").groupBy(*self.keys).agg(F.max("_version").alias("_last"))
        live = join_null_safe(rows.where("NOT _mark"), last, self.keys, "left").where("_last IS NULL OR _version = _last")
        return plain.unionByName(live.select(*names))

    def matching(self, keys: DataFrame) -> DataFrame:
        """The rows with one of these keys; reads their buckets only (at most all of them come to the driver as numbers)."""
        wanted = keys.select(*self.keys).distinct()
        numbers = [r[0] for r in wanted.select(self._bucket(wanted)).distinct().collect()]
        rows = self.read(numbers)
        return join_null_safe(rows, wanted.withColumn("_wanted", F.lit(True)), self.keys, "inner").select(*[f.name for f in self.schema])

    def replace(self, rows: DataFrame, touched: DataFrame, txn: tuple[str, int] | None = None) -> bool:
        """Makes ``rows`` all the rows of the ``touched`` keys; keys without rows are gone. False if the batch ``txn`` is there already.

        Data is written first and counts with the commit only, so a run that ends in between changes nothing.
        """
        if is_done(self.manifest, txn):
            return False
        marks = touched.select(*self.keys).distinct().withColumn("_mark", F.lit(True))
        both = rows.select(*[f.name for f in self.schema]).withColumn("_mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
        files = self._write(both, base=False, version=self.number + 1)
        self._commit(with_txn(self.manifest, txn) | {"files": self.manifest["files"] | files})
        return True

    def mark(self, txn: tuple[str, int]) -> None:
        """Commits that a batch which changes nothing is done."""
        if not is_done(self.manifest, txn):
            self._commit(with_txn(self.manifest, txn))

    def upsert(self, source: DataFrame, set_cols: list[str], seq: list[str], defaults: dict[str, Column] | None = None, txn: tuple[str, int] | None = None) -> bool:
        """``tables.upsert`` by the table's keys, at the cost of the source's buckets."""
        if is_done(self.manifest, txn):
            return False
        return self.replace(upsert(self.matching(source), source, self.keys, set_cols, seq, defaults), source, txn)

    def compact(self, most: int = 8) -> int:
        """Merges the buckets that have ``most`` deltas or more into new base files; returns how many."""
        count: dict[int, int] = {}
        for _, b in self._files(None, base=False):
            count[b] = count.get(b, 0) + 1
        full = sorted(b for b, n in count.items() if n >= most)
        if full:
            files = self._write(self.read(full).withColumn("_mark", F.lit(False)), base=True, version=self.number)
            left = {c: f | {"buckets": [b for b in f["buckets"] if b not in full]} for c, f in self.manifest["files"].items()}
            self._commit(self.manifest | {"files": {c: f for c, f in left.items() if f["buckets"]} | files})
        return len(full)

    def _commit(self, manifest: dict) -> None:
        self.log.commit(self.number + 1, manifest)
        self.number, self.manifest = self.number + 1, manifest

    def vacuum(self, keep: int = 10) -> None:
        """Drops old manifests, and data that none of the newest ``keep`` names. Not while a writer is at work."""
        used = {c for m in self.log.trim(keep) for c in m["files"]}
        for name in self.log.folder.names("data"):
            if name.startswith("commit=") and name[7:] not in used:
                self.log.folder.delete(f"data/{name}")
