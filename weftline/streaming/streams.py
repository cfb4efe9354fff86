"""Structured Streaming forms of change application, newest-wins state and incremental ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators import works
from ..operators.graph import saved
from ..operators.store import KeyedStore

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def deduplicated(changes: DataFrame, keys: list[str], ts: str = "ts", late: str = "72 hours") -> DataFrame:
    """Changes once each, though the feed is read again with an overlap; later than ``late`` they are dropped."""
    return changes.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def apply_stream(changes: DataFrame, store: KeyedStore, apply: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str, keys: list[str], ts: str = "ts", late: str = "72 hours") -> StreamingQuery:
    """Applies every batch of changes to a keyed store with a batch operator ``apply(rows, batch)``.

    The operator gets the store's rows of the keys that the batch names, and returns what
    they are to be; nothing else is read or written. The commit carries the stream's
    batch number, so a batch that is run again after a failure is skipped if it was
    committed and applied if it wasn't.
    """

    def step(batch: DataFrame, number: int) -> None:
        if store.done((checkpoint, number)):
            batch.write.format("noop").mode("overwrite").save()  # the stream's own state still has to take the batch in
            return
        batch = batch.persist()
        try:
            touched = batch.select(*store.keys).distinct()
            if touched.isEmpty():
                store.mark((checkpoint, number))
                return
            store.replace(apply(store.matching(touched), batch), touched, (checkpoint, number))
            store.compact()
        finally:
            batch.unpersist()

    rows = deduplicated(changes, keys, ts, late)
    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Newest(StatefulProcessor):
    """The rows of a key that can still hold it: the last undated row and those after it that no later row outdates."""

    def __init__(self, schema: StructType, date: str, seq: str) -> None:
        self.schema, self.date, self.seq = schema, date, seq

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", self.schema)

    def _keep(self, rows: list[Row]) -> list[Row]:
        """From the last row backwards only rows with a later date than all behind them can win, and none before an undated one."""
        left: list[Row] = []
        for row in sorted(rows, key=lambda r: r[self.seq], reverse=True):
            if row[self.date] is None:
                left.append(row)
                break
            if not left or row[self.date] > left[-1][self.date]:
                left.append(row)
        return left

    def _held(self) -> list[Row]:
        names = self.schema.names
        return [Row(**dict(zip(names, r))) for r in self.rows.get()] if self.rows.exists() else []

    def _put(self, rows: list[Row]) -> None:
        self.rows.put([tuple(r[c] for c in self.schema.names) for r in rows])

    def handleInitialState(self, key: object, initialState: Row, timerValues: object) -> None:
        self._put(self._keep([*self._held(), initialState]))

    def handleInputRows(self, key: object, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        left = self._keep([*self._held(), *rows])
        self._put(left)
        # of dated rows the one with the latest date stands last but for the undated one
        dated = [r for r in left if r[self.date] is not None]
        best = (dated or left)[-1]
        yield Row(**{c: best[c] for c in self.schema.names})

    def close(self) -> None:
        pass


def newest_wins_stream(rows: DataFrame, keys: list[str], date: str, seq: str, stored: DataFrame | None = None) -> DataFrame:
    """Of a stream of rows, after each batch the whole row that holds for every key it touched; see ``works.newest_wins``.

    The state starts from the rows of a ``stored`` table with the same columns, whose
    ``seq`` is below all others, and holds the whole rows that could still win: the last
    undated one and those later in date than all that follow them, a few where dates rise
    with seq. Rows out of order are weighed by their seq, so the outcome doesn't depend
    on arrival; of rows with the same seq the one that came first counts. Keys are never
    dropped; nulls are keys like any other. Needs the RocksDB state store; the state can
    be read back as a table with the ``statestore`` source (stateVarName "rows").
    """
    first = None if stored is None else stored.select(*rows.columns).groupBy(*keys)
    return rows.groupBy(*keys).transformWithState(_Newest(rows.schema, date, seq), outputStructType=rows.schema, outputMode="Update", timeMode="None", initialState=first)


def newest_wins_table(rows: DataFrame, store: KeyedStore, date: str, seq: str, checkpoint: str) -> StreamingQuery:
    """Keeps in a keyed store the whole rows that could still win by ``works.newest_wins``, of a stream and of what the store held before.

    The outcome is that of ``newest_wins_stream``, without Python in the way of the rows: a batch reads and
    writes the buckets of its keys. Of rows with the same seq the one that was held counts. A
    batch that is run again after a failure is skipped if it was committed.
    """

    def step(batch: DataFrame, number: int) -> None:
        txn = (checkpoint, number)
        if store.done(txn):
            return
        touched = saved(batch.select(*store.keys).distinct())
        both = store.matching(touched).withColumn("_come", F.lit(0)).unionByName(batch.withColumn("_come", F.lit(1)))
        store.replace(works.contenders(both, store.keys, date, seq, "_come"), touched, txn)
        store.compact()

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Words of 64 bits in a block of the filter; a url sets one bit in each.
_WORDS = 8


def _bits(url: Column, blocks: int) -> dict[str, Column]:
    """The url's block, and the bit it sets in each word of it."""
    h = F.xxhash64(url, F.lit(1))
    return {"block": F.pmod(F.xxhash64(url), F.lit(blocks)).cast("int")} | {f"m{i}": F.call_function("shiftleft", F.lit(1).cast("long"), (F.shiftrightunsigned(h, 6 * i) % 64).cast("int")) for i in range(_WORDS)}


class KnownUrls:
    """The urls seen so far, with a blocked Bloom filter in front of them; both are keyed stores.

    A url falls into one block of 512 bits and sets one bit in each of its eight words, so
    that a batch reads the blocks of its urls only. Urls that the filter doesn't know are
    new; the others are looked up in the buckets of the known ones. The filter is merged
    before the urls are committed, so it never misses one. About 16 bits a url (``blocks``
    times 512 bits for all of them) leave one in a thousand to be looked up for nothing.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.urls, self.filter = KeyedStore(spark, f"{root}/urls"), KeyedStore(spark, f"{root}/filter")
        self.blocks = self.filter.manifest["blocks"]

    @classmethod
    def create(cls, urls: DataFrame, root: str, blocks: int = 1 << 16, buckets: int = 64) -> KnownUrls:
        spark = urls.sparkSession
        known = urls.where("url IS NOT NULL").select("url").distinct()
        filled = KeyedStore.create(_merged(known, blocks), f"{root}/filter", ["block"], buckets)
        filled._commit(filled.manifest | {"blocks": blocks})
        KeyedStore.create(known, f"{root}/urls", ["url"], buckets)
        return cls(spark, root)

    def maybe_known(self, urls: DataFrame) -> DataFrame:
        """(url, hit): distinct urls; without a hit a url is surely new."""
        asked = urls.where("url IS NOT NULL").select("url").distinct().withColumns(_bits(F.col("url"), self.blocks))
        held = self.filter.matching(asked)
        hit = F.lit(True)
        for i in range(_WORDS):
            hit = hit & (F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}"))
        return asked.join(held, "block", "left").select("url", F.coalesce(hit, F.lit(False)).alias("hit"))

    def add(self, urls: DataFrame, txn: tuple[str, int], sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
        """The urls that weren't known, which now are; ``sink`` gets them, with the batch's number, before they are committed.

        A batch that was committed before adds and tells nothing; one that failed before its
        commit is told again in full.
        """
        if self.urls.done(txn):
            return urls.sparkSession.createDataFrame([], "url string")
        asked = saved(self.maybe_known(urls))
        hits = asked.where("hit").select("url")
        fresh = saved(asked.where("NOT hit").select("url").union(hits.join(self.urls.matching(hits), "url", "left_anti")))
        new = _merged(fresh, self.blocks)
        both = self.filter.matching(new).unionByName(new).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(_WORDS)])
        self.filter.replace(both, new, txn)
        self.filter.compact()
        if sink:
            sink(fresh, txn[1])
        self.urls.replace(fresh, fresh, txn)
        self.urls.compact()
        return fresh


def _merged(urls: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7) of the blocks that the urls fall into."""
    return urls.withColumns(_bits(F.col("url"), blocks)).groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(_WORDS)])


def new_urls(urls: DataFrame, known: KnownUrls, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Passes on the urls of a stream that aren't known yet, with the number of their batch; they are known from then on.

    A batch that failed on the way is passed on again under the same number.
    """

    def step(batch: DataFrame, number: int) -> None:
        known.add(batch.select("url"), (checkpoint, number), sink)

    return urls.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_counts(changes: DataFrame, ts: str = "ts", late: str = "72 hours") -> DataFrame:
    """Changes per kind and hour, in append mode behind a watermark."""
    return changes.withWatermark(ts, late).groupBy(F.window(ts, "1 hour").alias("hour"), "kind").agg(F.count("*").alias("n"))
