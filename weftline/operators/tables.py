"""Keyed tables: null-safe upsert, run logs, the availability export."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .graph import saved


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join on keys in which null equals null; the right side's keys are then called ``_right_<key>``."""
    on = F.lit(True)
    for k in keys:
        right = right.withColumnRenamed(k, f"_right_{k}")
        on = on & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(right, on, how)


def last_per_key(rows: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """The row with the highest ``seq`` of every key; nulls are keys like any other."""
    rest = [c for c in rows.columns if c not in keys]
    found = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*seq)).alias("_row"))
    return found.select(*keys, "_row.*").select(*rows.columns)


def upsert(target: DataFrame, source: DataFrame, keys: list[str], set_cols: list[str], seq: list[str], defaults: dict[str, Column] | None = None) -> DataFrame:
    """Update or create by key: the last source row of a key overwrites ``set_cols`` (nulls too) or is inserted.

    Other columns of an updated row stay, those of a new row come from ``defaults`` or
    are null. Key parts that are null match null.
    """
    defaults = defaults or {}
    new = last_per_key(source.select(*dict.fromkeys([*keys, *set_cols, *seq])), keys, seq)
    new = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in set_cols], F.lit(True).alias("_new"))
    both = join_null_safe(target.withColumn("_old", F.lit(True)), new, keys, "full")
    out = []
    for c in target.columns:
        kind = target.schema[c].dataType
        if c in keys:
            value = F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_right_{c}"))
        elif c in set_cols:
            value = F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(F.col(c))
        else:
            value = F.when(F.col("_old"), F.col(c)).otherwise(defaults.get(c, F.lit(None)))
        out.append(value.cast(kind).alias(c))
    return both.select(*out)


def seed_dimension(dim: DataFrame, payload: DataFrame, key: str, name: str, set_cols: list[str], seq: list[str]) -> DataFrame:
    """Adds the payload's missing dimension rows and refreshes those that are there; the first payload of a key counts.

    A missing name falls back to the key; payload rows without a key are skipped.
    """
    rows = payload.where(F.col(key).isNotNull())
    first = rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in set_cols]), F.struct(*seq)).alias("_row")).select(key, "_row.*")
    first = first.withColumn(name, F.coalesce(F.nullif(F.col(name), F.lit("")), F.col(key).cast("string")))
    return upsert(dim, first.withColumn("_seq", F.lit(0)), [key], set_cols, ["_seq"])


LOG_TYPE = "id long, sync_type string, started_at timestamp, completed_at timestamp, status string, api_calls_used long, titles_processed long, last_cursor string, error_message string, metadata string"


def append_run(spark: SparkSession, root: str, **run) -> None:
    """Appends one run to the log; its id follows the highest one there."""
    names = [f.split()[0] for f in LOG_TYPE.split(", ")]
    try:
        top = spark.read.schema(LOG_TYPE).parquet(root).agg(F.max("id")).first()[0] or 0
    except Exception as e:  # the log's first run
        if "PATH_NOT_FOUND" not in str(e):
            raise
        top = 0
    if isinstance(run.get("metadata"), dict):
        run["metadata"] = json.dumps(run["metadata"], sort_keys=True)
    row = tuple((run | {"id": top + 1}).get(n) for n in names)
    spark.createDataFrame([row], LOG_TYPE).coalesce(1).write.mode("append").parquet(root)


def run_logged(spark: SparkSession, log: str, sync_type: str, outputs: dict[str, tuple[DataFrame, str]], counters: dict[str, dict[str, Column]], processed: str | None = None, **run) -> dict[str, dict[str, int]]:
    """Writes the outputs (name: frame and path) and appends the run to the log with what they held, counted while they were written.

    ``counters`` has aggregates by output and name; they are observed on the way to the
    file, so they cost no pass of their own and count the rows that were written. The
    row's metadata is their JSON by output; ``processed`` names the output whose ``rows``
    counter is titles_processed. A failure is logged with its message and raised again.
    """
    started, counts = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None), {}
    now = lambda: datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    try:
        for name, (df, path) in outputs.items():
            seen = Observation(name)
            own = {"rows": F.count(F.lit(1)), **counters.get(name, {})}
            df.observe(seen, *[c.alias(n) for n, c in own.items()]).write.mode("append").parquet(path)
            counts[name] = dict(seen.get)
    except Exception as e:
        append_run(spark, log, sync_type=sync_type, started_at=started, completed_at=now(), status="failed", error_message=str(e)[:1000], metadata=counts, **run)
        raise
    done = counts[processed]["rows"] if processed else None
    append_run(spark, log, sync_type=sync_type, started_at=started, completed_at=now(), status="completed", titles_processed=done, metadata=counts, **run)
    return counts


def availability_document(ids: DataFrame, surfaced: DataFrame, id_col: str) -> DataFrame:
    """One row with one JSON document of two sorted distinct id lists; for larger lists write the frames themselves."""
    one = lambda df, name: df.agg(F.sort_array(F.collect_set(id_col)).alias(name))
    both = one(ids, "ids").withColumn("_k", F.lit(1)).join(one(surfaced, "surfaced").withColumn("_k", F.lit(1)), "_k")
    return both.select(F.to_json(F.struct("ids", "surfaced")).alias("document"))


def write_availability(ids: DataFrame, surfaced: DataFrame, id_col: str, path: str, parts: int | None = None) -> None:
    """The document of ``availability_document`` as text files that give it, byte by byte, when they are joined in the order of their names.

    The distinct ids of both lists are range-partitioned into ``parts``; each task sorts
    and writes its share. What opens and closes a list stands at its first and last id, which
    are known as minimum and maximum; ids are separated by what ends a record. The very
    last record is a file of its own, as nothing but the closing brace follows it.
    """
    spark, kind = ids.sparkSession, ids.schema[id_col].dataType
    values = saved(ids.select(F.lit(0).alias("list"), F.col(id_col).alias("id")).unionByName(surfaced.select(F.lit(1).alias("list"), F.col(id_col).cast(kind).alias("id"))).where("id IS NOT NULL").distinct())
    ends = {r["list"]: (r["low"], r["high"]) for r in values.groupBy("list").agg(F.min("id").alias("low"), F.max("id").alias("high")).collect()}
    text = F.expr("substring(to_json(array(id)), 2, length(to_json(array(id))) - 2)")
    opening, record = ('{"ids":[', '"surfaced":['), text
    for k, (low, high) in ends.items():
        at = lambda v, k=k: (F.col("list") == k) & (F.col("id") == F.lit(v).cast(kind))
        record = F.concat(F.when(at(low), opening[k]).otherwise(""), record, F.when(at(high), "]").otherwise(""))
    rows = values.withColumn("record", record)
    empty = [(k, f"{opening[k]}]") for k in (0, 1) if k not in ends]
    heads = spark.createDataFrame(empty, "list int, record string").select("list", F.lit(None).cast(kind).alias("id"), "record")
    last = F.col("list").eqNullSafe(1) & (F.col("id").eqNullSafe(F.lit(ends[1][1]).cast(kind)) if 1 in ends else F.lit(True))
    rows = rows.unionByName(heads)
    body = rows.where(~last).repartitionByRange(*([parts] if parts else []), "list", "id").sortWithinPartitions("list", "id").select("record")
    body.write.option("lineSep", ",").text(f"{path}/1-body")
    rows.where(last).select("record").coalesce(1).write.option("lineSep", "}").text(f"{path}/2-end")
