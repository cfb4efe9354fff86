"""Reports over run logs and catalog tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hours after which a job of a cadence is late.
WINDOWS = {"daily": 26, "weekly": 192, "monthly": 768}
RANKS = {"ok": 0, "warn": 1, "fail": 2}


def latest_per(log: DataFrame, key: str, order: str) -> DataFrame:
    """The whole latest row of every key."""
    return log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), order).alias("_r")).select(key, "_r.*")


def last_cursor(log: DataFrame, key: str, cursor: str, order: str) -> DataFrame:
    """The latest cursor of every key that isn't null."""
    return log.where(F.col(cursor).isNotNull()).groupBy(key).agg(F.max_by(cursor, order).alias(cursor))


def last_completed(log: DataFrame, key: str, completed_at: str, done: Column) -> DataFrame:
    """(key, last_completed) as ISO-8601 text, null for keys without a completed run."""
    found = log.groupBy(key).agg(F.max(F.when(done, F.col(completed_at))).alias("_at"))
    return found.select(key, F.date_format("_at", "yyyy-MM-dd'T'HH:mm:ss").alias("last_completed"))


def coverage(rows: DataFrame, value: Column, last_run: int | None = None) -> DataFrame:
    """One row: total, filled, pct (1 decimal, 0 for an empty table), remaining, runs_left (null without a last run)."""
    t = rows.agg(F.count("*").alias("total"), F.count(value).alias("filled"))
    remaining = F.col("total") - F.col("filled")
    pct = F.when(F.col("total") == 0, 0.0).otherwise(F.round(100.0 * F.col("filled") / F.greatest("total", F.lit(1)), 1))
    left = F.ceil(remaining / last_run) if last_run else F.lit(None).cast("long")
    return t.select("total", "filled", pct.alias("pct"), remaining.alias("remaining"), left.alias("runs_left"))


def month_to_date(log: DataFrame, started_at: str, calls: str, now: Column) -> DataFrame:
    return log.where(F.col(started_at) >= F.date_trunc("MONTH", now)).agg(F.coalesce(F.sum(calls), F.lit(0)).alias("calls"))


def services_report(offers: DataFrame, services: DataFrame, region: str, exact: bool = True) -> DataFrame:
    """(name, titles): distinct titles of every service in a region; services of one name have a row each."""
    count = F.countDistinct if exact else F.approx_count_distinct
    own = offers.where(F.col("region") == region).groupBy("service_id").agg(count("title_id").alias("titles"))
    return own.join(services, "service_id").select("name", "titles")


def title_sketches(offers: DataFrame, keys: list[str], precision: int = 12) -> DataFrame:
    """(keys, sketch): HyperLogLog sketches of the distinct titles of every key, about 1.6 % off at 12 bits, to be stored and rolled up."""
    return offers.where("title_id IS NOT NULL").groupBy(*keys).agg(F.hll_sketch_agg("title_id", precision).alias("sketch"))


def rolled_up(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, titles): estimated distinct titles over all sketches of a key, without looking at the offers again."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("titles"))


def job_health(log: DataFrame, watch: DataFrame, now: Column, verify: str | None = None, pipeline: str | None = None) -> DataFrame:
    """(job, verdict, minutes) of watch(job, cadence) from each job's latest row in log(id, sync_type, status, started_at, completed_at).

    No run: fail if daily, else warn. A failed run fails. A run that isn't completed
    warns while it started within the cadence's window, else fails. A completed run
    fails once it is older than the window. An ok ``verify`` job is a warning if the
    latest ``pipeline`` run started after it completed.
    """
    latest = latest_per(log, "sync_type", "id")
    hours = F.lit(WINDOWS["daily"])
    for name, n in WINDOWS.items():
        hours = F.when(F.col("cadence") == name, n).otherwise(hours)
    since = now - F.make_interval(hours=hours)
    rows = watch.join(latest, watch["job"] == latest["sync_type"], "left")
    late = F.when(F.col("cadence") == "daily", "fail").otherwise("warn")
    verdict = (
        F.when(F.col("id").isNull(), late)
        .when(F.col("status") == "failed", "fail")
        .when(F.col("status") != "completed", F.when(F.col("started_at") >= since, "warn").otherwise("fail"))
        .when(F.col("completed_at") < since, "fail")
        .otherwise("ok")
    )
    rows = rows.withColumn("verdict", verdict)
    if verify and pipeline:
        started = latest.where(F.col("sync_type") == pipeline).select(F.lit(verify).alias("_job"), F.col("started_at").alias("_started"))
        rows = rows.join(started, rows["job"] == started["_job"], "left")
        behind = (F.col("verdict") == "ok") & (F.col("completed_at").isNull() | (F.col("_started") > F.col("completed_at")))
        rows = rows.withColumn("verdict", F.when(behind & F.col("_started").isNotNull(), "warn").otherwise(F.col("verdict")))
    minutes = F.round((F.unix_timestamp(F.col("completed_at").cast("timestamp")) - F.unix_timestamp(F.col("started_at").cast("timestamp"))) / 60, 1)
    return rows.select("job", "verdict", minutes.alias("minutes"))


def overall(health: DataFrame) -> DataFrame:
    """The worst verdict of all jobs; ok without any."""
    rank = F.coalesce(*[F.when(F.col("verdict") == v, n) for v, n in RANKS.items()])
    worst = F.coalesce(F.max(rank), F.lit(0))
    return health.agg(worst.alias("r")).select(F.coalesce(*[F.when(F.col("r") == n, F.lit(v)) for v, n in RANKS.items()]).alias("overall"))


def ambiguity_report(log: DataFrame, entries: str, order: str, runs: int = 50) -> DataFrame:
    """Ambiguous entries (title, list_source) of the last ``runs`` runs, each (lower title, source) once, as first seen from the newest run."""
    recent = log.orderBy(F.col(order).desc()).limit(runs)
    rows = recent.select(F.col(order).alias("run"), F.posexplode(entries).alias("pos", "e")).select("run", "pos", "e.title", "e.list_source")
    first = rows.groupBy(F.lower("title").alias("low"), "list_source").agg(F.min_by(F.struct("run", "pos", "title"), F.struct(-F.col("run"), "pos")).alias("f"))
    return first.select("f.title", "list_source", "f.run")


def job_summary(health: DataFrame, log: DataFrame, filled: DataFrame | None = None) -> DataFrame:
    """(job, summary): verdict, duration, processed count and counts in the metadata of the latest run, and the coverage if given, as one line of text.

    ``filled`` is a row of ``coverage``; a log without metadata has no counts.
    """
    if "metadata" not in log.columns:
        log = log.withColumn("metadata", F.lit(None).cast("string"))
    counts = F.map_filter(F.from_json("metadata", "map<string,string>"), lambda k, v: v.rlike("^[0-9]+$"))
    counts = F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat_ws(" ", e["value"], e["key"]))
    latest = latest_per(log, "sync_type", "id").select("sync_type", "titles_processed", F.nullif(F.array_join(counts, ", "), F.lit("")).alias("counts"))
    covers = F.lit(None).cast("string").alias("covers") if filled is None else F.concat_ws(" ", F.lit("covers"), "filled", F.lit("of"), "total").alias("covers")
    one = F.lit(1).alias("_one")
    latest = latest.select("*", covers) if filled is None else latest.select("*", one).join(F.broadcast(filled.limit(1).select(covers, one)), "_one").drop("_one")
    rows = health.join(latest, health["job"] == latest["sync_type"], "left")
    text = F.concat_ws(", ", F.concat_ws(": ", "job", "verdict"), F.concat(F.col("minutes").cast("string"), F.lit(" min")), F.concat(F.col("titles_processed").cast("string"), F.lit(" processed")), "counts", "covers")
    return rows.select("job", text.alias("summary"))


def streaming_status(log: DataFrame, titles: DataFrame, offers: DataFrame, services: DataFrame, region: str, now: Column, recent: int = 5) -> dict[str, DataFrame]:
    """The frames of the streaming status report: last sync, running jobs, calls this month, table sizes, services, recent runs."""
    done = log.where("status = 'completed'")
    sizes = titles.where("deleted_at IS NULL").agg(F.count("*").alias("n")).select(F.lit("titles").alias("name"), "n")
    for name, df in (("offers", offers), ("services", services)):
        sizes = sizes.union(df.agg(F.count("*").alias("n")).select(F.lit(name), "n"))
    return {
        "last_sync": done.agg(F.max("completed_at").alias("last_sync")),
        "running": log.where("status = 'running'").select("id", "sync_type", "started_at"),
        "calls": month_to_date(log, "started_at", "api_calls_used", now),
        "sizes": sizes,
        "services": services_report(offers, services, region),
        "recent": log.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(recent),
    }


def book_status(log: DataFrame, works: DataFrame, memberships: DataFrame, value: Column, last_run: int | None, recent: int = 5) -> dict[str, DataFrame]:
    """The frames of the book status report: coverage, members per list, recent runs and whether they ran to their end."""
    ended = F.coalesce(F.get_json_object("metadata", "$.exhausted") != "false", F.lit(True))
    return {
        "coverage": coverage(works, value, last_run),
        "lists": memberships.groupBy("list_source", "list_key").agg(F.count("*").alias("n")),
        "recent": log.orderBy(F.col("id").desc()).limit(recent).withColumn("exhausted", ended),
    }
