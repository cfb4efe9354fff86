"""Name matching: exact names with the nearest year, subtitle-tolerant containment, ranked search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import squash, tokens


def exact_candidates(queries: DataFrame, titles: DataFrame) -> DataFrame:
    """Every title of the query's type with the query's squashed name: (query_id, title_id, year).

    ``queries(query_id, title, type, year)``, ``titles(id, title, type, year)``. A name
    without letters and digits matches nothing.
    """
    q = queries.select("query_id", "type", squash(F.col("title")).alias("norm")).where("norm <> ''")
    t = titles.select(F.col("id").alias("title_id"), "type", squash(F.col("title")).alias("norm"), "year")
    return q.join(t, ["type", "norm"]).select("query_id", "title_id", "year")


def exact_nearest_year(queries: DataFrame, titles: DataFrame) -> DataFrame:
    """(query_id, n_exact, match_id): the one exact candidate, or of several the only one with the nearest year.

    Several candidates need a year from the query; candidates without a year are then
    skipped, and a tie leaves no match. The candidates of a (type, name) are counted
    by year first, so a name that many titles carry costs one row per year.
    """
    t = titles.select(F.col("id").alias("title_id"), "type", squash(F.col("title")).alias("norm"), F.col("year").alias("title_year"))
    t = t.groupBy("type", "norm", "title_year").agg(F.min("title_id").alias("low"), F.max("title_id").alias("high"), F.count("*").alias("n"))
    q = queries.select("query_id", "type", "year", squash(F.col("title")).alias("norm")).where("norm <> ''")
    away = F.abs(F.col("title_year") - F.col("year"))
    found = q.join(t, ["type", "norm"]).withColumn("away", away).groupBy("query_id").agg(
        F.sum("n").alias("n_exact"), F.min("low").alias("only"), F.min("away").alias("least"), F.collect_list(F.struct("away", "n", "low")).alias("years")
    )
    near = F.filter("years", lambda y: y["away"] == F.col("least"))
    ways = F.aggregate(near, F.lit(0).cast("long"), lambda acc, y: acc + y["n"])
    unique = F.when((ways == 1), F.get(near, F.lit(0))["low"])
    return found.select("query_id", "n_exact", F.when(F.col("n_exact") == 1, F.col("only")).otherwise(unique).alias("match_id"))


def _names(rows: DataFrame, key: str) -> DataFrame:
    """The distinct token lists of every type, with the smallest and largest id that has them."""
    own = rows.select(key, "type", tokens(F.col("title")).alias("t")).where(F.size("t") > 0)
    return own.groupBy("type", "t").agg(F.min(key).alias("low"), F.max(key).alias("high"))


def _hashes(words: Column) -> tuple[Column, Column]:
    return F.xxhash64(words), F.xxhash64(words, F.lit(7))


def run_index(names: DataFrame, least: int = 1) -> DataFrame:
    """(type, h1, h2, *key, first, sequel) of every run of words in names(type, t, ...) that a shorter name may be.

    A run counts if it has at least half of the name's letters and digits. It is known
    by 128 bits of hash of its words, so that a name is looked up as a whole and a
    common word is no key. ``sequel`` tells that a number follows a run at the name's
    start, or stands before one at its end. The whole name is no run of its own with
    ``least`` 1.
    """
    n = F.size("t")
    width = lambda c: F.length(F.array_join(c, ""))
    digits = lambda at: F.coalesce(F.get("t", at).rlike("^[0-9]+$"), F.lit(False))

    def run(i: Column, m: Column) -> Column:
        words = F.slice("t", i, m)
        h1, h2 = _hashes(words)
        sequel = ((i == 1) & digits(m)) | ((i > 1) & (i + m == n + 1) & digits(i - F.lit(2)))
        return F.struct(h1.alias("h1"), h2.alias("h2"), i.alias("first"), sequel.alias("sequel"), (width(words) * 2 >= width(F.col("t"))).alias("long"))

    starts = F.sequence(F.lit(1), n)
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.filter(F.sequence(F.lit(1), n - i + 1), lambda m: m <= n - least), lambda m: run(i, m))))
    rest = [c for c in names.columns if c not in ("type", "t")]
    return names.where(n > least).select("type", *rest, F.explode(F.filter(runs, lambda r: r["long"])).alias("r")).select("type", *rest, "r.h1", "r.h2", "r.first", "r.sequel")


def subtitle_matches(queries: DataFrame, titles: DataFrame) -> DataFrame:
    """(query_id, match_id): the only title of the type of which one name is a run of whole words in the other.

    Both ways are equality joins: a query is looked up among the runs of the titles, and a title
    among the runs of the queries. The first place of a run in a name decides whether a
    number follows. Names repeated under one type are compared once, and a title list's
    matches are reduced to the smallest and largest id before they meet.
    """
    t = _names(titles.select("id", "type", "title"), "id")
    q = queries.select("query_id", "type", tokens(F.col("title")).alias("t")).where(F.size("t") > 0)
    asked = q.select("type", "t").distinct()
    h1, h2 = _hashes(F.col("t"))
    named = lambda rows, *more: rows.select("type", h1.alias("h1"), h2.alias("h2"), *more)
    key = ["type", "h1", "h2"]
    whole = named(asked)
    # runs shorter than their name: the first place of each, and what follows it there
    first = lambda rows, *who: rows.groupBy(*key, *who).agg(F.min_by("sequel", "first").alias("sequel")).where("NOT sequel")
    longer = run_index(t.select("type", "t", "low", "high", F.xxhash64("t").alias("name"))).join(whole, key, "left_semi")
    longer = first(longer, "name", "low", "high").select(*key, "low", "high")
    equal = named(t, "low", "high").join(whole, key, "left_semi")
    by_query = longer.union(equal).groupBy(*key).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    short = named(t, "low", "high")
    held = run_index(asked.select("type", "t", h1.alias("own1"), h2.alias("own2"))).join(short.select(*key), key, "left_semi")
    held = first(held, "own1", "own2").join(short, key).groupBy("type", F.col("own1").alias("h1"), F.col("own2").alias("h2")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    best = by_query.select(*key, "low", "high").union(held.select(*key, "low", "high")).groupBy(*key).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    best = best.select(*key, F.when(F.col("low") == F.col("high"), F.col("low")).alias("match_id"))
    return named(q, "query_id").join(best, key).select("query_id", "match_id")


def match_titles(queries: DataFrame, titles: DataFrame) -> DataFrame:
    """(query_id, match_id, method): exact name and nearest year, else containment if there is no exact candidate, else null."""
    exact = exact_nearest_year(queries, titles)
    rest = queries.join(exact, "query_id", "left_anti")
    loose = subtitle_matches(rest, titles)
    out = queries.select("query_id").join(exact, "query_id", "left").join(loose.withColumnRenamed("match_id", "loose_id"), "query_id", "left")
    method = F.when(F.col("match_id").isNotNull(), "exact").when(F.col("loose_id").isNotNull(), "subtitle")
    return out.select("query_id", F.coalesce("match_id", "loose_id").alias("match_id"), method.alias("method"))


def resolve_ranked(queries: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, video_id): of results(query_id, rank, video_id, title, type) the first exact name, else the first close one.

    Close means that one squashed name holds the other, the shorter is at least half as
    long, and a longer name doesn't go on with a digit. Only results of the query's type
    count; queries without a fitting result get no row.
    """
    q = queries.select("query_id", "type", squash(F.col("title")).alias("q")).where("q <> ''")
    r = results.select("query_id", "rank", "video_id", "type", squash(F.col("title")).alias("r")).where("r <> ''")
    both = q.join(r, ["query_id", "type"])
    short = F.when(F.length("q") <= F.length("r"), F.col("q")).otherwise(F.col("r"))
    long = F.when(F.length("q") <= F.length("r"), F.col("r")).otherwise(F.col("q"))
    at = F.instr(long, short)
    rest = F.substring(long, at + F.length(short), F.lit(1))
    close = (at > 0) & (F.length(short) * 2 >= F.length(long)) & ~((at == 1) & rest.rlike("^[0-9]$"))
    step = F.when(F.col("q") == F.col("r"), 0).when(close, 1)
    both = both.withColumn("step", step).where("step IS NOT NULL")
    return both.groupBy("query_id").agg(F.min_by("video_id", F.struct("step", "rank", "video_id")).alias("video_id"))
