"""Audits of earlier matches: who offers what by which source, and what to repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import classified, playable, stale_or_never, tracked_title, video_id
from .changes import FEED, FOUND, KEYS
from .match import match_titles, resolve_ranked
from .tables import last_per_key, join_null_safe

SERVICE, REGION, WATCH = "netflix", "US", "subscription"


def _here() -> Column:
    return (F.col("service_id") == SERVICE) & (F.col("region") == REGION)


def without_offer(titles: DataFrame, offers: DataFrame, which: Column | None = None) -> DataFrame:
    """Titles without an offer of the service in the region (or without one that ``which`` accepts)."""
    return titles.join(offers.where(_here() if which is None else which), "title_id", "left_anti")


def provenance(titles: DataFrame, offers: DataFrame) -> DataFrame:
    """(title_id, from_feed, from_discovery) for every title."""
    flags = offers.where(_here()).groupBy("title_id").agg(F.max(F.col("source") == FEED).alias("from_feed"), F.max(F.col("source") == FOUND).alias("from_discovery"))
    no = F.lit(False)
    return titles.select("title_id").join(flags, "title_id", "left").select("title_id", F.coalesce("from_feed", no).alias("from_feed"), F.coalesce("from_discovery", no).alias("from_discovery"))


def discovery_upsert(offers: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Adds found(title_id, video_id, seq) as subscription offers without quality; restamps those found before.

    An offer of any other source at the same key is left alone.
    """
    new = last_per_key(found.select("title_id", "video_id", "seq"), ["title_id"], ["seq"])
    link = F.concat(F.lit("https://www.netflix.com/title/"), "video_id")
    fixed = {"service_id": F.lit(SERVICE), "region": F.lit(REGION), "type": F.lit(WATCH), "video_quality": F.lit(None).cast("string")}
    new = new.select("title_id", *[v.alias(k) for k, v in fixed.items()], link.alias("_link"))
    both = join_null_safe(offers.withColumn("_old", F.lit(True)), new, KEYS, "full")
    ours = F.col("_link").isNotNull() & (F.col("_old").isNull() | (F.col("source") == FOUND))
    out = {c: F.coalesce(F.col(c), F.col(f"_right_{c}")) if c in KEYS else F.col(c) for c in offers.columns}
    out["link"] = F.when(ours, F.col("_link")).otherwise(F.col("link"))
    if "updated_at" in out:
        out["updated_at"] = F.when(ours, now).otherwise(F.col("updated_at"))
    out["source"] = F.when(ours, F.lit(FOUND)).otherwise(F.col("source"))
    return both.select(*[v.cast(offers.schema[c].dataType).alias(c) for c, v in out.items()])


def verify_candidates(titles: DataFrame, offers: DataFrame, now: Column, days: int = 14, force: bool = False) -> DataFrame:
    """Titles that can be watched now and were never checked or not lately, with their smallest link."""
    links = offers.where(playable(now)).groupBy("title_id").agg(F.min("link").alias("link"))
    due = titles.where(stale_or_never(F.col("checked_at"), now, days, force))
    return due.join(links, "title_id").withColumn("video_id", video_id(F.col("link")))


def classify(candidates: DataFrame, levels: DataFrame, hits: DataFrame, failed: DataFrame, ceiling: int) -> DataFrame:
    """(title_id, surfaced): null without a level, false above the ceiling, else whether it was hit; failed lookups get no row."""
    rows = candidates.join(failed.select("title_id").distinct(), "title_id", "left_anti")
    level = levels.groupBy("video_id").agg(F.max("level").alias("level"))
    hit = hits.select("video_id").distinct().withColumn("hit", F.lit(True))
    rows = rows.join(level, "video_id", "left").join(hit, "video_id", "left")
    return rows.select("title_id", classified(F.col("level"), F.col("hit"), ceiling).alias("surfaced"))


def write_back(titles: DataFrame, offers: DataFrame, classes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(titles, offers) with the classes stamped; titles classed false lose their discovery offers of the service."""
    own = classes.groupBy("title_id").agg(F.max("surfaced").alias("_class"), F.lit(True).alias("_seen"))
    stamped = titles.join(own, "title_id", "left")
    stamped = stamped.withColumns({"surfaced": F.when(F.col("_seen"), F.col("_class")).otherwise(F.col("surfaced")), "checked_at": F.when(F.col("_seen"), now).otherwise(F.col("checked_at"))})
    refused = own.where("NOT _class").select("title_id").withColumn("_no", F.lit(True))
    left = offers.join(refused, "title_id", "left").where(~(F.coalesce("_no", F.lit(False)) & _here() & (F.col("source") == FOUND)))
    return stamped.select(*titles.columns), left.select(*offers.columns)


def reset_orphans(titles: DataFrame, offers: DataFrame, now: Column) -> DataFrame:
    """Checked titles that can't be watched any more lose flag and date."""
    live = offers.where(playable(now)).select("title_id").distinct().withColumn("_live", F.lit(True))
    out = titles.join(live, "title_id", "left")
    orphan = F.col("checked_at").isNotNull() & F.col("_live").isNull()
    return out.withColumns({c: F.when(~orphan, F.col(c)) for c in ("surfaced", "checked_at")}).select(*titles.columns)


def reconcile(offers: DataFrame, titles: DataFrame, videos: DataFrame) -> DataFrame:
    """(title_id, link, match_id, class) of the discovery offers, resolved anew by what their video is called.

    ``videos(video_id, title, type, year)``. bad_link: no video id; unresolved: no such
    video; ok, move: the name resolves to the same or another title; review: to none.
    """
    own = offers.where(_here() & (F.col("source") == FOUND)).select("title_id", "link", video_id(F.col("link")).alias("video_id"))
    known = videos.where(F.trim("title") != "").groupBy("video_id").agg(F.min(F.struct("title", "type", "year")).alias("v"))
    asked = known.join(own.select("video_id").distinct(), "video_id", "left_semi")
    match = match_titles(asked.select(F.col("video_id").alias("query_id"), "v.title", "v.type", "v.year"), titles)
    out = own.join(asked.select("video_id", F.lit(True).alias("seen")), "video_id", "left").join(match.select(F.col("query_id").alias("video_id"), "match_id"), "video_id", "left")
    kind = F.when(F.col("video_id").isNull(), "bad_link").when(F.col("seen").isNull(), "unresolved").when(F.col("match_id").isNull(), "review")
    return out.select("title_id", "link", "match_id", kind.when(F.col("match_id") == F.col("title_id"), "ok").otherwise("move").alias("class"))


def apply_moves(offers: DataFrame, titles: DataFrame, moves: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(offers, titles) after the ``move`` rows of a reconcile: each offer goes to the right title, vacated titles lose their flags."""
    moves = moves.where(F.col("class") == "move").select("title_id", "link", "match_id")
    gone = moves.select("title_id", "link").distinct().withColumn("_gone", F.lit(True))
    left = offers.join(gone, ["title_id", "link"], "left").where(~(F.coalesce("_gone", F.lit(False)) & _here() & (F.col("source") == FOUND)))
    found = moves.select(F.col("match_id").alias("title_id"), video_id(F.col("link")).alias("video_id"), F.xxhash64("title_id").alias("seq"))
    after = discovery_upsert(left.select(*offers.columns), found, now)
    linked = after.where(_here() & F.col("link").contains("/title/")).select("title_id").distinct().withColumn("_linked", F.lit(True))
    vacated = moves.select("title_id").distinct().withColumn("_moved", F.lit(True))
    out = titles.join(vacated, "title_id", "left").join(linked, "title_id", "left")
    keep = F.col("_moved").isNull() | F.col("_linked").isNotNull()
    return after, out.withColumns({c: F.when(keep, F.col(c)) for c in ("surfaced", "checked_at")}).select(*titles.columns)


def discover(offers: DataFrame, titles: DataFrame, browse: DataFrame) -> DataFrame:
    """(seq, title_id, outcome) of browse(seq, video_id, title, type, year): created, restamped, skipped (the feed has it) or unmatched.

    A later row for a title that an earlier one created counts as restamped.
    """
    match = match_titles(browse.select(F.col("seq").alias("query_id"), "title", "type", "year"), titles)
    rows = match.select(F.col("query_id").alias("seq"), F.col("match_id").alias("title_id"))
    flags = offers.where(_here()).groupBy("title_id").agg(F.max(F.col("source") == FEED).alias("feed"), F.max(F.col("source") == FOUND).alias("found"))
    rows = rows.join(flags, "title_id", "left")
    first = rows.where("title_id IS NOT NULL").groupBy("title_id").agg(F.min("seq").alias("first"))
    rows = rows.join(first, "title_id", "left")
    again = F.coalesce("found", F.lit(False)) | (F.col("seq") != F.col("first"))
    outcome = F.when(F.col("title_id").isNull(), "unmatched").when(F.coalesce("feed", F.lit(False)), "skipped").when(again, "restamped").otherwise("created")
    return rows.select("seq", "title_id", outcome.alias("outcome"))


def unmatched_sample(outcomes: DataFrame, browse: DataFrame, n: int) -> DataFrame:
    """(seq, title) of the first ``n`` browse rows that no title matches, for a report."""
    return browse.join(outcomes.where("outcome = 'unmatched'").select("seq"), "seq", "left_semi").select("seq", "title").orderBy("seq").limit(n)


def tracked_ids(titles: DataFrame, offers: DataFrame, which: Column) -> DataFrame:
    """Distinct outside ids of live titles with an accepted offer, sorted."""
    own = titles.where(tracked_title()).join(offers.where(which), "title_id", "left_semi")
    return own.select("imdb_id").distinct().orderBy("imdb_id")


def discovery_fill(offers: DataFrame, titles: DataFrame, browse: DataFrame, now: Column) -> DataFrame:
    """Offers with every browse row that resolves to a title the feed doesn't own; strictly additive."""
    outcomes = discover(offers, titles, browse).where(F.col("outcome").isin("created", "restamped"))
    found = outcomes.join(browse.select("seq", "video_id"), "seq").select("title_id", "video_id", "seq")
    return discovery_upsert(offers, found, now)


def backstop_fill(offers: DataFrame, titles: DataFrame, on_service: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Offers for live titles that an outside provider check finds on the service though no offer says so.

    ``titles(title_id, title, tmdb_type, tmdb_id, deleted_at)``, ``on_service(title_id)``;
    ``results(query_id, rank, video_id, title, type)`` are the ranked search results of a
    title, whose type is series for tv and movie otherwise.
    """
    live = titles.where(F.col("deleted_at").isNull() & (F.col("tmdb_id") > 0))
    missing = without_offer(live, offers).join(on_service, "title_id", "left_semi")
    kind = F.when(F.col("tmdb_type") == "tv", "series").otherwise("movie")
    found = resolve_ranked(missing.select(F.col("title_id").alias("query_id"), "title", kind.alias("type")), results)
    return discovery_upsert(offers, found.select(F.col("query_id").alias("title_id"), "video_id", F.lit(0).alias("seq")), now)
