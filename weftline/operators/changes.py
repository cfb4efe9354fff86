"""Change feeds applied to keyed offer tables, set-wise: replace, remove, expire, announce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import join_null_safe, last_per_key, seed_dimension, upsert

KEYS = ["title_id", "service_id", "region", "type", "video_quality"]
VALUES = ["link", "deep_link", "price_amount", "price_currency", "expires_on"]
OFFER_TYPE = (
    "title_id string, service_id string, region string, type string, video_quality string, link string, deep_link string, "
    "price_amount decimal(8,2), price_currency string, expires_on timestamp, available_from timestamp, source string"
)
FEED, FOUND = "motn", "discovery"


def collapsed_services(options: DataFrame) -> DataFrame:
    """(title_id, service_id, n): the largest number of options of a service that share type and quality, if above one."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    groups = options.groupBy("title_id", "service_id", blank("type"), blank("video_quality")).agg(F.count("*").alias("n"))
    return groups.where("n > 1").groupBy("title_id", "service_id").agg(F.max("n").alias("n"))


def umbrella_map(options: DataFrame) -> DataFrame:
    """(title_id, umbrella_services): the collapsed services as a map, for titles that have any."""
    found = collapsed_services(options).where("service_id IS NOT NULL")
    entries = F.sort_array(F.collect_list(F.struct("service_id", "n")))
    return found.groupBy("title_id").agg(F.map_from_entries(entries).alias("umbrella_services"))


def replace_offers(offers: DataFrame, titles: DataFrame, payload: DataFrame, region: str = "US") -> DataFrame:
    """Replaces the offers of every title in ``titles`` in the region by the payload's options.

    Feed offers that are not announced for later go; found ones go where the payload
    names their service. The last option of a key wins and becomes a feed offer; one
    that meets an announced offer updates it and leaves its date. Options without a
    service are skipped, a missing type is a subscription.
    """
    options = payload.where("service_id IS NOT NULL").withColumn("type", F.coalesce("type", F.lit("subscription"))).withColumn("region", F.lit(region))
    named = options.select("title_id", "service_id").distinct().withColumn("_named", F.lit(True))
    swapped = titles.select("title_id").distinct().withColumn("_swapped", F.lit(True))
    old = offers.join(swapped, "title_id", "left").join(named, ["title_id", "service_id"], "left")
    current = F.col("_swapped") & (F.col("region") == region) & F.col("available_from").isNull()
    gone = current & ((F.col("source") == FEED) | ((F.col("source") == FOUND) & F.coalesce("_named", F.lit(False))))
    kept = old.where(~F.coalesce(gone, F.lit(False))).select(*offers.columns)
    rows = options.join(swapped, "title_id", "left_semi").withColumn("source", F.lit(FEED))
    return upsert(kept, rows, KEYS, [*VALUES, "source"], ["pos"])


def apply_upcoming(offers: DataFrame, changes: DataFrame, region: str = "US") -> DataFrame:
    """Announced offers: the last announcement of (title, service, type), without quality, sets link and date.

    Announcements without title, service, type or time are skipped; an offer that is
    already there is taken over by the feed.
    """
    rows = changes.where("title_id IS NOT NULL AND service_id IS NOT NULL AND type IS NOT NULL AND ts IS NOT NULL")
    rows = rows.select("title_id", "service_id", F.lit(region).alias("region"), "type", F.lit(None).cast("string").alias("video_quality"), "link", F.col("ts").alias("available_from"), F.lit(FEED).alias("source"), "seq")
    return upsert(offers, rows, KEYS, ["link", "available_from", "source"], ["seq"])


def apply_changes(offers: DataFrame, changes: DataFrame, payloads: DataFrame, options: DataFrame, region: str = "US") -> DataFrame:
    """Replays a batch of changes in the order of ``seq``, without going through them one by one.

    ``changes(seq, kind, title_id, service_id, type, ts)``: removed takes away feed offers
    of (title, service, type), announced ones too; expiring sets their expires_on.
    ``payloads(seq, title_id)``: the new or updated changes whose show came along, each
    replacing the title's offers by ``options(seq, title_id, pos, service_id, type,
    video_quality, link, ...)``. Offers of other regions stay.

    Only the last payload of a title, the first and last removal and the last expiry of
    (title, service, type) matter, so everything is joins of aggregates on the title.
    """
    here = offers.where(F.col("region") == region)
    options = options.where("service_id IS NOT NULL").withColumn("type", F.coalesce("type", F.lit("subscription")))
    last = payloads.groupBy("title_id").agg(F.max("seq").alias("swap"))
    removed = changes.where("kind = 'removed'").groupBy("title_id", "service_id", "type").agg(F.min("seq").alias("first_removed"), F.max("seq").alias("last_removed"))
    expiring = changes.where("kind = 'expiring'").groupBy("title_id", "service_id", "type").agg(F.max_by("ts", "seq").alias("expiry"), F.max("seq").alias("expiry_seq"))
    named = options.select("title_id", "service_id").distinct().withColumn("_named", F.lit(True))
    key = ["title_id", "service_id", "type", "video_quality"]
    value = lambda p: [F.col(v).alias(f"{p}_{v}") for v in VALUES]
    latest = last_per_key(options.select(*key, "seq", "pos", *VALUES), key, ["seq", "pos"])
    new = latest.select(*key, F.col("seq").alias("new_seq"), *value("new"))

    old = here.select(*key, "available_from", "source", *value("old"), F.lit(True).alias("_old"))
    both = join_null_safe(old, new, key, "full")
    both = both.select(*[F.coalesce(F.col(k), F.col(f"_right_{k}")).alias(k) for k in key], "available_from", "source", "_old", "new_seq", *[f"old_{v}" for v in VALUES], *[f"new_{v}" for v in VALUES])
    both = both.join(last, "title_id", "left").join(named, ["title_id", "service_id"], "left")
    both = both.join(removed, ["title_id", "service_id", "type"], "left").join(expiring, ["title_id", "service_id", "type"], "left")

    c, no = F.col, F.lit(False)
    is_old = F.coalesce("_old", no)
    feed = F.coalesce(c("source") == FEED, no)
    announced = is_old & c("available_from").isNotNull()
    in_last = F.coalesce(c("new_seq") == c("swap"), no)
    # announced offers outlive payloads; those of the feed end with the first removal
    stays_announced = announced & ~(feed & c("first_removed").isNotNull())
    stays_found = is_old & ~feed & ~announced & ~F.coalesce("_named", no)
    stays_other = is_old & ~feed & ~announced & (F.coalesce(c("source"), F.lit("")) != FOUND)
    stays_feed = is_old & feed & ~announced & c("swap").isNull() & c("first_removed").isNull()
    untouched = (stays_found | stays_other) & ~in_last
    fresh_base = ~is_old | (announced & ~stays_announced & (c("first_removed") < c("swap"))) | (is_old & ~announced & ~untouched & ~stays_feed)
    fresh = fresh_base & in_last & ~F.coalesce(c("last_removed") > c("swap"), no)
    overlaid = stays_announced & c("new_seq").isNotNull()
    # a row that was taken over by a payload belongs to the feed, so expiries after it count
    touched = F.when(overlaid & ~feed, c("new_seq")).when(fresh, c("swap")).otherwise(F.lit(-1))
    expires = c("expiry_seq").isNotNull() & (feed | overlaid | fresh) & (c("expiry_seq") > touched)
    newer = F.when(overlaid | fresh, c("new_expires_on")).otherwise(c("old_expires_on"))
    base_seq = F.when(overlaid, c("new_seq")).when(fresh, c("swap")).otherwise(F.lit(-1))
    expires_on = F.when(expires & (c("expiry_seq") > base_seq), c("expiry")).otherwise(newer)
    pick = lambda v: F.when(overlaid | fresh, c(f"new_{v}")).otherwise(c(f"old_{v}"))

    out = both.where(stays_announced | untouched | stays_feed | fresh)
    columns = {k: c(k) for k in key} | {v: pick(v) for v in VALUES if v != "expires_on"}
    columns |= {
        "region": F.lit(region),
        "expires_on": F.when(untouched, c("old_expires_on")).otherwise(expires_on),
        "available_from": F.when(stays_announced | untouched, c("available_from")),
        "source": F.when(overlaid | fresh, F.lit(FEED)).otherwise(c("source")),
    }
    done = out.select(*[columns[x].cast(offers.schema[x].dataType).alias(x) for x in offers.columns])
    return done.union(offers.where(~F.coalesce(F.col("region") == region, no)))


def with_shows(changes: DataFrame, shows: DataFrame) -> DataFrame:
    """The changes with ``has_show``: whether their page brought the show along; ``changes(page, title_id, ...)``, ``shows(page, title_id, ...)``."""
    known = shows.select("page", "title_id").distinct().withColumn("has_show", F.lit(True))
    return changes.join(known, ["page", "title_id"], "left").withColumn("has_show", F.coalesce("has_show", F.lit(False))).select(*changes.columns, "has_show")


def change_counts(changes: DataFrame, failed: Column | None = None) -> DataFrame:
    """(kind, n, failures): the changes seen of every kind, with or without a show, and how many of them meet the condition ``failed``."""
    failed = F.lit(False) if failed is None else failed
    return changes.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.coalesce(failed, F.lit(False))).alias("failures"))


def load_catalog(titles: DataFrame, services: DataFrame, offers: DataFrame, shows: DataFrame, named: DataFrame, options: DataFrame, region: str = "US") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(titles, services, offers) after a full load of a catalog's pages.

    ``shows``, ``named`` and ``options`` are the pages' flattened shows, services and
    options. Services are seeded first; of several shows of a title the last page's
    counts; every title's offers in the region are replaced by its options.
    """
    columns = [c for c in titles.columns if c != "title_id" and c in shows.columns]
    known = [c for c in services.columns if c != "id" and c in named.columns]
    titles = upsert(titles, shows, ["title_id"], columns, ["page"])
    services = seed_dimension(services, named, "id", "name", known, ["page", "pos"])
    return titles, services, replace_offers(offers, shows.select("title_id"), options, region)


def replaced_titles(titles: DataFrame, payloads: DataFrame, attributes: DataFrame, options: DataFrame, columns: list[str]) -> DataFrame:
    """Titles after a batch: attributes of each title's last payload, and the map of its collapsed services."""
    last = payloads.groupBy("title_id").agg(F.max("seq").alias("seq"))
    chosen = attributes.join(last, ["title_id", "seq"], "left_semi")
    umbrella = umbrella_map(options.join(last, ["title_id", "seq"], "left_semi"))
    rows = chosen.join(umbrella, "title_id", "left")
    return upsert(titles, rows, ["title_id"], [*columns, "umbrella_services"], ["seq"])
