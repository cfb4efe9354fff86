"""Registered queries: the catalog operators bound to the driver's tables, each with its oracle SQL.

Roles: titles are parts, services suppliers, offers line items (region by return flag,
type by line status, quality by line number, 1 meaning none), run log and changes
events, memberships orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import audit, changes, enrich, match, reports, tables, works
from ..sources import landed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function under its own name, with its oracle if it has one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def offers(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    return li.select(
        F.col("l_partkey").cast("string").alias("title_id"), F.col("l_suppkey").cast("string").alias("service_id"), F.col("l_returnflag").alias("region"), F.col("l_linestatus").alias("type"),
        F.nullif("l_linenumber", F.lit(1)).cast("string").alias("video_quality"), F.concat(F.lit("/title/"), "l_orderkey").alias("link"), F.lit(None).cast("string").alias("deep_link"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("price_amount"), F.lit("USD").alias("price_currency"), F.col("l_shipdate").alias("expires_on"),
        F.when(F.col("l_quantity") > 45, F.col("l_shipdate")).alias("available_from"), F.when(F.col("l_orderkey") % 5 == 0, "discovery").otherwise("motn").alias("source"),
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
    )


#: The same as a DuckDB subquery.
OFFERS = """(SELECT l_partkey::VARCHAR title_id, l_suppkey::VARCHAR service_id, l_returnflag region, l_linestatus AS type, nullif(l_linenumber,1)::VARCHAR video_quality,
 '/title/' || l_orderkey link, l_extendedprice::DECIMAL(12,2) price_amount, l_shipdate expires_on, CASE WHEN l_quantity > 45 THEN l_shipdate END available_from,
 CASE WHEN l_orderkey % 5 = 0 THEN 'discovery' ELSE 'motn' END source, l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem)"""
#: A full order of line items: repeated (order, line) pairs are told apart by their values.
ORDER = ["l_orderkey", "l_linenumber", "l_quantity", "price_amount", "l_discount", "l_tax", "title_id", "service_id"]
ORDER_SQL = "l_orderkey, l_linenumber, l_quantity, price_amount, l_discount, l_tax, title_id, service_id"


# Reads


@query("SELECT DISTINCT l_partkey AS title_id FROM lineitem WHERE l_suppkey = 7 AND l_returnflag = 'A' AND l_linestatus = 'F'")
def availability_ids(spark, d):
    own = read(spark, d, "lineitem").where("l_suppkey = 7 AND l_returnflag = 'A' AND l_linestatus = 'F'")
    titles = read(spark, d, "part").select(F.col("p_partkey").alias("title_id"))
    return titles.join(own, titles.title_id == own.l_partkey, "left_semi").distinct()


@query("SELECT DISTINCT p_partkey AS title_id FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_suppkey = 7 AND l_returnflag = 'A' AND l_linestatus = 'F' AND p_size >= 25")
def availability_flagged_subset(spark, d):
    flagged = read(spark, d, "part").where("p_size >= 25").select(F.col("p_partkey").alias("title_id"))
    return availability_ids(spark, d).join(flagged, "title_id", "left_semi")


@query("SELECT s_name AS name, count(DISTINCT l_partkey) AS titles FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'A' GROUP BY s_suppkey, s_name")
def titles_per_service(spark, d):
    services = read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("service_id"), F.col("s_name").alias("name"))
    return reports.services_report(offers(spark, d).select("title_id", "service_id", "region"), services, "A")


@query("SELECT o_orderpriority AS list_source, o_orderstatus AS list_key, count(*) AS n FROM orders GROUP BY ALL")
def memberships_per_list(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_orderpriority").alias("list_source"), F.col("o_orderstatus").alias("list_key"))
    return rows.groupBy("list_source", "list_key").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS total, count(nullif(o_orderstatus,'P')) AS filled, round(100.0*count(nullif(o_orderstatus,'P'))/count(*),1)::DOUBLE AS pct,
 count(*)-count(nullif(o_orderstatus,'P')) AS remaining, CAST(ceil((count(*)-count(nullif(o_orderstatus,'P')))/7.0) AS BIGINT) AS runs_left FROM orders""")
def coverage_and_eta(spark, d):
    return reports.coverage(read(spark, d, "orders"), F.nullif("o_orderstatus", F.lit("P")), 7)


@query("SELECT coalesce(sum(user_id),0)::BIGINT AS calls FROM events WHERE ts >= (SELECT date_trunc('month', max(ts)) FROM events)")
def month_to_date_calls(spark, d):
    log = read(spark, d, "events")
    now = log.agg(F.max("ts")).first()[0]
    return reports.month_to_date(log, "ts", "user_id", F.lit(now).cast("timestamp_ntz"))


@query("SELECT event_type AS sync_type, strftime(max(CASE WHEN value > 150 THEN ts END), '%Y-%m-%dT%H:%M:%S') AS last_completed FROM events GROUP BY 1")
def last_completed_per_type(spark, d):
    log = read(spark, d, "events").withColumnRenamed("event_type", "sync_type")
    return reports.last_completed(log, "sync_type", "ts", F.col("value") > 150)


@query("SELECT event_type AS sync_type, max(event_id) AS id, arg_max(user_id, event_id) AS user_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def latest_run_per_type(spark, d):
    log = read(spark, d, "events").select(F.col("event_type").alias("sync_type"), F.col("event_id").alias("id"), "user_id", "value")
    return reports.latest_per(log.withColumn("at", F.col("id")), "sync_type", "at").select("sync_type", "id", "user_id", "value")


def _log(spark, d):
    e = read(spark, d, "events")
    status = F.when(F.col("value") < 20, "failed").when(F.col("value") < 60, "running").otherwise("completed")
    done = F.when(F.col("value") >= 60, F.col("ts") + F.expr("INTERVAL 10 MINUTES"))
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("sync_type"), status.alias("status"), F.col("ts").alias("started_at"), done.alias("completed_at"))


_LOG = """(SELECT event_id id, event_type sync_type, CASE WHEN value < 20 THEN 'failed' WHEN value < 60 THEN 'running' ELSE 'completed' END status, ts started_at,
 CASE WHEN value >= 60 THEN ts + INTERVAL 10 MINUTE END completed_at FROM events)"""
_WATCH = "(SELECT DISTINCT event_type job, CASE WHEN event_type < 'd' THEN 'daily' ELSE 'weekly' END cadence FROM events UNION ALL SELECT 'absent', 'daily')"
_HEALTH = f"""WITH latest AS (SELECT * FROM {_LOG} QUALIFY row_number() OVER (PARTITION BY sync_type ORDER BY id DESC) = 1),
 nw AS (SELECT max(ts) AS nw FROM events),
 h AS (SELECT job, CASE WHEN id IS NULL THEN CASE WHEN cadence = 'daily' THEN 'fail' ELSE 'warn' END WHEN status = 'failed' THEN 'fail'
  WHEN status <> 'completed' THEN CASE WHEN started_at >= nw - to_hours(CASE WHEN cadence='daily' THEN 26 ELSE 192 END) THEN 'warn' ELSE 'fail' END
  WHEN completed_at < nw - to_hours(CASE WHEN cadence='daily' THEN 26 ELSE 192 END) THEN 'fail' ELSE 'ok' END verdict,
  round(epoch(completed_at - started_at)/60, 1) AS minutes, completed_at FROM {_WATCH} w LEFT JOIN latest ON job = sync_type, nw)"""


def _health(spark, d, **more):
    log = _log(spark, d)
    jobs = log.select(F.col("sync_type").alias("job")).distinct()
    watch = jobs.select("job", F.when(F.col("job") < "d", "daily").otherwise("weekly").alias("cadence"))
    watch = watch.union(spark.createDataFrame([("absent", "daily")], "job string, cadence string"))
    now = read(spark, d, "events").agg(F.max("ts")).first()[0]
    return reports.job_health(log, watch, F.lit(now).cast("timestamp_ntz"), **more)


@query(f"{_HEALTH} SELECT job, verdict, minutes FROM h")
def job_verdicts(spark, d):
    return _health(spark, d)


@query(f"""{_HEALTH} SELECT job, CASE WHEN job = 'purchase' AND verdict = 'ok' AND (SELECT started_at FROM latest WHERE sync_type = 'click') IS NOT NULL
 AND (completed_at IS NULL OR (SELECT started_at FROM latest WHERE sync_type = 'click') > completed_at) THEN 'warn' ELSE verdict END AS verdict, minutes FROM h""")
def verify_downgrade(spark, d):
    return _health(spark, d, verify="purchase", pipeline="click")


@query(f"{_HEALTH} SELECT ['ok','warn','fail'][max(CASE verdict WHEN 'ok' THEN 1 WHEN 'warn' THEN 2 ELSE 3 END)] AS overall FROM h")
def overall_verdict(spark, d):
    return reports.overall(_health(spark, d))


@query("SELECT event_id, event_type, user_id FROM events ORDER BY event_id DESC LIMIT 5")
def recent_runs(spark, d):
    return read(spark, d, "events").select("event_id", "event_type", "user_id").orderBy(F.col("event_id").desc()).limit(5)


@query(f"SELECT title_id, min(link) AS link FROM {OFFERS} GROUP BY 1")
def min_link_per_title(spark, d):
    return offers(spark, d).groupBy("title_id").agg(F.min("link").alias("link"))


@query(f"""SELECT title_id, link FROM {OFFERS} WHERE service_id = '7' AND region = 'A' AND link LIKE '%/title/%' AND (available_from IS NULL OR available_from <= TIMESTAMP '1995-06-17')
 AND (expires_on IS NULL OR expires_on > TIMESTAMP '1995-06-17')""")
def playable_offers(spark, d):
    return offers(spark, d).where(X.playable(ts("1995-06-17 00:00:00"), "7", "A")).select("title_id", "link")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_orderdate < TIMESTAMP '1997-01-15' - INTERVAL 14 DAY")
def stale_candidates(spark, d):
    rows = read(spark, d, "orders").withColumn("checked_at", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")))
    return rows.where(X.stale_or_never(F.col("checked_at"), ts("1997-01-15 00:00:00"))).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-15' - INTERVAL 720 HOUR AND TIMESTAMP '1997-01-15'")
def lookback_window(spark, d):
    return read(spark, d, "orders").where(X.lookback(F.col("o_orderdate"), ts("1997-01-15 00:00:00"), 720)).select("o_orderkey")


@query("SELECT p_partkey AS title_id FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_suppkey = 7 AND l_returnflag = 'A' AND l_linestatus = 'F')")
def orphan_titles(spark, d):
    titles = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("title_id"))
    which = (F.col("service_id") == "7") & (F.col("region") == "A") & (F.col("type") == "F")
    return audit.without_offer(titles, offers(spark, d), which).select(F.col("title_id").cast("long").alias("title_id"))


@query("SELECT DISTINCT url FROM pages WHERE regexp_matches(url, '/en/[^/?#]+') AND url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0) ORDER BY url")
def delta_new_urls(spark, d):
    pages = read(spark, d, "pages")
    known = pages.where("page_id % 3 = 0").select(F.lit("site").alias("list_source"), F.col("url").alias("review_url"))
    return landed.delta_new(landed.discover_urls(pages, "url", "/en/[^/?#]+"), known, "site")


@query("SELECT DISTINCT url FROM pages WHERE regexp_matches(url, 'example[.](com|org)/[a-z]+/[0-9]+')")
def page_url_discovery(spark, d):
    return landed.discover_urls(read(spark, d, "pages"), "url", "example[.](com|org)/[a-z]+/[0-9]+")


@query("SELECT DISTINCT url FROM pages WHERE url > 'https://m' ORDER BY url LIMIT 25")
def resume_after_cursor(spark, d):
    return landed.resume_after(read(spark, d, "pages").select("url").distinct(), "https://m", 25)


@query(f"""SELECT p_partkey::VARCHAR AS title_id, coalesce(bool_or(source = 'motn'), false) AS from_feed, coalesce(bool_or(source = 'discovery'), false) AS from_discovery
 FROM part LEFT JOIN (SELECT * FROM {OFFERS} WHERE region = 'A' AND service_id = '7') ON title_id = p_partkey::VARCHAR GROUP BY 1""")
def provenance_flags(spark, d):
    titles = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("title_id"))
    return audit.provenance(titles, as_watched(offers(spark, d)))


def as_watched(rows):
    """Offers of supplier 7 in region A stand for the audited service and region."""
    own = (F.col("service_id") == "7") & (F.col("region") == "A")
    return rows.withColumns({"service_id": F.when(own, audit.SERVICE).otherwise(F.col("service_id")), "region": F.when(own, audit.REGION).otherwise(F.col("region"))})


@query(f"""SELECT title_id, service_id, max(n) AS n FROM (SELECT title_id, service_id, type, coalesce(video_quality,'') q, count(*) n FROM {OFFERS} GROUP BY ALL HAVING count(*) > 1) GROUP BY 1, 2""")
def collapsed_services(spark, d):
    return changes.collapsed_services(offers(spark, d))


# Change application

_BASE = f"(SELECT * FROM {OFFERS} WHERE l_orderkey % 2 = 0 QUALIFY row_number() OVER (PARTITION BY title_id, service_id, region, type, video_quality ORDER BY {ORDER_SQL}) = 1)"
_PAY = f"(SELECT * FROM {OFFERS} WHERE l_orderkey % 2 = 1 AND region = 'A')"


def _base(rows):
    own = rows.where("l_orderkey % 2 = 0")
    first = own.groupBy(*changes.KEYS).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in changes.KEYS]), F.struct(*ORDER)).alias("r"))
    return first.select(*changes.KEYS, "r.*").select(*changes.KEYS, *changes.VALUES, "available_from", "source")


def _numbered(rows, order):
    """Payload rows with a place that orders them within a title."""
    return rows.withColumn("pos", F.struct(*order))


@query(f"""WITH base AS {_BASE}, pay AS {_PAY}, kept AS (SELECT * FROM base b WHERE NOT (region = 'A' AND available_from IS NULL AND title_id IN (SELECT title_id FROM pay)
  AND (source = 'motn' OR (source = 'discovery' AND EXISTS (SELECT 1 FROM pay p WHERE p.title_id = b.title_id AND p.service_id = b.service_id))))),
 last AS (SELECT * FROM pay QUALIFY row_number() OVER (PARTITION BY title_id, service_id, type, video_quality ORDER BY l_orderkey DESC, l_linenumber DESC, l_quantity DESC, price_amount DESC, l_discount DESC, l_tax DESC) = 1)
SELECT coalesce(k.title_id, l.title_id) AS title_id, coalesce(k.service_id, l.service_id) AS service_id, coalesce(k.region, l.region) AS region, coalesce(k.type, l.type) AS type,
 coalesce(k.video_quality, l.video_quality) AS video_quality, coalesce(l.link, k.link) AS link, coalesce(l.price_amount, k.price_amount)::DOUBLE AS price_amount, k.available_from,
 CASE WHEN l.link IS NOT NULL THEN 'motn' ELSE k.source END AS source
FROM kept k FULL JOIN last l ON k.title_id = l.title_id AND k.service_id = l.service_id AND k.region = l.region AND k.type = l.type AND k.video_quality IS NOT DISTINCT FROM l.video_quality""")
def replace_offers(spark, d):
    rows = offers(spark, d)
    pay = _numbered(rows.where("l_orderkey % 2 = 1 AND region = 'A'"), ORDER[:6])
    out = changes.replace_offers(_base(rows), pay.select("title_id"), pay, "A")
    return out.select(*changes.KEYS, "link", F.col("price_amount").cast("double").alias("price_amount"), "available_from", "source")


@query(f"""WITH base AS {_BASE}, ch AS (SELECT l_orderkey seq, * FROM {OFFERS} WHERE l_orderkey % 2 = 1 AND region = 'A'),
 last AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY title_id, service_id, type ORDER BY l_orderkey DESC, l_linenumber DESC, l_quantity DESC, price_amount DESC, l_discount DESC, l_tax DESC) = 1)
SELECT coalesce(k.title_id, l.title_id) AS title_id, coalesce(k.service_id, l.service_id) AS service_id, coalesce(k.region, 'A') AS region, coalesce(k.type, l.type) AS type, k.video_quality,
 coalesce(l.link, k.link) AS link, CASE WHEN l.link IS NOT NULL THEN l.expires_on ELSE k.available_from END AS available_from, CASE WHEN l.link IS NOT NULL THEN 'motn' ELSE k.source END AS source
FROM base k FULL JOIN last l ON k.title_id = l.title_id AND k.service_id = l.service_id AND k.region = 'A' AND k.type = l.type AND k.video_quality IS NULL""")
def upcoming_upsert(spark, d):
    rows = offers(spark, d)
    ch = rows.where("l_orderkey % 2 = 1 AND region = 'A'").withColumn("ts", F.col("expires_on"))
    out = changes.apply_upcoming(_base(rows), ch.withColumn("seq", F.struct(*ORDER[:6])), "A")
    return out.select(*changes.KEYS, "link", "available_from", "source")


@query("""SELECT coalesce(s_suppkey, k) AS id, CASE WHEN e.k IS NOT NULL THEN e.user_id ELSE s_nationkey END AS nation FROM (SELECT * FROM supplier WHERE s_suppkey % 2 = 0)
 FULL JOIN (SELECT json_extract(props, '$.k')::BIGINT k, arg_min(user_id, event_id) user_id FROM events GROUP BY 1) e ON k = s_suppkey""")
def seed_missing_services(spark, d):
    dim = read(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("nation"))
    rows = read(spark, d, "events").select(F.get_json_object("props", "$.k").cast("long").alias("id"), F.lit(None).cast("string").alias("name"), F.col("user_id").alias("nation"), "event_id")
    return tables.seed_dimension(dim, rows, "id", "name", ["name", "nation"], ["event_id"]).select("id", "nation")


@query(f"""WITH base AS {_BASE}, b2 AS (SELECT * REPLACE (CASE WHEN service_id='7' AND region='A' THEN 'netflix' ELSE service_id END AS service_id, CASE WHEN service_id='7' AND region='A' THEN 'US' ELSE region END AS region,
  CASE WHEN service_id='7' AND region='A' AND type='F' THEN 'subscription' ELSE type END AS type) FROM base),
 f AS (SELECT p_partkey::VARCHAR title_id, p_partkey video FROM part WHERE p_size > 20)
SELECT coalesce(b.title_id, f.title_id) AS title_id, coalesce(b.service_id,'netflix') AS service_id, coalesce(b.region,'US') AS region, coalesce(b.type,'subscription') AS type, b.video_quality,
 CASE WHEN f.title_id IS NOT NULL AND (b.title_id IS NULL OR b.source='discovery') THEN 'https://www.netflix.com/title/' || video ELSE link END AS link,
 CASE WHEN b.title_id IS NULL THEN 'discovery' ELSE b.source END AS source
FROM b2 b FULL JOIN f ON b.title_id=f.title_id AND b.service_id='netflix' AND b.region='US' AND b.type='subscription' AND b.video_quality IS NULL""")
def discovery_upsert(spark, d):
    base = _base(offers(spark, d))
    own = (F.col("service_id") == "7") & (F.col("region") == "A") & (F.col("type") == "F")
    base = as_watched(base.withColumn("type", F.when(own, audit.WATCH).otherwise(F.col("type"))))
    found = read(spark, d, "part").where("p_size > 20").select(F.col("p_partkey").cast("string").alias("title_id"), F.col("p_partkey").alias("video_id"), F.lit(0).alias("seq"))
    out = audit.discovery_upsert(base, found, ts("2000-01-01 00:00:00"))
    return out.select(*changes.KEYS, "link", "source")


def _change_batch(spark, d):
    """Events as a change batch over titles by user: a fourth removes, a fourth expires, half carry payloads."""
    kind = F.when(F.col("event_id") % 4 == 0, "removed").when(F.col("event_id") % 4 == 1, "expiring").otherwise("updated")
    number = F.get_json_object("props", "$.k").cast("long")
    return read(spark, d, "events").select(
        F.col("event_id").alias("seq"), kind.alias("kind"), F.col("user_id").cast("string").alias("title_id"), number.cast("string").alias("service_id"),
        F.when(F.col("event_id") % 3 == 0, "F").otherwise("O").alias("type"), "ts", number.alias("k"), "value",
    )


@query("""WITH ev AS (SELECT event_id seq, CASE event_id % 4 WHEN 0 THEN 'removed' WHEN 1 THEN 'expiring' ELSE 'updated' END kind, user_id::VARCHAR title_id,
  json_extract(props,'$.k')::VARCHAR service_id, CASE WHEN event_id % 3 = 0 THEN 'F' ELSE 'O' END AS type, ts, json_extract(props,'$.k')::BIGINT k, value FROM events),
 opt AS (SELECT seq, title_id, service_id, type, CASE WHEN k % 2 = 0 THEN NULL ELSE 'hd' END q, '/title/' || seq link, ts AS expires_on FROM ev WHERE kind = 'updated'),
 base AS (SELECT DISTINCT title_id, service_id, type, q, 'motn' source, '/old/' || title_id link FROM opt WHERE seq % 2 = 0),
 r AS (SELECT title_id, max(seq) swap FROM opt GROUP BY 1),
 rem AS (SELECT title_id, service_id, type, min(seq) fr, max(seq) lr FROM ev WHERE kind = 'removed' GROUP BY ALL),
 ex AS (SELECT title_id, service_id, type, arg_max(ts, seq) ets, max(seq) es FROM ev WHERE kind = 'expiring' GROUP BY ALL),
 fresh AS (SELECT o.*, swap FROM opt o JOIN r ON r.title_id = o.title_id AND r.swap = o.seq)
SELECT f.title_id, f.service_id, f.type, f.q AS video_quality, f.link, CASE WHEN es > swap THEN ets ELSE f.expires_on END AS expires_on, 'motn' AS source
FROM fresh f LEFT JOIN rem ON rem.title_id = f.title_id AND rem.service_id = f.service_id AND rem.type = f.type
 LEFT JOIN ex ON ex.title_id = f.title_id AND ex.service_id = f.service_id AND ex.type = f.type
WHERE lr IS NULL OR lr < swap
UNION ALL
SELECT b.title_id, b.service_id, b.type, b.q, b.link, ets, 'motn' FROM base b LEFT JOIN rem ON rem.title_id = b.title_id AND rem.service_id = b.service_id AND rem.type = b.type
 LEFT JOIN ex ON ex.title_id = b.title_id AND ex.service_id = b.service_id AND ex.type = b.type WHERE b.title_id NOT IN (SELECT title_id FROM r) AND lr IS NULL""")
def change_replay(spark, d):
    ev = _change_batch(spark, d)
    quality = F.when(F.col("k") % 2 == 0, F.lit(None).cast("string")).otherwise("hd")
    none = F.lit(None).cast("string")
    opt = ev.where("kind = 'updated'").select(
        "seq", "title_id", F.lit(0).alias("pos"), "service_id", "type", quality.alias("video_quality"), F.concat(F.lit("/title/"), "seq").alias("link"), none.alias("deep_link"),
        F.lit(None).cast("decimal(8,2)").alias("price_amount"), none.alias("price_currency"), F.col("ts").alias("expires_on"),
    )
    stored = opt.where("seq % 2 = 0").select("title_id", "service_id", F.lit("US").alias("region"), "type", "video_quality").distinct()
    stored = stored.select("*", F.concat(F.lit("/old/"), "title_id").alias("link"), none.alias("deep_link"), F.lit(None).cast("decimal(8,2)").alias("price_amount"), none.alias("price_currency"), F.lit(None).cast("timestamp_ntz").alias("expires_on"), F.lit(None).cast("timestamp_ntz").alias("available_from"), F.lit("motn").alias("source"))
    out = changes.apply_changes(stored, ev, opt.select("seq", "title_id"), opt)
    return out.select("title_id", "service_id", "type", "video_quality", "link", "expires_on", "source")


# Matching

_NORM = "regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g')"


@query(f"""WITH t AS (SELECT p_partkey id, p_type ty, {_NORM} n, p_size y FROM part), q AS (SELECT * FROM t WHERE id % 4 = 0),
 c AS (SELECT q.id qid, t.id tid, abs(t.y - q.y) dist FROM q JOIN t ON t.ty = q.ty AND t.n = q.n WHERE t.id % 4 <> 0),
 g AS (SELECT qid, count(*) n_exact, min(tid) only_id, min(dist) m FROM c GROUP BY 1)
SELECT g.qid AS query_id, n_exact, CASE WHEN n_exact = 1 THEN only_id ELSE (SELECT CASE WHEN count(*) = 1 THEN min(tid) END FROM c WHERE c.qid = g.qid AND c.dist = g.m) END AS match_id FROM g""")
def exact_nearest_year(spark, d):
    t = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("type"), F.col("p_size").alias("year"))
    out = match.exact_nearest_year(t.where("id % 4 = 0").withColumnRenamed("id", "query_id"), t.where("id % 4 <> 0"))
    return out.select("query_id", F.col("n_exact").cast("long").alias("n_exact"), "match_id")


@query("""WITH w AS (SELECT p_partkey id, p_type ty, string_split(lower(p_name), ' ') p FROM part),
 t AS (SELECT min(id) id, ty, n FROM (SELECT id, ty, p[2] || ' ' || (id % 3) n FROM w) GROUP BY ty, n), q AS (SELECT id qid, ty, array_to_string(p, ' ') || ' ' || (id % 3) qn FROM w),
 c AS (SELECT qid, t.id tid, CASE WHEN len(string_split(qn,' ')) <= len(string_split(n,' ')) THEN qn ELSE n END s, CASE WHEN len(string_split(qn,' ')) <= len(string_split(n,' ')) THEN n ELSE qn END l FROM q JOIN t USING (ty)
  WHERE contains(' ' || n || ' ', ' ' || qn || ' ') OR contains(' ' || qn || ' ', ' ' || n || ' ')),
 ok AS (SELECT * FROM c WHERE length(replace(s,' ','')) * 2 >= length(replace(l,' ','')))
SELECT qid AS query_id, CASE WHEN count(DISTINCT tid) = 1 THEN min(tid) END AS match_id FROM ok GROUP BY 1""")
def subtitle_match(spark, d):
    w = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), F.split(F.lower("p_name"), " ").alias("p"))
    t = w.select("id", "type", F.concat(F.get("p", F.lit(1)), F.lit(" "), (F.col("id") % 3).cast("string")).alias("title")).groupBy("type", "title").agg(F.min("id").alias("id"))
    q = w.select(F.col("id").alias("query_id"), "type", F.concat(F.array_join("p", " "), F.lit(" "), (F.col("id") % 3).cast("string")).alias("title"))
    return match.subtitle_matches(q, t)


@query("""WITH nm AS (SELECT p_partkey pk, p_type ty, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') n FROM part), w AS (SELECT l_orderkey qid, min(l_partkey) pk FROM lineitem GROUP BY 1),
 q AS (SELECT qid, ty, n || CASE qid % 3 WHEN 1 THEN 'extended' WHEN 2 THEN '2' ELSE '' END n FROM w JOIN nm USING (pk)), r AS (SELECT l_orderkey qid, l_linenumber rk, l_partkey vid, ty, n FROM lineitem JOIN nm ON pk = l_partkey),
 c AS (SELECT qid, vid, rk, CASE WHEN q.n = r.n THEN 0 WHEN (contains(q.n, r.n) OR contains(r.n, q.n)) AND least(length(q.n), length(r.n)) * 2 >= greatest(length(q.n), length(r.n))
  AND NOT (starts_with(q.n, r.n) AND regexp_matches(substr(q.n, length(r.n)+1, 1), '[0-9]')) THEN 1 END step FROM q JOIN r USING (qid, ty))
SELECT qid AS query_id, vid AS video_id FROM c WHERE step IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid ORDER BY step, rk, vid) = 1""")
def ranked_search_resolve(spark, d):
    """An order is a search for its least part, as it is called or in another edition; its lines are the ranked results."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("video_id"), F.col("p_name").alias("title"), F.col("p_type").alias("type"))
    li = read(spark, d, "lineitem")
    edition = F.when(F.col("query_id") % 3 == 1, " extended").when(F.col("query_id") % 3 == 2, " 2").otherwise("")
    asked = li.groupBy(F.col("l_orderkey").alias("query_id")).agg(F.min("l_partkey").alias("video_id")).join(p, "video_id")
    results = li.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("video_id")).join(p, "video_id")
    return match.resolve_ranked(asked.select("query_id", F.concat("title", edition).alias("title"), "type"), results)


@query(f"""WITH o AS (SELECT DISTINCT title_id, link, source FROM {OFFERS} WHERE region = 'A' AND service_id = '7' AND source = 'discovery'),
 v AS (SELECT o_orderkey vid, p_partkey m FROM orders LEFT JOIN part ON p_partkey = o_custkey WHERE o_orderstatus <> 'P')
SELECT CASE WHEN vid IS NULL THEN 'unresolved' WHEN m IS NULL THEN 'review' WHEN m::VARCHAR = title_id THEN 'ok' ELSE 'move' END AS class, count(*) AS n
FROM o LEFT JOIN v ON '/title/' || vid = link GROUP BY 1""")
def reconcile_classes(spark, d):
    own = as_watched(offers(spark, d)).select("title_id", "link", "source", "service_id", "region").distinct()
    # a video is called after the customer's number, and titles have numbers as names
    videos = read(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("video_id"), F.concat(F.lit("name "), "o_custkey").alias("title"), F.lit("movie").alias("type"), F.lit(None).cast("int").alias("year"))
    titles = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("name "), "p_partkey").alias("title"), F.lit("movie").alias("type"), F.lit(None).cast("int").alias("year"))
    out = audit.reconcile(own, titles, videos)
    return out.groupBy("class").agg(F.count("*").alias("n"))


@query(f"""WITH f AS (SELECT title_id, bool_or(source='motn') feed, bool_or(source='discovery') found FROM {OFFERS} WHERE region='A' AND service_id='7' GROUP BY 1),
 b AS (SELECT event_id seq, p_partkey::VARCHAR title_id FROM events LEFT JOIN part ON p_partkey = user_id),
 x AS (SELECT b.*, feed, found, min(seq) OVER (PARTITION BY b.title_id) fs FROM b LEFT JOIN f USING (title_id))
SELECT CASE WHEN title_id IS NULL THEN 'unmatched' WHEN coalesce(feed,false) THEN 'skipped' WHEN coalesce(found,false) OR seq <> fs THEN 'restamped' ELSE 'created' END AS outcome, count(*) AS n FROM x GROUP BY 1""")
def discover_counts(spark, d):
    titles = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("name "), "p_partkey").alias("title"), F.lit("movie").alias("type"), F.lit(None).cast("int").alias("year"))
    browse = read(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_id").alias("video_id"), F.concat(F.lit("name "), "user_id").alias("title"), F.lit("movie").alias("type"), F.lit(None).cast("int").alias("year"))
    return audit.discover(as_watched(offers(spark, d)), titles, browse).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT p_partkey::VARCHAR title_id, p_partkey % 100 vid FROM part), lv AS (SELECT user_id vid, max((value)::INT % 120) lvl FROM events WHERE event_type = 'click' GROUP BY 1),
 hit AS (SELECT DISTINCT user_id vid FROM events WHERE event_type = 'purchase') SELECT title_id, CASE WHEN lvl IS NULL THEN NULL WHEN lvl > 100 THEN false ELSE hit.vid IS NOT NULL END AS surfaced
 FROM c LEFT JOIN lv USING (vid) LEFT JOIN hit USING (vid) WHERE title_id NOT IN (SELECT p_partkey::VARCHAR FROM part WHERE p_partkey % 11 = 0)""")
def classify_surfaced(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("title_id"), (F.col("p_partkey") % 100).alias("video_id"))
    e = read(spark, d, "events")
    levels = e.where("event_type = 'click'").select(F.col("user_id").alias("video_id"), (F.rint("value").cast("int") % 120).alias("level"))
    hits = e.where("event_type = 'purchase'").select(F.col("user_id").alias("video_id"))
    failed = p.where(F.col("title_id").cast("long") % 11 == 0)
    return audit.classify(p, levels, hits, failed, 100)
