"""Registered queries of what keeps a catalog in order: moves and fills of found offers, list files, run logs, sketches, exports, sitemaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import audit, changes, reports, tables
from ..operators.graph import new_path
from ..sources import landed
from .catalog import OFFERS, QUERIES, SQL, as_watched, offers, query, read, ts

__all__ = ["QUERIES", "SQL"]

_TITLES = "SELECT p_partkey id, p_partkey::VARCHAR title_id FROM part"
#: One offer for every part that some suppliers have: found by search, or of the feed for every tenth part.
_FOUND = "(SELECT l_partkey id, min(l_orderkey) video, l_partkey % 10 = 0 feed FROM lineitem WHERE l_suppkey <= 40 GROUP BY 1)"


def _found(spark, d) -> DataFrame:
    rows = read(spark, d, "lineitem").where("l_suppkey <= 40").groupBy("l_partkey").agg(F.min("l_orderkey").alias("video"))
    own = {"title_id": F.col("l_partkey").cast("string"), "service_id": F.lit("netflix"), "region": F.lit("US"), "type": F.lit("subscription"), "link": F.concat(F.lit("n/title/"), F.col("video").cast("string")), "source": F.when(F.col("l_partkey") % 10 == 0, "motn").otherwise("discovery")}
    empty = spark.createDataFrame([], changes.OFFER_TYPE)
    return rows.select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema])


def _titles(spark, d) -> DataFrame:
    none = F.lit(None)
    return read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("name "), "p_partkey").alias("title"), F.lit("movie").alias("type"), none.cast("int").alias("year"))


@query(f"""WITH o AS (SELECT * FROM {_FOUND}), v AS (SELECT o.id, m.p_partkey mid FROM o JOIN orders ON o_orderkey = video AND o_orderstatus <> 'P' JOIN part m ON m.p_partkey = o_custkey WHERE NOT feed),
 mv AS (SELECT * FROM v WHERE mid <> id), a AS (SELECT id FROM o WHERE id NOT IN (SELECT id FROM mv) UNION SELECT mid FROM mv)
SELECT title_id, a.id IS NOT NULL AS offered, CASE WHEN t.id NOT IN (SELECT id FROM mv) OR a.id IS NOT NULL THEN t.id % 3 = 0 END AS surfaced FROM ({_TITLES}) t LEFT JOIN a ON a.id = t.id""")
def move_audit(spark, d):
    """Found offers whose video is called like another title move there; titles left without one lose their flag."""
    own = _found(spark, d)
    videos = read(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("video_id"), F.concat(F.lit("name "), "o_custkey").alias("title"), F.lit("movie").alias("type"), F.lit(None).cast("int").alias("year"))
    flags = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("title_id"), (F.col("p_partkey") % 3 == 0).alias("surfaced"), ts("1996-01-01 00:00:00").alias("checked_at"))
    after, flags = audit.apply_moves(own, flags, audit.reconcile(own, _titles(spark, d), videos), ts("1997-01-01 00:00:00"))
    return flags.join(after.select("title_id", F.lit(True).alias("offered")).distinct(), "title_id", "left").select("title_id", F.coalesce("offered", F.lit(False)).alias("offered"), "surfaced")


@query(f"""WITH b AS (SELECT p_partkey id, max(event_id) e FROM events JOIN part ON p_partkey = user_id GROUP BY 1)
SELECT coalesce(o.id, b.id)::VARCHAR AS title_id, CASE WHEN feed OR e IS NULL THEN 'n/title/' || video ELSE 'https://www.netflix.com/title/' || e END AS link, CASE WHEN feed THEN 'motn' ELSE 'discovery' END AS source FROM {_FOUND} o FULL JOIN b ON b.id = o.id""")
def discovery_fill(spark, d):
    """Events as browse rows: each gives its title a found offer, or renews it, unless the feed has one."""
    browse = read(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_id").alias("video_id"), F.concat(F.lit("name "), "user_id").alias("title"), F.lit("movie").alias("type"), F.lit(None).cast("int").alias("year"))
    return audit.discovery_fill(_found(spark, d), _titles(spark, d), browse, ts("1997-01-01 00:00:00")).select("title_id", "link", "source")


@query(f"""WITH t AS (SELECT p_partkey id, CASE WHEN p_partkey % 2 = 1 THEN 0 ELSE 1 END series FROM part WHERE p_size <= 40 AND p_partkey % 7 <> 0 AND p_partkey NOT IN (SELECT id FROM {_FOUND}) AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey > 60)),
 n AS (SELECT t.id, min(o_orderkey) v FROM t JOIN orders ON o_custkey = t.id AND (o_orderkey % 3 = 0) = (series = 1) GROUP BY 1)
SELECT id::VARCHAR AS title_id, 'https://www.netflix.com/title/' || v AS link FROM n UNION ALL SELECT id::VARCHAR, 'n/title/' || video FROM {_FOUND}""")
def backstop_fill(spark, d):
    """Live parts without an offer that others supply: the customer's orders of the same number are the search results."""
    p = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("title_id"), F.concat(F.lit("name "), "p_partkey").alias("title"), F.when(F.col("p_partkey") % 2 == 1, "movie").otherwise("tv").alias("tmdb_type"), F.when(F.col("p_partkey") % 7 == 0, 0).otherwise(1).alias("tmdb_id"), F.when(F.col("p_size") > 40, ts("1996-01-01 00:00:00")).alias("deleted_at"))
    there = read(spark, d, "lineitem").where("l_suppkey > 60").select(F.col("l_partkey").cast("string").alias("title_id")).distinct()
    key = F.col("o_orderkey")
    results = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("query_id"), key.alias("rank"), key.alias("video_id"), F.concat(F.lit("name "), "o_custkey").alias("title"), F.when(key % 3 == 0, "series").otherwise("movie").alias("type"))
    return audit.backstop_fill(_found(spark, d), p, there, results, ts("1997-01-01 00:00:00")).select("title_id", "link")


@query(f"""WITH l AS (SELECT title_id, min(link) link FROM {OFFERS} WHERE service_id = '7' AND region = 'A' AND (available_from IS NULL OR available_from <= TIMESTAMP '1995-06-17') AND (expires_on IS NULL OR expires_on > TIMESTAMP '1995-06-17') GROUP BY 1)
SELECT title_id, link, substr(link, 8)::BIGINT AS video_id FROM l JOIN part ON p_partkey::VARCHAR = title_id WHERE p_partkey % 3 <> 1""")
def verify_due(spark, d):
    """Titles that can be watched and are due for a check: never checked, or lately enough for two thirds of them."""
    checked = F.when(F.col("p_partkey") % 3 == 1, ts("1995-06-10 00:00:00")).when(F.col("p_partkey") % 3 == 2, ts("1995-05-01 00:00:00"))
    titles = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("title_id"), checked.alias("checked_at"))
    out = audit.verify_candidates(titles, as_watched(offers(spark, d)), ts("1995-06-17 00:00:00"))
    return out.select("title_id", "link", F.col("video_id").cast("long").alias("video_id"))


@query("SELECT o_orderpriority AS list_source, o_orderstatus AS list_key, count(*) AS n FROM orders GROUP BY ALL")
def book_status_lists(spark, d):
    held = read(spark, d, "orders").select(F.col("o_orderpriority").alias("list_source"), F.col("o_orderstatus").alias("list_key"))
    log = read(spark, d, "events").select(F.col("event_id").alias("id"), F.lit("{}").alias("metadata"))
    return reports.book_status(log, read(spark, d, "part"), held, F.col("p_size"), None)["lists"]


@query("SELECT c_custkey AS work FROM customer WHERE c_acctbal < 0 OR c_custkey % 3 = 0 OR c_mktsegment = 'BUILDING'")
def missing_fields(spark, d):
    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("work"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("year"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("cover_url"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("description"))
    return rows.where(X.any_null("year", "cover_url", "description")).select("work")


@query("SELECT p_partkey AS year, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN 'winner' ELSE 'honor' END AS kind FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 4 <> 0")
def award_files(spark, d):
    """Parts as award lists, written as JSON arrays and read as files; some entries have a year in words or an unknown type."""
    p, path = read(spark, d, "part"), new_path(spark)
    year = F.when(F.col("p_partkey") % 5 == 0, '"soon"').otherwise(F.col("p_partkey").cast("string"))
    kind = F.when(F.col("p_partkey") % 4 == 0, "runner-up").when(F.col("p_partkey") % 3 == 0, "winner").otherwise("honor")
    entry = F.format_string('{"title":"%s","year":%s,"type":"%s"}', F.col("p_name"), year, kind)
    files = p.groupBy(F.floor(F.col("p_partkey") / 100).alias("file")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(entry), ","), F.lit("]")).alias("value"))
    files.write.partitionBy("file").text(path)
    valid, _ = landed.read_list_file(spark, f"{path}/file=*", "awards")
    return valid.select(F.col("year").cast("long").alias("year"), "title", F.col("type").alias("kind"))


@query("""SELECT 'load' AS sync_type, 'completed' AS status, (SELECT count(*) FROM lineitem) AS processed, 'offers.rows' AS counter, (SELECT count(*) FROM lineitem)::DOUBLE AS n
UNION ALL SELECT 'load', 'completed', (SELECT count(*) FROM lineitem), 'offers.removed', (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT 'load', 'completed', (SELECT count(*) FROM lineitem), 'titles.rows', (SELECT count(*) FROM part)
UNION ALL SELECT 'load', 'completed', (SELECT count(*) FROM lineitem), 'titles.largest', (SELECT max(p_size) FROM part) UNION ALL SELECT 'check', 'completed', NULL, 'late.rows', (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')""")
def run_counters(spark, d):
    """Two logged runs that write tables; what the log holds was counted as it was written."""
    log, out = new_path(spark), new_path(spark)
    li, late = read(spark, d, "lineitem"), read(spark, d, "orders").where("o_orderstatus = 'F'")
    tables.run_logged(spark, log, "load", {"offers": (li, f"{out}/offers"), "titles": (read(spark, d, "part"), f"{out}/titles")}, {"offers": {"removed": F.count_if(F.col("l_returnflag") == "R")}, "titles": {"largest": F.max("p_size")}}, processed="offers")
    tables.run_logged(spark, log, "check", {"late": (late, f"{out}/late")}, {})
    rows = spark.read.parquet(log).select("sync_type", "status", F.col("titles_processed").alias("processed"), F.explode(F.from_json("metadata", "map<string,map<string,double>>")).alias("output", "counts"))
    return rows.select("sync_type", "status", "processed", F.explode("counts").alias("name", "n"), "output").select("sync_type", "status", "processed", F.concat_ws(".", "output", "name").alias("counter"), "n")


@query("""SELECT l_suppkey::VARCHAR AS service_id, count(DISTINCT l_partkey) AS titles, true AS near FROM lineitem GROUP BY 1""")
def service_sketches(spark, d):
    """Titles per service and month as sketches, rolled up to the service: within five per cent of the exact counts."""
    own = offers(spark, d).withColumn("month", F.date_trunc("MONTH", "expires_on"))
    estimate = reports.rolled_up(reports.title_sketches(own, ["service_id", "month"]), ["service_id"]).withColumnRenamed("titles", "estimate")
    exact = own.groupBy("service_id").agg(F.countDistinct("title_id").alias("titles"))
    return exact.join(estimate, "service_id").select("service_id", "titles", (F.abs(F.col("estimate") - F.col("titles")) <= 0.05 * F.col("titles")).alias("near"))


@query("""SELECT to_json({'ids': (SELECT list_sort(list(DISTINCT l_partkey)) FROM lineitem WHERE l_suppkey <= 50), 'surfaced': (SELECT list_sort(list(DISTINCT p_partkey)) FROM part WHERE p_size > 25)})::VARCHAR AS document""")
def availability_files(spark, d):
    """The export as files of ranges of ids, joined again in the order of their names."""
    path = new_path(spark)
    ids = read(spark, d, "lineitem").where("l_suppkey <= 50").select(F.col("l_partkey").alias("id"))
    tables.write_availability(ids, read(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("id")), "id", path, parts=16)
    files = spark.read.text([f"{path}/1-body", f"{path}/2-end"], wholetext=True).select(F.col("_metadata.file_path").alias("name"), "value")
    return files.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "value"))), lambda x: x["value"]), "").alias("document"))


@query("""SELECT DISTINCT url FROM pages WHERE url LIKE '%/en/%' AND (page_id // 50) % 4 <> 1""")
def sitemap_urls(spark, d):
    """Page urls in sitemaps of fifty, four of which an index names, and an index of these: every fourth sitemap lacks the marker or was never landed."""
    escaped = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    wrap = lambda outer, inner, rows: F.concat(F.lit(f"<?xml version='1.0'?><{outer}>"), F.array_join(F.collect_list(F.concat(F.lit(f"<{inner}><loc> "), rows, F.lit(f"</loc></{inner}>"))), ""), F.lit(f"</{outer}>"))
    named = lambda part, n: F.concat(F.lit("http://maps/"), F.when(part % 4 == 1, F.when(part % 8 == 1, "other").otherwise("page-lost")).otherwise("page"), F.lit(f"-{n}-"), part.cast("string"), F.lit(".xml"))
    part, group = F.floor(F.col("page_id") / 50), F.floor(F.col("part") / 4)
    maps = read(spark, d, "pages").where("url IS NOT NULL").groupBy(part.alias("part")).agg(wrap("urlset", "url", escaped).alias("body")).withColumn("url", named(F.col("part"), "map"))
    middle = maps.groupBy(group.alias("group")).agg(wrap("sitemapindex", "sitemap", F.col("url")).alias("body")).withColumn("url", F.concat(F.lit("http://maps/page-index-"), F.col("group").cast("string")))
    top = middle.agg(wrap("sitemapindex", "sitemap", F.col("url")).alias("body")).withColumn("url", F.lit("http://maps/index.xml"))
    files = maps.where("url NOT LIKE '%lost%'").select("url", "body").union(middle.select("url", "body")).union(top.select("url", "body"))
    return landed.sitemap_tree(files, ["http://maps/index.xml"], "/en/", marker="/page")[0]
