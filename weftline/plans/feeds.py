"""Registered queries of landed feeds, reviews and enrichment: payloads are written from the driver's tables as JSON or HTML and go through the library's own readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import audit, changes, enrich, ingest, reports, store, works
from ..operators.graph import new_path
from ..sources import landed
from ..streaming import streams
from .catalog import OFFERS, QUERIES, SQL, as_watched, offers, query, read, ts

__all__ = ["QUERIES", "SQL"]


def _key() -> Column:
    return F.col("p_partkey").cast("string")


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def _named(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _show_pages(spark, d) -> DataFrame:
    """A page for every part, with the part as its one show; every fifth has a long title, every third no large poster."""
    part = read(spark, d, "part")
    title = F.when(F.col("p_partkey") % 5 == 0, F.repeat(F.concat("p_name", F.lit(" ")), 40)).otherwise(F.col("p_name"))
    poster = _named(w480=F.concat(F.lit("small/"), _key()), w720=F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("large/"), _key())))
    outside = F.when(F.col("p_partkey") % 7 == 0, _key()).otherwise(F.concat(F.when(F.col("p_size") > 25, "tv/").otherwise("movie/"), _key()))
    show = _named(
        imdbId=F.concat(F.lit("tt"), _key()), tmdbId=outside, showType=F.when(F.col("p_size") > 25, "series"), title=title, releaseYear=F.col("p_size") + 1970,
        genres=F.array(_named(name=F.col("p_type"))), imageSet=_named(verticalPoster=poster),
    )
    page = part.select(F.col("p_brand").alias("page"), _json(shows=F.create_map(_key(), show)).alias("body"))
    return page.select("page", F.from_json("body", landed.PAGE_TYPE).alias("v")).select("page", "v.*")


@query("""SELECT p_partkey::VARCHAR AS title_id, 'tt' || p_partkey AS imdb_id, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_size > 25 THEN 'tv' ELSE 'movie' END AS tmdb_type,
 CASE WHEN p_partkey % 7 <> 0 THEN p_partkey END AS tmdb_id, CASE WHEN p_size > 25 THEN 'series' ELSE 'movie' END AS show_type,
 substr(CASE WHEN p_partkey % 5 = 0 THEN repeat(p_name || ' ', 40) ELSE p_name END, 1, 500) AS title, p_size + 1970 AS release_year, p_type AS genre,
 CASE WHEN p_partkey % 3 <> 0 THEN 'large/' ELSE 'small/' END || p_partkey AS poster_url FROM part""")
def feed_titles(spark, d):
    shows = landed.flatten_shows(_show_pages(spark, d))
    return shows.select("title_id", "imdb_id", "tmdb_type", "tmdb_id", "show_type", "title", "release_year", F.get("genres", F.lit(0)).alias("genre"), "poster_url")


def _offer_pages(spark, d) -> DataFrame:
    """A page for every order, with its lines' parts as shows and the lines as their options."""
    li = read(spark, d, "lineitem")
    option = _named(
        service=_named(id=F.col("l_suppkey").cast("string"), name=F.concat(F.lit("service "), "l_suppkey")), type=F.col("l_linestatus"), quality=F.nullif("l_linenumber", F.lit(1)).cast("string"),
        link=F.concat(F.lit("/title/"), "l_orderkey"), price=_named(amount=F.format_string("%.2f", "l_extendedprice"), currency=F.lit("USD")), expiresOn=F.unix_timestamp(F.col("l_shipdate").cast("timestamp")),
    )
    rows = li.groupBy("l_orderkey", "l_partkey").agg(F.collect_list(F.struct("l_linenumber", option.alias("o"))).alias("o"))
    show = _named(streamingOptions=_named(us=F.transform(F.array_sort("o"), lambda x: x["o"])))
    pages = rows.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct(F.col("l_partkey").cast("string"), show))).alias("shows"))
    body = pages.select(F.col("l_orderkey").cast("string").alias("page"), _json(shows=F.col("shows")).alias("body"))
    return body.select("page", F.from_json("body", landed.PAGE_TYPE).alias("v")).select("page", "v.*")


@query("""SELECT l_orderkey::VARCHAR AS page, l_partkey::VARCHAR AS title_id, l_suppkey::VARCHAR AS service_id, l_linestatus AS type, nullif(l_linenumber, 1)::VARCHAR AS video_quality, '/title/' || l_orderkey AS link,
 round(l_extendedprice, 2) AS price, epoch(l_shipdate)::BIGINT AS expires_on FROM lineitem""")
def feed_offers(spark, d):
    rows = landed.flatten_offers(_offer_pages(spark, d))
    return rows.select("page", "title_id", "service_id", "type", "video_quality", "link", F.col("price_amount").cast("double").alias("price"), F.unix_timestamp("expires_on").alias("expires_on"))


@query("""SELECT l_suppkey::VARCHAR AS id, 'service ' || l_suppkey AS name, count(*) AS options FROM lineitem GROUP BY 1, 2""")
def feed_services(spark, d):
    return landed.payload_services(_offer_pages(spark, d)).groupBy("id", "name").agg(F.count("*").alias("options"))


@query(f"""WITH g AS (SELECT title_id, service_id, max(n) n FROM (SELECT title_id, service_id, type, coalesce(video_quality, '') q, count(*) n FROM {OFFERS} GROUP BY ALL HAVING count(*) > 1) GROUP BY 1, 2)
SELECT title_id, string_agg(service_id || '=' || n, ',' ORDER BY service_id) AS umbrella FROM g GROUP BY 1""")
def umbrella_services(spark, d):
    rows = changes.umbrella_map(offers(spark, d))
    return rows.select("title_id", F.array_join(F.transform(F.map_entries("umbrella_services"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("umbrella"))


@query(f"""WITH pay AS (SELECT *, row_number() OVER (PARTITION BY title_id, service_id, type, video_quality ORDER BY l_orderkey DESC, l_linenumber DESC, l_quantity DESC, price_amount DESC) k FROM {OFFERS})
SELECT p.title_id, p.service_id, p.type, p.video_quality, link, 'service ' || p.service_id AS service,
 substr(CASE WHEN p_partkey % 5 = 0 THEN repeat(p_name || ' ', 40) ELSE p_name END, 1, 500) AS title FROM pay p JOIN part ON p_partkey::VARCHAR = p.title_id WHERE k = 1""")
def catalog_load(spark, d):
    """A full load: services are seeded, titles set and offers replaced from the pages, over tables that are empty."""
    pages = _offer_pages(spark, d)
    shows = landed.flatten_shows(_show_pages(spark, d))
    none = lambda fields: spark.createDataFrame([], fields)
    titles, services, out = changes.load_catalog(
        none("title_id string, title string"), none("id string, name string"), none(changes.OFFER_TYPE), shows, landed.payload_services(pages),
        landed.flatten_offers(pages).withColumn("pos", F.struct(F.col("page").cast("long"), "pos", F.lit(0))),
    )
    out = out.join(services.select(F.col("id").alias("service_id"), F.col("name").alias("service")), "service_id").join(titles, "title_id")
    return out.select("title_id", "service_id", "type", "video_quality", "link", "service", "title")


def _landed(spark, rows: DataFrame, parts: list[Column]) -> str:
    """The rows as files of a feed's folder, one after the other; conditions say which rows each file has."""
    folder = new_path(spark)
    for part in parts:
        rows.where(part).coalesce(1).write.mode("append").parquet(folder)
    return folder


@query(SQL["change_replay"])
def stream_change_apply(spark, d):
    """The change feed as a stream of files applied to a keyed table, batch by batch; the second file comes twice, as overlapping reads do. The table is that of ``change_replay``."""
    root, state = new_path(spark), new_path(spark)
    none, when = F.lit(None).cast("string"), F.lit(None).cast("timestamp_ntz")
    kind = F.when(F.col("event_id") % 4 == 0, "removed").when(F.col("event_id") % 4 == 1, "expiring").otherwise("updated")
    number = F.get_json_object("props", "$.k").cast("long")

    def batch(events: DataFrame) -> DataFrame:
        return events.select("event_id", F.col("event_id").alias("seq"), kind.alias("kind"), F.col("user_id").cast("string").alias("title_id"), number.cast("string").alias("service_id"), F.when(F.col("event_id") % 3 == 0, "F").otherwise("O").alias("type"), F.col("ts").cast("timestamp_ntz").alias("ts"), number.alias("k"))

    def options(rows: DataFrame) -> DataFrame:
        return rows.where("kind = 'updated'").select(
            "seq", "title_id", F.lit(0).alias("pos"), "service_id", "type", F.when(F.col("k") % 2 != 0, "hd").alias("video_quality"), F.concat(F.lit("/title/"), "seq").alias("link"), none.alias("deep_link"),
            F.lit(None).cast("decimal(8,2)").alias("price_amount"), none.alias("price_currency"), F.col("ts").alias("expires_on"),
        )

    events = read(spark, d, "events")
    stored = options(batch(events)).where("seq % 2 = 0").select("title_id", "service_id", F.lit("US").alias("region"), "type", "video_quality").distinct()
    stored = stored.select("*", F.concat(F.lit("/old/"), "title_id").alias("link"), none.alias("deep_link"), F.lit(None).cast("decimal(8,2)").alias("price_amount"), none.alias("price_currency"), when.alias("expires_on"), when.alias("available_from"), F.lit("motn").alias("source"))
    table = store.KeyedStore.create(stored, root, ["title_id"], buckets=16)

    def apply(held: DataFrame, rows: DataFrame) -> DataFrame:
        own = options(rows)
        return changes.apply_changes(held, rows, own.select("seq", "title_id"), own)

    third = events.agg((F.max("event_id") / 3).cast("long")).first()[0]
    at = F.col("event_id")
    feed = _landed(spark, events, [at <= third, (at > third) & (at <= 2 * third), (at > third) & (at <= 2 * third), at > 2 * third])
    rows = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(feed)
    rows = batch(rows).withColumn("at", F.col("ts").cast("timestamp"))
    streams.apply_stream(rows, table, apply, state, ["event_id"], ts="at", late="2000 days").awaitTermination()
    return store.KeyedStore(spark, root).read().select("title_id", "service_id", "type", "video_quality", "link", "expires_on", "source")


@query("SELECT DISTINCT url FROM pages WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM pages WHERE page_id % 5 = 0 AND url IS NOT NULL)")
def stream_new_urls(spark, d):
    """Page urls as a feed of three overlapping files; every fifth page is known before. What the sink gets, once each."""
    pages, out = read(spark, d, "pages").select("page_id", "url"), new_path(spark)
    root, state = new_path(spark), new_path(spark)
    known = streams.KnownUrls.create(pages.where("page_id % 5 = 0"), root, blocks=1 << 12, buckets=16)
    at = F.col("page_id") % 3
    feed = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(_landed(spark, pages, [at != 2, at != 0, at != 1]))
    streams.new_urls(feed, known, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), state).awaitTermination()
    return spark.read.schema("url string").parquet(f"{out}/batch=*").select("url")


@query("SELECT CASE event_id % 4 WHEN 0 THEN 'removed' WHEN 1 THEN 'expiring' ELSE 'updated' END AS kind, count(*) AS n, count(*) FILTER (WHERE user_id % 10 = 0) AS failures FROM events GROUP BY 1")
def change_run_counts(spark, d):
    kind = F.when(F.col("event_id") % 4 == 0, "removed").when(F.col("event_id") % 4 == 1, "expiring").otherwise("updated")
    rows = read(spark, d, "events").select(kind.alias("kind"), F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("title_id"))
    return changes.change_counts(rows, failed=F.col("title_id").isNull())


@query("""SELECT e.event_id AS seq, user_id::VARCHAR AS title_id, strftime(e.ts, '%Y-%m-%d %H:%M:%S') AS ts, p_partkey IS NOT NULL AS has_show FROM events e LEFT JOIN part ON p_partkey = user_id AND p_size > 25""")
def change_show_lookup(spark, d):
    """Events as the changes of a page each, which brings the show along if the user's number is that of a large part."""
    e = read(spark, d, "events")
    known = read(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("user_id"), F.lit(True).alias("large"))
    change = _named(showId=F.col("user_id").cast("string"), timestamp=F.unix_timestamp(F.col("ts").cast("timestamp")), streamingOptionType=F.lit("subscription"))
    shows = F.create_map(F.when(F.col("large"), F.col("user_id").cast("string")).otherwise("other"), _named(title=F.lit("a show")))
    body = e.join(known, "user_id", "left").select(F.col("event_id").cast("string").alias("page"), _json(changes=F.array(change), shows=shows).alias("body"))
    pages = body.select("page", F.from_json("body", landed.PAGE_TYPE).alias("v")).select("page", "v.*")
    out = changes.with_shows(landed.flatten_changes(pages), landed.flatten_shows(pages))
    return out.select(F.col("page").cast("long").alias("seq"), "title_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "has_show")


# Review pages, lists, volumes and editions


@query("""SELECT 'u' || p_partkey AS url, CASE WHEN p_partkey % 3 = 0 THEN 'Heading ' || p_partkey ELSE p_name END AS title, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS author, p_size AS min_age FROM part WHERE p_partkey % 6 <> 3""")
def review_metadata(spark, d):
    """Parts as review pages with JSON-LD: some books are named only by the page's heading, some by nothing."""
    book = _named(name=F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")), author=F.when(F.col("p_partkey") % 4 != 0, _named(name=F.col("p_brand"))))
    node = F.concat(F.lit('{"@graph":[{"@type":"WebPage"},'), _json(itemReviewed=book, typicalAgeRange=F.concat(F.col("p_size").cast("string"), F.lit("+"))), F.lit("]}"))
    heading = F.when(F.col("p_partkey") % 6 == 0, F.concat(F.lit("<meta property='og:title' content='Heading "), _key(), F.lit(" Book Review | Site'>"))).otherwise("")
    html = F.concat(heading, F.lit("<script type='application/ld+json'>"), node, F.lit("</script>"))
    pages = read(spark, d, "part").select(F.concat(F.lit("u"), _key()).alias("url"), html.alias("html"))
    return landed.extract_jsonld_reviews(pages).select("url", "title", "author", "min_age")


@query("""SELECT 'u' || p_partkey AS url, p_name AS title, CASE WHEN p_partkey % 4 <> 1 THEN p_brand END AS author, p_size % 20 AS min_age FROM part WHERE p_partkey % 4 <> 0""")
def review_bylines(spark, d):
    byline = F.when(F.col("p_partkey") % 4 == 0, "None").when(F.col("p_partkey") % 4 == 1, "12 books").otherwise(F.col("p_brand"))
    item = lambda text: F.concat(F.lit('<li class="x post-info y"><b>'), text, F.lit("</b></li>"))
    html = F.concat(F.lit("<h1>"), "p_name", F.lit("</h1>"), item(F.lit("Book Review")), item(byline), item(F.lit("Publisher")), item(F.concat((F.col("p_size") % 20).cast("string"), F.lit(" years old and up"))))
    return landed.extract_byline_reviews(read(spark, d, "part").select(F.concat(F.lit("u"), _key()).alias("url"), html.alias("html"))).select("url", "title", "author", "min_age")


@query("""SELECT array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title, p_brand AS author, p_size AS rank, CASE WHEN p_size > 25 THEN 12 ELSE 4 END AS min_age,
 CASE WHEN p_size > 25 THEN 'young-adult-hardcover' ELSE 'picture-books' END AS list_key, '2024-01-' || lpad((1 + p_partkey % 28)::VARCHAR, 2, '0') AS published FROM part""")
def bestseller_books(spark, d):
    book = _named(rank=F.col("p_size"), title=F.upper("p_name"), author=F.col("p_brand"), primary_isbn13=F.lit(""), book_image=F.lit(" "))
    day = F.concat(F.lit("2024-01-"), F.lpad((1 + F.col("p_partkey") % 28).cast("string"), 2, "0"))
    results = _named(list_name_encoded=F.when(F.col("p_size") > 25, "young-adult-hardcover").otherwise("picture-books"), published_date=day, books=F.array(book))
    pages = read(spark, d, "part").select(F.from_json(_json(status=F.lit("OK"), results=results), landed.BESTSELLER_TYPE).alias("v")).select("v.*")
    out = landed.bestseller_items(pages)
    return out.select("title", "author", "rank", "min_age", "list_key", F.date_format("as_of_date", "yyyy-MM-dd").alias("published"))


@query("""SELECT p_partkey::VARCHAR AS isbn, 'v' || p_partkey AS google_books_id, nullif(p_size % 5, 0) AS page_count, 1990 + p_size % 30 AS year, 'https://img/' || p_partkey AS cover_url,
 CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS preview_available FROM part""")
def volume_fields(spark, d):
    info = _named(pageCount=F.col("p_size") % 5, publishedDate=F.concat((1990 + F.col("p_size") % 30).cast("string"), F.lit("-05")), imageLinks=_named(thumbnail=F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("http://img/"), _key())), smallThumbnail=F.concat(F.lit("https://img/"), _key())),
                  description=F.col("p_name"), categories=F.array("p_type"))
    view = F.when(F.col("p_partkey") % 3 == 0, "PARTIAL").when(F.col("p_partkey") % 3 == 1, "NO_PAGES").otherwise("UNKNOWN")
    rows = read(spark, d, "part").select(_key().alias("isbn"), _named(id=F.concat(F.lit("v"), _key()), volumeInfo=info, accessInfo=_named(viewability=view)).alias("v"))
    return landed.volume_columns(rows).select("isbn", "google_books_id", "page_count", "year", "cover_url", "preview_available")


@query(("""SELECT 'OL' || p_partkey || 'W' AS work_key, CASE WHEN p_partkey % 2 = 0 AND p_partkey > 0 THEN 'COVERS' || p_partkey || '-L.jpg' END AS cover_url, ['97803064' || lpad((p_partkey % 100)::VARCHAR, 2, '0') || '157'] AS isbn13s FROM part""").replace("COVERS", landed.COVERS))
def edition_fields(spark, d):
    isbn = F.concat(F.lit("97803064"), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"), F.lit("157"))
    covers = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit(-1).cast("long"), F.col("p_partkey"))).otherwise(F.array(F.lit(-1).cast("long")))
    e = _named(works=F.array(_named(key=F.concat(F.lit("/works/OL"), _key(), F.lit("W")))), isbn_13=F.array(isbn, isbn), isbn_10=F.array(F.lit("bad")), covers=covers)
    return landed.edition_columns(read(spark, d, "part").select(e.alias("e")))


@query("""WITH p AS (SELECT p_partkey k, p_size s, p_brand b FROM part) SELECT k AS part, CASE WHEN k % 3 = 0 THEN b WHEN k % 3 = 1 THEN 'other' ELSE 'NR' END AS movie, CASE WHEN s > 25 THEN 'TV-' || s ELSE 'NR' END AS tv,
 CASE k % 4 WHEN 0 THEN 'https://www.youtube.com/watch?v=official' WHEN 1 THEN 'https://www.youtube.com/watch?v=trailer' WHEN 2 THEN 'https://www.youtube.com/watch?v=clip' END AS trailer, s IN (8, 9) AS on_service FROM p""")
def media_picks(spark, d):
    """Certification, trailer and provider of payloads written from parts."""
    k, s = F.col("p_partkey"), F.col("p_size")
    release = lambda kind, text: _named(type=F.lit(kind), certification=text)
    dates = F.when(k % 3 == 0, F.array(release(1, F.lit("other")), release(3, F.col("p_brand")))).when(k % 3 == 1, F.array(release(3, F.lit("")), release(4, F.lit("other")))).otherwise(F.array(release(3, F.lit(""))))
    movie = F.array(_named(iso_3166_1=F.lit("DE"), release_dates=F.array(release(3, F.lit("16")))), _named(iso_3166_1=F.lit("US"), release_dates=dates))
    tv = F.array(_named(iso_3166_1=F.when(s > 25, "US").otherwise("DE"), rating=F.concat(F.lit("TV-"), s.cast("string"))))
    video = lambda key, kind, official, site="YouTube": _named(key=F.lit(key), type=F.lit(kind), official=F.lit(official), site=F.lit(site))
    clip, trailer, own, other = video("clip", "Clip", True), video("trailer", "Trailer", False), video("official", "Trailer", True), video("else", "Trailer", True, "Vimeo")
    videos = F.when(k % 4 == 0, F.array(other, clip, trailer, own)).when(k % 4 == 1, F.array(other, clip, trailer)).when(k % 4 == 2, F.array(other, clip)).otherwise(F.array(other))
    us = _named(flatrate=F.array(_named(provider_id=s)), ads=F.lit(None).cast("array<struct<provider_id:int>>"), flatrate_and_buy=F.array(_named(provider_id=s - 1)))
    m, t = X.certification(movie, tv)
    return read(spark, d, "part").select(k.alias("part"), m.alias("movie"), t.alias("tv"), X.trailer_url(videos).alias("trailer"), X.on_provider(us).alias("on_service"))


@query("""SELECT event_id AS body_id, user_id AS video_id, event_type AS type, 'name ' || user_id AS title, CASE WHEN event_id % 3 <> 0 THEN (event_id % 120)::INT END AS maturity FROM events
UNION ALL SELECT event_id, event_id, 'more', 'second', 7 FROM events""")
def answer_entities(spark, d):
    one = F.concat(F.lit("noise {"), "user_id", F.lit("|"), "event_type", F.lit("| name "), "user_id", F.lit(" |"), F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 120).cast("string")).otherwise(""), F.lit("} "))
    two = F.concat(F.lit("{"), "event_id", F.lit("|more|second|7}"))
    return landed.text_entities(read(spark, d, "events").select(F.col("event_id").alias("body_id"), F.concat(one, two).alias("body")), r"\{([0-9]+)\|([a-z_]+)\|([^|]*)\|([0-9]*)\}")


@query("""SELECT event_id AS video_id, 'name ' || user_id AS title, CASE WHEN event_id % 2 = 0 THEN 2001 END AS year, CASE WHEN event_id % 3 = 0 THEN user_id::INT END AS level FROM events WHERE event_id % 5 <> 0""")
def answer_videos(spark, d):
    video = _named(title=F.when(F.col("event_id") % 5 == 0, " ").otherwise(F.concat(F.lit("name "), "user_id")), releaseYear=F.when(F.col("event_id") % 2 == 0, 2001), maturity=F.when(F.col("event_id") % 3 == 0, _named(level=F.col("user_id"))))
    return landed.graph_answers(read(spark, d, "events").select(_json(videos=F.create_map(F.col("event_id").cast("string"), video)).alias("body")))


@query(r"""SELECT page_id, lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)) AS host, string_split(url, '/')[-1] AS base, try_cast(nullif(regexp_extract(url, '/([0-9]{4})[0-9]*$', 1), '') AS INT) AS year FROM pages""")
def url_parts(spark, d):
    tail = F.regexp_extract("url", "/([0-9]{4,})$", 1)
    return read(spark, d, "pages").select("page_id", X.host(F.col("url")).alias("host"), X.basename(F.col("url")).alias("base"), X.leading_year(tail).alias("year"))


@query("""SELECT o_orderkey AS id, nullif(CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END, '') AS note, try_cast(nullif(regexp_extract(o_orderpriority, '^\\s*([0-9]{1,2})', 1), '') AS INT) AS age FROM orders WHERE o_orderstatus <> 'F' ORDER BY 1""")
def pending_rows(spark, d):
    """Orders that aren't finished wait, in order; blank notes are null, and a priority's number is read as an age."""
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("done"), F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderpriority")).alias("note"), "o_orderpriority")
    return enrich.pending(rows, "done", "id").select("id", X.blank_to_null(F.col("note")).alias("note"), X.leading_age(F.col("o_orderpriority")).alias("age"))


# Enrichment and repair


@query("""WITH e AS (SELECT l_partkey::VARCHAR isbn, 'K' || min(l_suppkey) k, 'c' || min(l_suppkey) c FROM lineitem GROUP BY 1),
 w AS (SELECT p_partkey work, CASE WHEN p_size > 25 THEN 'K' || (p_partkey % 200) || CASE WHEN p_partkey > 200 THEN 'x' ELSE '' END END k, CASE WHEN p_partkey % 3 = 0 THEN 'own' END c FROM part),
 f AS (SELECT work, w.k, w.c, e.k ek, e.c ec FROM w LEFT JOIN e ON w.k IS NULL AND isbn = work::VARCHAR),
 first AS (SELECT ek, min(work) work FROM f WHERE ek IS NOT NULL AND ek NOT IN (SELECT k FROM w WHERE k IS NOT NULL) GROUP BY 1),
 s AS (SELECT f.*, coalesce(f.k, CASE WHEN first.work = f.work THEN f.ek END) key FROM f LEFT JOIN first ON first.ek = f.ek),
 l AS (SELECT 'K' || l_suppkey k, l_orderkey o, l_linenumber n, CASE WHEN l_linenumber = 3 THEN 'p' || l_orderkey END c, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) r FROM lineitem),
 g AS (SELECT k, string_agg('o' || o, ',' ORDER BY m) isbns FROM (SELECT k, o, min(r) m FROM l WHERE r <= 6 GROUP BY 1, 2) GROUP BY 1), h AS (SELECT k, arg_min(c, r) c FROM l WHERE r <= 6 AND c IS NOT NULL GROUP BY 1)
SELECT work, key AS work_key, concat_ws(',', work::VARCHAR, 'more' || ek, g.isbns) AS isbns, coalesce(s.c, ec, h.c) AS cover_url FROM s LEFT JOIN g ON g.k = key LEFT JOIN h ON h.k = key""")
def edition_pass(spark, d):
    """Parts as works, some with a key and a cover: editions give keys to those without; keys, old and new, give the ISBNs and the cover of their first two pages of three editions."""
    li = read(spark, d, "lineitem")
    e = li.groupBy(F.col("l_partkey").cast("string").alias("isbn")).agg(F.min("l_suppkey").cast("string").alias("s"))
    editions = e.select("isbn", F.concat(F.lit("K"), "s").alias("work_key"), F.array(F.concat(F.lit("moreK"), "s")).alias("isbn13s"), F.concat(F.lit("c"), "s").alias("cover_url"))
    own_key = F.concat(F.lit("K"), (F.col("p_partkey") % 200).cast("string"), F.when(F.col("p_partkey") > 200, "x").otherwise(""))
    held = read(spark, d, "part").select(F.col("p_partkey").alias("work"), F.when(F.col("p_size") > 25, own_key).alias("work_key"), F.array(_key()).alias("isbn13s"), F.when(F.col("p_partkey") % 3 == 0, "own").alias("cover_url"))
    nth = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber")) - 1
    listings = li.select(
        F.concat(F.lit("K"), F.col("l_suppkey").cast("string")).alias("work_key"), F.floor(nth / 3).alias("page"), (nth % 3).alias("pos"), F.array(F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))).alias("isbn13s"),
        F.when(F.col("l_linenumber") == 3, F.concat(F.lit("p"), F.col("l_orderkey").cast("string"))).alias("cover_url"),
    )
    return enrich.stamp_editions(held, editions, listings)[0].select("work", "work_key", F.array_join("isbn13s", ",").alias("isbns"), "cover_url")


@query("""WITH w AS (SELECT DISTINCT o_custkey k FROM orders WHERE o_orderstatus = 'P') SELECT c_custkey::VARCHAR AS title_id, CASE WHEN k IS NOT NULL AND c_custkey % 5 <> 0 THEN TIMESTAMP '2000-01-01' END AS deleted_at FROM customer LEFT JOIN w ON k = c_custkey""")
def soft_deletes(spark, d):
    titles = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("title_id"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey")).alias("tmdb_id"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    status = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("title_id"), (F.col("o_orderstatus") == "P").alias("not_found"))
    return enrich.soft_delete(titles, status, ts("2000-01-01 00:00:00")).select("title_id", "deleted_at")


@query("""SELECT p_partkey::VARCHAR AS title_id, CASE WHEN p_size < 10 THEN p_size > 40 WHEN p_partkey % 3 = 0 THEN false WHEN p_partkey % 3 = 1 THEN true END AS surfaced, CASE WHEN p_size >= 10 THEN TIMESTAMP '1995-06-17' END AS checked_at FROM part""")
def write_back_titles(spark, d):
    p = read(spark, d, "part")
    titles = p.select(_key().alias("title_id"), (F.col("p_size") > 40).alias("surfaced"), F.lit(None).cast("timestamp_ntz").alias("checked_at"))
    classes = p.where("p_size >= 10").select(_key().alias("title_id"), F.when(F.col("p_partkey") % 3 == 0, False).when(F.col("p_partkey") % 3 == 1, True).alias("surfaced"))
    return audit.write_back(titles, as_watched(offers(spark, d)), classes, ts("1995-06-17 00:00:00"))[0]


@query("SELECT DISTINCT 'tt' || p_partkey AS imdb_id FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_suppkey = 7 AND l_returnflag = 'A' AND l_linestatus = 'F' AND p_size <= 40 AND p_partkey % 9 <> 0")
def tracked_title_ids(spark, d):
    """Outside ids of live titles with a subscription offer of the service; some parts are deleted, some have no id."""
    titles = read(spark, d, "part").select(_key().alias("title_id"), F.when(F.col("p_partkey") % 9 != 0, F.concat(F.lit("tt"), _key())).otherwise("").alias("imdb_id"), F.when(F.col("p_size") > 40, ts("2000-01-01 00:00:00")).alias("deleted_at"))
    rows = offers(spark, d).withColumn("type", F.when(F.col("type") == "F", "subscription").otherwise(F.col("type")))
    return audit.tracked_ids(titles, rows, X.subscription_offer("7", "A"))


@query("""WITH b AS (SELECT event_id, user_id FROM events LEFT JOIN part ON p_partkey = user_id WHERE p_partkey IS NULL OR p_size > 25) SELECT event_id AS seq, 'name ' || user_id AS title FROM b ORDER BY 1 LIMIT 20""")
def unmatched_sample(spark, d):
    titles = read(spark, d, "part").select(_key().alias("id"), F.concat(F.lit("name "), "p_partkey").alias("title"), F.when(F.col("p_size") > 25, "series").otherwise("movie").alias("type"), F.lit(None).cast("int").alias("year"))
    browse = read(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_id").alias("video_id"), F.concat(F.lit("name "), "user_id").alias("title"), F.lit("movie").alias("type"), F.lit(None).cast("int").alias("year"))
    return audit.unmatched_sample(audit.discover(as_watched(offers(spark, d)), titles, browse), browse, 20)


# Reports


@query("""WITH l AS (SELECT event_type job, max(event_id) id, arg_max(value, event_id) v, arg_max(user_id, event_id) u FROM events GROUP BY 1)
SELECT job, job || ': ' || CASE WHEN v < 20 THEN 'fail' ELSE 'ok' END || ', ' || u || ' processed, 3 calls, ' || id || ' seen, covers ' || (SELECT count(*) FROM part WHERE p_size > 25) || ' of ' || (SELECT count(*) FROM part) AS summary FROM l""")
def job_summaries(spark, d):
    e = read(spark, d, "events")
    log = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("sync_type"), F.col("user_id").alias("titles_processed"), _json(seen=F.col("event_id"), calls=F.lit(3)).alias("metadata"), "value")
    health = reports.latest_per(log, "sync_type", "id").select(F.col("sync_type").alias("job"), F.when(F.col("value") < 20, "fail").otherwise("ok").alias("verdict"), F.lit(None).cast("double").alias("minutes"))
    filled = reports.coverage(read(spark, d, "part"), F.when(F.col("p_size") > 25, 1))
    return reports.job_summary(health, log, filled)


@query("""SELECT 'titles' AS name, (SELECT count(*) FROM part WHERE p_size <= 40) AS n UNION ALL SELECT 'offers', (SELECT count(*) FROM lineitem) UNION ALL SELECT 'services', (SELECT count(*) FROM supplier)""")
def streaming_status_sizes(spark, d):
    e = read(spark, d, "events")
    log = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("sync_type"), F.lit("completed").alias("status"), F.col("ts").alias("started_at"), F.col("ts").alias("completed_at"), F.col("user_id").alias("api_calls_used"))
    titles = read(spark, d, "part").select(_key().alias("title_id"), F.when(F.col("p_size") > 40, ts("2000-01-01 00:00:00")).alias("deleted_at"))
    services = read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("service_id"), F.col("s_name").alias("name"))
    return reports.streaming_status(log, titles, offers(spark, d), services, "A", ts("1995-01-01 00:00:00"))["sizes"]


@query("""SELECT event_id AS id, value >= 20 AS exhausted FROM events ORDER BY event_id DESC LIMIT 5""")
def book_status_runs(spark, d):
    log = read(spark, d, "events").select(F.col("event_id").alias("id"), _json(exhausted=F.col("value") >= 20).alias("metadata"))
    held = read(spark, d, "orders").select(F.col("o_orderpriority").alias("list_source"), F.col("o_orderstatus").alias("list_key"))
    return reports.book_status(log, read(spark, d, "part"), held, F.col("p_size"), None)["recent"].select("id", "exhausted")


@query("""WITH i AS (SELECT l_orderkey item, l_linenumber pos, l_partkey isbn FROM lineitem), e AS (SELECT p_partkey isbn, 'K' || p_size k FROM part WHERE p_size > 25),
 f AS (SELECT item, pos, isbn, k, row_number() OVER (PARTITION BY item ORDER BY pos, isbn) n FROM i JOIN e USING (isbn)) SELECT item, k AS work_key FROM f WHERE n = 1""")
def edition_key_match(spark, d):
    lists = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string"))
    items = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("item")).agg(lists.alias("isbn13s"))
    editions = read(spark, d, "part").where("p_size > 25").select(_key().alias("isbn"), F.concat(F.lit("K"), F.col("p_size").cast("string")).alias("work_key"))
    return works.edition_keys(items, editions)


@query("""WITH i AS (SELECT o_orderkey seq, CASE WHEN o_orderstatus = 'P' THEN -1 - o_orderkey ELSE o_custkey END work, o_orderpriority a, year(o_orderdate) y, o_orderkey % 15 age, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'nyt' ELSE 'wkar' END asrc,
  CASE WHEN o_orderstatus = 'F' THEN 'nyt' ELSE 'wkar' END src, o_orderpriority key, o_orderdate::DATE dt, o_orderkey % 20 rk, o_custkey % 9 wk, o_orderkey % 7 = 0 AND o_orderstatus <> 'P' AND o_custkey % 3 <> 0 ed FROM orders),
 w AS (SELECT c_custkey work, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END a, CASE WHEN c_custkey % 3 = 0 THEN 'W' || c_custkey END k FROM customer),
 e AS (SELECT seq, work FROM i WHERE ed QUALIFY row_number() OVER (PARTITION BY work ORDER BY seq) = 1),
 ids AS (SELECT work FROM w UNION SELECT work FROM i),
 x AS (SELECT work, seq * 10 o, 'o' || seq t FROM i UNION ALL SELECT work, seq * 10 + 1, 'e' || work FROM e UNION ALL SELECT work, seq * 10 + 2, 'f' || seq FROM e),
 m AS (SELECT work, arg_min(a, seq) a, arg_min(y, seq) y FROM i GROUP BY 1), t AS (SELECT work, string_agg(t, ',' ORDER BY o) t FROM x GROUP BY 1),
 g AS (SELECT work, arg_max(age, (CASE asrc WHEN 'wkar' THEN 2 ELSE 1 END, seq)) age, arg_max(asrc, (CASE asrc WHEN 'wkar' THEN 2 ELSE 1 END, seq)) asrc FROM i WHERE asrc IS NOT NULL GROUP BY 1),
 b AS (SELECT work, src, key, dt, seq, rk, wk FROM i UNION ALL SELECT c_custkey, 'nyt', '1-URGENT', DATE '1995-01-01', -1, 99, 98 FROM customer WHERE c_custkey % 2 = 0),
 l AS (SELECT work, count(*) lists, max(dt) newest, sum(rk)::BIGINT AS ranks, sum(wk)::BIGINT AS weeks FROM (SELECT work, arg_max(dt, (dt, seq)) dt, arg_max(rk, (dt, seq)) rk, arg_max(wk, (dt, seq)) wk FROM b GROUP BY work, src, key) GROUP BY 1)
SELECT work, coalesce(w.a, m.a) AS author, m.y AS year, concat_ws(',', CASE WHEN work >= 0 THEN 'b' || work END, t) AS isbns, coalesce(w.k, 'E' || e.seq) AS work_key, 'cover' || e.seq AS cover_url,
 age AS min_age, asrc AS min_age_source, lists, strftime(newest, '%Y-%m-%d') AS newest, ranks, weeks
FROM ids LEFT JOIN w USING (work) LEFT JOIN m USING (work) LEFT JOIN t USING (work) LEFT JOIN g USING (work) LEFT JOIN l USING (work) LEFT JOIN e USING (work)""")
def book_ingest(spark, d):
    """Orders as items of customers' works: each names its work by ISBN, but for those that make a work of their own.

    Some items have editions, which give a work without a key their key, ISBNs and cover;
    some have an age without a source; every other customer is on a list already.
    """
    none, new, order = F.lit(None).cast("string"), F.col("o_orderstatus") == "P", F.col("o_orderkey").cast("string")
    source = F.when(F.col("o_orderstatus") == "F", "nyt").otherwise("wkar")
    orders = read(spark, d, "orders")
    own_isbn, customer = F.concat(F.lit("o"), order), F.concat(F.lit("b"), F.col("o_custkey").cast("string"))
    items = orders.select(
        F.col("o_orderkey").alias("seq"), F.concat(F.lit("order "), order).alias("title"), F.col("o_orderpriority").alias("author"), F.year("o_orderdate").alias("year"),
        F.when(new, F.array(own_isbn)).otherwise(F.array(customer, own_isbn)).alias("isbn13s"), none.alias("cover_url"), none.alias("description"),
        (F.col("o_orderkey") % 15).cast("int").alias("min_age"), F.when(F.col("o_orderkey") % 4 != 0, source).alias("min_age_source"), source.alias("list_source"), F.col("o_orderpriority").alias("list_key"), F.to_date("o_orderdate").alias("as_of_date"),
        (F.col("o_orderkey") % 20).alias("rank"), (F.col("o_custkey") % 9).alias("weeks_on_list"), none.alias("review_url"), none.alias("metadata"),
    )
    held = read(spark, d, "customer").select(
        F.col("c_custkey").alias("work"), F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("author"), F.lit(None).cast("int").alias("year"), F.array(F.concat(F.lit("b"), F.col("c_custkey").cast("string"))).alias("isbn13s"),
        none.alias("cover_url"), none.alias("description"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("W"), F.col("c_custkey").cast("string"))).alias("work_key"), F.lit(None).cast("int").alias("min_age"), none.alias("min_age_source"),
    )
    found = orders.where("o_orderkey % 7 = 0 AND o_orderstatus <> 'P' AND o_custkey % 3 <> 0")
    editions = found.select(own_isbn.alias("isbn"), F.concat(F.lit("E"), order).alias("work_key"), F.array(F.concat(F.lit("e"), F.col("o_custkey").cast("string")), F.concat(F.lit("f"), order)).alias("isbn13s"), F.concat(F.lit("cover"), order).alias("cover_url"))
    day = F.lit("1995-01-01").cast("date")
    listed = read(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("work"), F.lit("nyt").alias("list_source"), F.lit("1-URGENT").alias("list_key"), day.alias("as_of_date"), F.lit(99).cast("long").alias("rank"), F.lit(98).cast("long").alias("weeks_on_list"), none.alias("review_url"), none.alias("metadata"))
    out = ingest.ingest_batch(items, held, editions, listed)
    lists = out["memberships"].groupBy("work").agg(F.count("*").alias("lists"), F.date_format(F.max("as_of_date"), "yyyy-MM-dd").alias("newest"), F.sum("rank").alias("ranks"), F.sum("weeks_on_list").alias("weeks"))
    rows = out["works"].join(out["ages"], "work", "left").join(lists, "work", "left")
    return rows.select("work", "author", "year", F.array_join("isbn13s", ",").alias("isbns"), "work_key", "cover_url", "min_age", "min_age_source", "lists", "newest", "ranks", "weeks")
