"""Landed files to frames: lists, nested pages, sitemaps, review pages, volumes, editions, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import band_age, basename, blank_to_null, clamp, clamp_epoch, decode_entities, isbn13, leading_age, leading_year, list_age, split_type_id, strip_tags
from ..operators.graph import saved

_SERVICE = "struct<id:string,name:string,themeColorCode:string,imageSet:struct<lightThemeImage:string,darkThemeImage:string>>"
_OPTION = f"struct<service:{_SERVICE},type:string,quality:string,link:string,deepLink:string,price:struct<amount:string,currency:string>,expiresOn:bigint>"
_SHOW = (
    "struct<id:string,imdbId:string,tmdbId:string,showType:string,title:string,releaseYear:int,firstAirYear:int,lastAirYear:int,runtime:int,rating:int,"
    "seasonCount:int,episodeCount:int,genres:array<struct<name:string>>,`cast`:array<string>,directors:array<string>,creators:array<string>,overview:string,"
    "imageSet:struct<verticalPoster:struct<w480:string,w720:string>,horizontalBackdrop:struct<w720:string,w1080:string>>,"
    f"streamingOptions:struct<us:array<{_OPTION}>>>"
)
PAGE_TYPE = (
    f"changes array<struct<showId:string,timestamp:bigint,service:{_SERVICE},streamingOptionType:string,link:string>>, shows map<string,{_SHOW}>, nextCursor string, hasMore boolean"
)
#: Fixed value: where cover images are served, before their number.
COVERS = "https://covers.openlibrary.org/b/id/"
BESTSELLER_TYPE = (
    "status string, num_results int, results struct<list_name:string,list_name_encoded:string,published_date:string,previous_published_date:string,"
    "books:array<struct<rank:int,weeks_on_list:int,primary_isbn13:string,primary_isbn10:string,title:string,author:string,description:string,book_image:string,"
    "isbns:array<struct<isbn10:string,isbn13:string>>>>>"
)


def split_entries(rows: DataFrame, kind: str, json_col: str = "entry") -> tuple[DataFrame, DataFrame]:
    """(valid, rejects) of list entries, one JSON object a row. kind: ``grades`` or ``awards``.

    A valid entry has a non-blank text title and a whole-number year; an award also the
    type winner or honor. Numbers as text and fractions are rejected, not cast.
    """
    v = rows.withColumn("_v", F.try_parse_json(json_col))
    get = lambda path, kind: F.try_variant_get("_v", path, kind)
    is_text = F.schema_of_variant(F.try_variant_get("_v", "$.title", "variant")) == "STRING"
    is_whole = F.schema_of_variant(F.try_variant_get("_v", "$.year", "variant")) == "BIGINT"
    ok = F.coalesce(is_text, F.lit(False)) & F.coalesce(is_whole, F.lit(False)) & F.coalesce(F.trim(get("$.title", "string")) != "", F.lit(False))
    if kind == "awards":
        ok = ok & F.coalesce(get("$.type", "string").isin("winner", "honor"), F.lit(False))
    v = v.withColumn("_ok", ok)
    fields = {"title": F.trim(get("$.title", "string")), "author": blank_to_null(get("$.author", "string")), "year": get("$.year", "int")}
    if kind == "awards":
        fields["type"] = get("$.type", "string")
    else:
        fields |= {"min_age": band_age(get("$.grade_band", "string")), "rank": get("$.rank", "int")}
    keep = [c for c in rows.columns if c != json_col]
    return v.where("_ok").select(*keep, *[c.alias(n) for n, c in fields.items()]), v.where("NOT _ok").select(*rows.columns)


def read_list_file(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects) of JSON array files; ``list_key`` is the file's name without ending. A file that isn't an array is an error."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("list_key"), F.try_parse_json("value").alias("v"))
    whole = F.coalesce(F.schema_of_variant("v").startswith("ARRAY"), F.lit(False))
    checked = files.select("list_key", F.when(whole, F.col("v")).otherwise(F.raise_error(F.lit("a list file must hold a JSON array"))).cast("array<variant>").alias("entries"))
    return split_entries(checked.select("list_key", F.explode("entries").alias("e")).select("list_key", F.to_json("e").alias("entry")), kind)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Change or catalog pages, with the file and its place as the order of reading."""
    return spark.read.schema(PAGE_TYPE).json(path, multiLine=True).withColumn("page", F.col("_metadata.file_name"))


def flatten_changes(pages: DataFrame) -> DataFrame:
    """(page, pos, title_id, service_id, type, ts, link) of the changes, in their order in the page."""
    rows = pages.select("page", F.posexplode("changes").alias("pos", "c"))
    return rows.select("page", "pos", F.col("c.showId").alias("title_id"), F.col("c.service.id").alias("service_id"), F.col("c.streamingOptionType").alias("type"), clamp_epoch(F.col("c.timestamp")).alias("ts"), "c.link")


def flatten_shows(pages: DataFrame) -> DataFrame:
    """Title attributes of the shows of every page."""
    s = "s.value"
    rows = pages.select("page", F.explode(F.map_entries("shows")).alias("s"))
    kind, number = split_type_id(F.col(f"{s}.tmdbId"))
    filled = lambda c: F.when(F.size(c) > 0, c)
    image = lambda name, big, small: F.coalesce(f"{s}.imageSet.{name}.{big}", f"{s}.imageSet.{name}.{small}")
    return rows.select(
        "page",
        F.col("s.key").alias("title_id"),
        F.col(f"{s}.imdbId").alias("imdb_id"),
        number.alias("tmdb_id"),
        kind.alias("tmdb_type"),
        F.coalesce(f"{s}.showType", F.lit("movie")).alias("show_type"),
        clamp(F.col(f"{s}.title"), 500).alias("title"),
        F.col(f"{s}.releaseYear").alias("release_year"),
        F.col(f"{s}.firstAirYear").alias("first_air_year"),
        F.col(f"{s}.lastAirYear").alias("last_air_year"),
        f"{s}.runtime",
        f"{s}.rating",
        F.col(f"{s}.seasonCount").alias("season_count"),
        F.col(f"{s}.episodeCount").alias("episode_count"),
        filled(F.transform(f"{s}.genres", lambda g: g["name"])).alias("genres"),
        filled(F.col(f"{s}.cast")).alias("cast_members"),
        filled(F.col(f"{s}.directors")).alias("directors"),
        filled(F.col(f"{s}.creators")).alias("creators"),
        f"{s}.overview",
        image("verticalPoster", "w720", "w480").alias("poster_url"),
        image("horizontalBackdrop", "w1080", "w720").alias("backdrop_url"),
    )


def flatten_offers(pages: DataFrame) -> DataFrame:
    """The US options of every show, with their place; shows without options give no row."""
    rows = pages.select("page", F.explode(F.map_entries("shows")).alias("s")).select("page", F.col("s.key").alias("title_id"), F.posexplode("s.value.streamingOptions.us").alias("pos", "o"))
    return rows.select(
        "page", "title_id", "pos", F.col("o.service.id").alias("service_id"), F.col("o.type").alias("type"), F.col("o.quality").alias("video_quality"), "o.link", F.col("o.deepLink").alias("deep_link"),
        F.col("o.price.amount").try_cast("decimal(8,2)").alias("price_amount"), F.col("o.price.currency").alias("price_currency"), clamp_epoch(F.col("o.expiresOn")).alias("expires_on"),
    )


def payload_services(pages: DataFrame) -> DataFrame:
    """(page, pos, id, name, theme_color, logo_light, logo_dark) of the services named by options."""
    rows = pages.select("page", F.explode(F.map_entries("shows")).alias("s")).select("page", F.posexplode("s.value.streamingOptions.us").alias("pos", "o")).where("o.service.id IS NOT NULL")
    v = "o.service"
    return rows.select("page", "pos", f"{v}.id", f"{v}.name", F.col(f"{v}.themeColorCode").alias("theme_color"), F.col(f"{v}.imageSet.lightThemeImage").alias("logo_light"), F.col(f"{v}.imageSet.darkThemeImage").alias("logo_dark"))


def read_sitemaps(spark: SparkSession, path: str, row_tag: str = "url") -> DataFrame:
    """The ``loc`` values of sitemap files (row_tag ``sitemap`` for an index)."""
    return spark.read.schema("loc string, lastmod string").format("xml").option("rowTag", row_tag).load(path).select(F.trim("loc").alias("loc"))


def discover_urls(locs: DataFrame, url_col: str, pattern: str) -> DataFrame:
    """The distinct urls that match, in byte order; none at all is an error of the caller's ``require_some``."""
    return locs.select(F.col(url_col).alias("url")).where(F.col("url").rlike(pattern)).distinct().orderBy("url")


def sitemap_tree(landed: DataFrame, start: list[str], pattern: str, marker: str = "") -> tuple[DataFrame, DataFrame]:
    """(urls, missing) of the sitemaps that can be reached from ``start``, an index or several, in ``landed(url, body)``.

    An index's entries whose url holds the marker are joined to their landed files, which
    may be indexes again; it goes on level by level until none is new. ``urls`` are the
    distinct page urls that match, in byte order; none at all raises. ``missing`` are the
    entries that weren't landed. Of files landed twice all entries count; bodies that
    aren't XML have none.
    """
    kind = "struct<sitemap:array<struct<loc:string>>,url:array<struct<loc:string>>>"
    parsed = landed.where("body IS NOT NULL").select("url", F.from_xml("body", kind, {"mode": "PERMISSIVE"}).alias("x"))
    locs = lambda part: F.filter(F.transform(F.coalesce(f"x.{part}.loc", F.array().cast("array<string>")), lambda c: F.trim(c)), lambda c: c != "")
    parsed = saved(parsed.select("url", locs("sitemap").alias("below"), locs("url").alias("pages")))
    seen = level = saved(landed.sparkSession.createDataFrame([(u,) for u in start], "url string").distinct())
    while True:
        entries = parsed.join(level, "url", "left_semi").select(F.explode("below").alias("url")).where(F.col("url").contains(marker)).distinct()
        level = saved(entries.join(seen, "url", "left_anti"))
        if level.isEmpty():
            break
        seen = saved(seen.union(level))
    found = parsed.join(seen, "url", "left_semi").select(F.explode("pages").alias("loc"))
    urls = require_some(discover_urls(found, "loc", pattern), "urls in the sitemaps")
    return urls, seen.join(parsed.select("url"), "url", "left_anti")


def require_some(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no {what} found")
    return df


def resume_after(urls: DataFrame, cursor: str | None, n: int, url_col: str = "url") -> DataFrame:
    """The first ``n`` urls after the cursor in byte order; a null or empty cursor starts over."""
    return urls.where(F.col(url_col) > (cursor or "")).orderBy(url_col).limit(n)


def delta_new(urls: DataFrame, memberships: DataFrame, source: str) -> DataFrame:
    """Urls that no membership of the source has yet."""
    known = memberships.where((F.col("list_source") == source) & F.col("review_url").isNotNull()).select(F.col("review_url").alias("url"))
    return urls.join(known, "url", "left_anti")


def _og_title(html: Column) -> Column:
    return blank_to_null(F.regexp_extract(html, r"""(?is)<meta[^>]*property=["']og:title["'][^>]*content=["']([^"']*)["']""", 1))


def extract_jsonld_reviews(pages: DataFrame, site_suffix: str = r"\s*\|.*$") -> DataFrame:
    """(url, title, author, min_age, isbn13) of review pages with JSON-LD; pages without a title give no row.

    The first block with an ``itemReviewed`` object counts, be it in ``@graph``, a list
    or the root; the age comes from the book, else from the first node that has one.
    """
    blocks = F.regexp_extract_all("html", F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    parsed = F.transform(blocks, lambda b: F.try_parse_json(b))
    nodes = lambda v: F.coalesce(F.try_variant_get(v, "$['@graph']", "array<variant>"), v.try_cast("array<variant>"), F.array(v))
    reviewed = lambda n: F.coalesce(F.schema_of_variant(F.try_variant_get(n, "$.itemReviewed", "variant")).startswith("OBJECT"), F.lit(False))
    lists = F.transform(F.filter(parsed, lambda v: v.isNotNull()), nodes)
    block = F.get(F.filter(lists, lambda ns: F.exists(ns, reviewed)), F.lit(0))
    rows = pages.select("url", "html", block.alias("nodes"))
    rows = rows.withColumn("book", F.try_variant_get(F.get(F.filter("nodes", reviewed), F.lit(0)), "$.itemReviewed", "variant"))
    text = lambda path: F.try_variant_get("book", path, "string")
    is_text = lambda path: F.schema_of_variant(F.try_variant_get("book", path, "variant")) == "STRING"
    heading = F.trim(F.regexp_replace(F.regexp_replace(_og_title(F.col("html")), site_suffix, ""), r"\s*Book Review\s*$", ""))
    author = F.coalesce(text("$.author.name"), text("$.author[0].name"), F.when(is_text("$.author[0]"), text("$.author[0]")), F.when(is_text("$.author"), text("$.author")))
    aged = F.get(F.filter("nodes", lambda n: F.try_variant_get(n, "$.typicalAgeRange", "string").isNotNull()), F.lit(0))
    age = F.coalesce(text("$.typicalAgeRange"), F.try_variant_get(aged, "$.typicalAgeRange", "string"))
    out = rows.select("url", F.coalesce(blank_to_null(text("$.name")), blank_to_null(heading)).alias("title"), blank_to_null(author).alias("author"), leading_age(age).alias("min_age"), isbn13(text("$.isbn")).alias("isbn13"))
    return out.where("title IS NOT NULL")


def heading(html: Column) -> Column:
    """The first heading without tags, empty without one; references are still encoded."""
    return F.regexp_replace(strip_tags(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)), r"^\p{Zs}+|\p{Zs}+$", "")


def page_title(html: Column) -> Column:
    """The first heading without tags, else og:title; references are still encoded."""
    return F.coalesce(blank_to_null(heading(html)), _og_title(html))


def extract_byline_reviews(pages: DataFrame, item: str = r"(?is)<li[^>]*class=[\"'][^\"']*post-info[^\"']*[\"'][^>]*>(.*?)</li>") -> DataFrame:
    """(url, title, author, min_age) of review pages with a heading and ordered info items.

    The item after the label "Book Review" names the author; a placeholder there drops
    the page, an empty one or one that starts with a digit means no author. The age is
    the first of the five items after the label that is an age band.
    """
    rows = pages.select("url", page_title(F.col("html")).alias("raw"), F.regexp_extract_all("html", F.lit(item), F.lit(1)).alias("raw_items"))
    rows = rows.where("raw IS NOT NULL").withColumn("items", F.transform("raw_items", lambda x: F.trim(strip_tags(x))))
    rows = rows.withColumn("at", F.array_position(F.transform("items", F.lower), "book review")).withColumn("title", F.trim(decode_entities(F.col("raw"))))
    byline = F.when(F.col("at") > 0, F.get("items", F.col("at").cast("int")))
    after = F.when(F.col("at") > 0, F.slice("items", F.col("at").cast("int") + 1, 5))
    band = r"(?i)^([0-9]{1,2})\s*(to\s+[0-9]{1,2}|years old and up|and up|\+)$"
    age = F.get(F.filter(after, lambda x: x.rlike(band)), F.lit(0))
    rows = rows.withColumn("byline", byline).where(~F.coalesce(F.lower("byline").isin("none", "unknown", "n/a"), F.lit(False)))
    author = F.when(F.col("byline").rlike("^[0-9]"), None).otherwise(blank_to_null(decode_entities(F.col("byline"))))
    return rows.select("url", "title", author.alias("author"), leading_age(age).alias("min_age")).where("title <> ''")


def bestseller_items(pages: DataFrame) -> DataFrame:
    """Ingest items of bestseller pages: one row per book with a title."""
    rows = pages.select("results.list_name_encoded", "results.published_date", "results.previous_published_date", F.explode("results.books").alias("b"))
    isbns = F.concat(F.array("b.primary_isbn13"), F.coalesce(F.transform("b.isbns", lambda x: x["isbn13"]), F.array().cast("array<string>")))
    return rows.select(
        F.initcap(F.lower(F.trim("b.title"))).alias("title"), blank_to_null(F.col("b.author")).alias("author"), blank_to_null(F.col("b.book_image")).alias("cover_url"),
        blank_to_null(F.col("b.description")).alias("description"), F.array_distinct(F.filter(F.transform(isbns, isbn13), lambda x: x.isNotNull())).alias("isbn13s"),
        list_age(F.col("list_name_encoded")).alias("min_age"), F.lit("nyt").alias("list_source"), F.col("list_name_encoded").alias("list_key"), "b.rank", "b.weeks_on_list",
        F.col("published_date").try_cast("date").alias("as_of_date"), F.col("previous_published_date").try_cast("date").alias("previous_date"),
    ).where("title <> ''")


def volume_columns(volumes: DataFrame) -> DataFrame:
    """(isbn, google_books_id, description, categories, page_count, year, cover_url, preview_available) of volumes(isbn, v)."""
    i = "v.volumeInfo"
    cover = F.coalesce(blank_to_null(F.col(f"{i}.imageLinks.thumbnail")), blank_to_null(F.col(f"{i}.imageLinks.smallThumbnail")))
    view = F.col("v.accessInfo.viewability")
    return volumes.select(
        "isbn", F.col("v.id").alias("google_books_id"), blank_to_null(F.col(f"{i}.description")).alias("description"), F.when(F.size(f"{i}.categories") > 0, F.col(f"{i}.categories")).alias("categories"),
        F.when(F.col(f"{i}.pageCount") > 0, F.col(f"{i}.pageCount")).alias("page_count"), leading_year(F.col(f"{i}.publishedDate")).alias("year"), F.regexp_replace(cover, "^http:", "https:").alias("cover_url"),
        F.when(view.isin("PARTIAL", "ALL_PAGES"), True).when(view == "NO_PAGES", False).alias("preview_available"),
    )


def edition_columns(editions: DataFrame) -> DataFrame:
    """(work_key, isbn13s, cover_url) of editions(e) with works, isbn_13, isbn_10 and covers."""
    none = F.array().cast("array<string>")
    isbns = F.concat(F.coalesce("e.isbn_13", none), F.coalesce("e.isbn_10", none))
    cover = F.get(F.filter("e.covers", lambda c: c > 0), F.lit(0))
    return editions.select(
        basename(F.get("e.works", F.lit(0))["key"]).alias("work_key"), F.array_distinct(F.filter(F.transform(isbns, isbn13), lambda x: x.isNotNull())).alias("isbn13s"),
        F.concat(F.lit(COVERS), cover, F.lit("-L.jpg")).alias("cover_url"),
    )


def text_entities(bodies: DataFrame, pattern: str) -> DataFrame:
    """(body_id, video_id, type, title, maturity) of every match in a text body.

    ``pattern`` has four groups in this order, the last may be empty: an entity without a
    maturity stays, with null.
    """
    groups = [F.regexp_extract_all("body", F.lit(pattern), F.lit(k)).alias(f"g{k}") for k in range(1, 5)]
    rows = bodies.select("body_id", *groups).select("body_id", F.explode(F.arrays_zip("g1", "g2", "g3", "g4")).alias("e"))
    return rows.select("body_id", F.col("e.g1").try_cast("long").alias("video_id"), F.col("e.g2").alias("type"), F.trim("e.g3").alias("title"), F.col("e.g4").try_cast("int").alias("maturity"))


def graph_answers(bodies: DataFrame) -> DataFrame:
    """(video_id, title, year, level) of keyed answers ``{"videos": {"<id>": {...}}}``; missing leaves are null, blank titles give no row."""
    kind = "struct<videos:map<string,struct<title:string,releaseYear:int,maturity:struct<level:int>>>>"
    rows = bodies.select(F.explode(F.map_entries(F.from_json("body", kind)["videos"])).alias("v"))
    rows = rows.select(F.col("v.key").try_cast("long").alias("video_id"), blank_to_null(F.col("v.value.title")).alias("title"), F.col("v.value.releaseYear").alias("year"), F.col("v.value.maturity.level").alias("level"))
    return rows.where("title IS NOT NULL AND video_id IS NOT NULL")


def answer_ids(bodies: DataFrame, pattern: str = r'"videos",\s*"?([0-9]+)"?') -> DataFrame:
    """Distinct video ids named in text bodies."""
    return bodies.select(F.explode(F.regexp_extract_all("body", F.lit(pattern), F.lit(1))).alias("id")).select(F.col("id").try_cast("long").alias("video_id")).distinct()
