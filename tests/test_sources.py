"""Landed files to frames."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from weftline.plans import books
from weftline.sources import landed


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_list_files(spark, tmp_path):
    entries = [{"title": " A ", "year": 2020, "type": "winner"}, {"title": "B", "year": "2020", "type": "honor"}, {"title": "C", "year": 2020.5, "type": "honor"}, {"title": "", "year": 1, "type": "honor"}, {"title": "D", "year": 1, "type": "other"}, {"year": 3, "type": "winner"}, {"title": 7, "year": 3, "type": "winner"}]
    (tmp_path / "prize.json").write_text(json.dumps(entries))
    valid, rejects = landed.read_list_file(spark, str(tmp_path / "prize.json"), "awards")
    assert rows(valid, "list_key", "title", "year", "type") == [("prize", "A", 2020, "winner")] and rejects.count() == 6
    (tmp_path / "object.json").write_text("{}")
    with pytest.raises(Exception, match="array"):
        landed.read_list_file(spark, str(tmp_path / "object.json"), "awards")[0].collect()


def test_pages_flatten_in_order(spark, tmp_path):
    show = {"id": "s1", "tmdbId": "movie/12", "title": "T" * 600, "genres": [{"name": "x"}], "cast": [], "imageSet": {"verticalPoster": {"w480": "small"}},
            "streamingOptions": {"us": [{"service": {"id": "n", "name": "N"}, "type": "subscription", "quality": "hd", "link": "l1", "price": {"amount": "3.99", "currency": "USD"}, "expiresOn": 99999999999999}, {"type": "buy"}]}}
    page = {"changes": [{"showId": "s1", "timestamp": 0, "service": {"id": "n"}, "streamingOptionType": "subscription", "link": "l"}, {"showId": "gone"}], "shows": {"s1": show, "s2": {"id": "s2"}}, "hasMore": False}
    (tmp_path / "p.json").write_text(json.dumps(page))
    pages = landed.read_pages(spark, str(tmp_path / "p.json"))
    assert rows(landed.flatten_changes(pages), "pos", "title_id", "service_id", "link") == [(0, "s1", "n", "l"), (1, "gone", None, None)]
    s1, s2 = sorted(landed.flatten_shows(pages).collect(), key=lambda r: r["title_id"])
    assert (s1["tmdb_type"], s1["tmdb_id"], len(s1["title"]), s1["genres"], s1["cast_members"], s1["poster_url"], s1["show_type"]) == ("movie", 12, 500, ["x"], None, "small", "movie")
    assert s2["title"] is None and s2["genres"] is None
    offers = landed.flatten_offers(pages).withColumn("end", F.date_format("expires_on", "yyyy"))
    assert rows(offers, "title_id", "pos", "service_id", "type", "end") == [("s1", 0, "n", "subscription", "9999"), ("s1", 1, None, "buy", None)]
    assert rows(landed.payload_services(pages), "id", "name") == [("n", "N")]


def test_sitemaps_and_cursors(spark, tmp_path):
    (tmp_path / "m.xml").write_text("<urlset><url><loc>https://s/book-reviews/b</loc></url><url><loc> https://s/book-reviews/a </loc></url><url><loc>https://s/book-reviews/</loc></url><url><loc>https://s/book-reviews/a</loc></url><url><loc>https://s/films/x</loc></url></urlset>")
    urls = landed.discover_urls(landed.read_sitemaps(spark, str(tmp_path / "m.xml")), "loc", "/book-reviews/[^/?#]+")
    assert [r[0] for r in urls.collect()] == ["https://s/book-reviews/a", "https://s/book-reviews/b"]
    assert [r[0] for r in landed.resume_after(urls, "https://s/book-reviews/a", 5).collect()] == ["https://s/book-reviews/b"]
    assert landed.resume_after(urls, "", 1).count() == 1
    known = spark.createDataFrame([("csm", "https://s/book-reviews/a"), ("csm", None), ("other", "https://s/book-reviews/b")], "list_source string, review_url string")
    assert rows(landed.delta_new(urls, known, "csm")) == [("https://s/book-reviews/b",)]
    with pytest.raises(ValueError):
        landed.require_some(urls.limit(0), "urls")


def test_jsonld_reviews(spark):
    block = lambda *objects: "".join(f'<script type="application/ld+json">{o if isinstance(o, str) else json.dumps(o)}</script>' for o in objects)
    og = '<meta property="og:title" content="Big Book Book Review | Site">'
    pages = [
        ("graph", block("{broken", {"@graph": [{"x": 1}, {"itemReviewed": {"name": "N", "author": {"name": "A"}, "isbn": "0306406152"}}, {"typicalAgeRange": "8+"}]})),
        ("list", block([{"itemReviewed": {"author": [{"name": "First"}, {"name": "Second"}], "typicalAgeRange": "12-14"}}]) + og),
        ("root", block({"a": 1}, {"itemReviewed": {"name": "R", "author": "Bare"}})),
        ("plain", og),
        ("none", "<html></html>"),
        ("null", None),
    ]
    got = landed.extract_jsonld_reviews(spark.createDataFrame(pages, "url string, html string"))
    assert rows(got) == sorted([("graph", "N", "A", 8, "9780306406157"), ("list", "Big Book", "First", 12, None), ("root", "R", "Bare", None, None), ("plain", "Big Book", None, None, None)], key=str)


def test_byline_reviews(spark):
    page = lambda *items, h1="<h1>Tom &amp; <i>Jerry</i></h1>": h1 + "".join(f'<li class="x post-info">{i}</li>' for i in items)
    pages = [
        ("ok", page("Genre", "Book Review", "Ann O&#39;Hara", "8 to 12", "Pub")),
        ("band", page("book review", "", "1", "2", "3", "4", "9 and up")),
        ("digit", page("Book Review", "10 years old and up", "Pub")),
        ("drop", page("Book Review", "N/A", "8+")),
        ("bare", page()),
        ("og", page("Book Review", "Bo", "7+", h1='<meta property="og:title" content="Og">')),
        ("none", page("Book Review", "Bo", h1="")),
    ]
    got = landed.extract_byline_reviews(spark.createDataFrame(pages, "url string, html string"))
    assert rows(got) == sorted([("ok", "Tom & Jerry", "Ann O'Hara", 8), ("band", "Tom & Jerry", None, None), ("digit", "Tom & Jerry", None, 10), ("bare", "Tom & Jerry", None, None), ("og", "Og", "Bo", 7)], key=str)


def test_page_titles_equal_their_sql(spark, tmp_path):
    heads = ["Rock &amp; roll &amp", "A&amp;amp;&lt;b&gt;&quot;&#39;", "&eacute; &copy &#x27;", "\u00a0 <i>x</i>\u3000", "\t y", "", " <b></b> "]
    pages = [f"<H1 id=1>{h}</h1><h1>second</h1>" for h in heads] + ['<meta property="og:title" content="Og">', "<h1>open", "", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    theirs = con.execute(f"SELECT page_id, title FROM ({books.SQL['page_title_extract']})").fetchall()
    assert rows(books.QUERIES["page_title_extract"](spark, str(tmp_path)), "page_id", "title") == sorted(theirs, key=str)


def test_references_end_in_a_semicolon(spark):
    page = '<h1>A &amp; B &amp &eacute;&copy &#39;&#x27; &amp;lt; &ampx; &nope;</h1>'
    got = landed.extract_byline_reviews(spark.createDataFrame([("u", page)], "url string, html string"))
    assert got.first()["title"] == "A & B &amp é&copy \'\' &lt; &ampx; &nope;"


def test_books_volumes_editions(spark):
    book = {"rank": 1, "weeks_on_list": 2, "primary_isbn13": "9780306406157", "title": " THE CAT ", "author": "", "description": " ", "book_image": "i", "isbns": [{"isbn13": "9780306406157"}, {"isbn13": "bad"}]}
    page = {"results": {"list_name_encoded": "picture-books", "published_date": "2025-01-15", "books": [book, {"title": " "}]}}
    pages = spark.createDataFrame([(json.dumps(page),)], "j string").select(F.from_json("j", landed.BESTSELLER_TYPE).alias("p")).select("p.*")
    item = landed.bestseller_items(pages).collect()
    assert len(item) == 1 and (item[0]["title"], item[0]["author"], item[0]["description"], item[0]["isbn13s"], item[0]["min_age"]) == ("The Cat", None, None, ["9780306406157"], 4)
    kind = "struct<id:string,volumeInfo:struct<description:string,categories:array<string>,pageCount:int,publishedDate:string,imageLinks:struct<thumbnail:string,smallThumbnail:string>>,accessInfo:struct<viewability:string>>"
    volumes = spark.createDataFrame([("i", ("v", ("", [], 0, "1999-01", (None, "http://c")), ("NO_PAGES",)))], f"isbn string, v {kind}")
    assert rows(landed.volume_columns(volumes)) == [("i", "v", None, None, None, 1999, "https://c", False)]
    kind = "struct<works:array<struct<key:string>>,isbn_13:array<string>,isbn_10:array<string>,covers:array<int>>"
    editions = spark.createDataFrame([(([("/works/OL5W",)], ["9780306406157"], ["0306406152", "x"], [-1, 7]),)], f"e {kind}")
    assert rows(landed.edition_columns(editions)) == [("OL5W", ["9780306406157"], "https://covers.openlibrary.org/b/id/7-L.jpg")]


def test_answers(spark):
    bodies = spark.createDataFrame([(1, 'id:11 movie "One" 70; id:12 series "Two" ;'), (2, None)], "body_id int, body string")
    got = landed.text_entities(bodies, r'id:(\d+) (movie|series) "([^"]*)" (\d*);')
    assert rows(got) == [(1, 11, "movie", "One", 70), (1, 12, "series", "Two", None)]
    answer = {"videos": {"5": {"title": "A", "releaseYear": 2001, "maturity": {"level": 90}}, "6": {"title": " "}, "7": {"title": "C"}}}
    assert rows(landed.graph_answers(spark.createDataFrame([(json.dumps(answer),)], "body string"))) == [(5, "A", 2001, 90), (7, "C", None, None)]
    assert rows(landed.answer_ids(spark.createDataFrame([('["videos",5] ["videos", "6"] ["videos",5]',)], "body string"))) == [(5,), (6,)]
