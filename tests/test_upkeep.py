"""Run counters, exports in parts, sitemap trees, sketches and the index of word runs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import match, reports, tables
from weftline.sources import landed


def test_a_run_counts_what_it_writes(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    counts = tables.run_logged(spark, log, "load", {"a": (spark.range(50), f"{out}/a"), "b": (spark.range(0), f"{out}/b")}, {"a": {"even": F.count_if(F.col("id") % 2 == 0), "top": F.max("id")}}, processed="a", api_calls_used=3)
    assert counts == {"a": {"rows": 50, "even": 25, "top": 49}, "b": {"rows": 0}} and spark.read.parquet(f"{out}/a").count() == 50
    with pytest.raises(Exception, match="broken row"):
        tables.run_logged(spark, log, "load", {"c": (spark.range(1).select(F.raise_error(F.lit("broken row")).alias("x").cast("string")), f"{out}/c")}, {})
    first, second = spark.read.parquet(log).orderBy("id").collect()
    assert (first["status"], first["titles_processed"], first["api_calls_used"], json.loads(first["metadata"])) == ("completed", 50, 3, counts) and first["completed_at"] >= first["started_at"]
    assert (second["id"], second["status"]) == (2, "failed") and "broken row" in second["error_message"]


@pytest.mark.parametrize("kind,ids,surfaced", [("long", [5, 3, 3, None, 10, 2], [7, 1]), ("string", ['b"', "a", "ü\n"], []), ("long", [], [4]), ("long", [], []), ("string", ["x"], ["x"])])
def test_export_files_join_to_the_document(spark, tmp_path, kind, ids, surfaced):
    frame = lambda rows: spark.createDataFrame([(r,) for r in rows], f"id {kind}")
    path = str(tmp_path / "export")
    tables.write_availability(frame(ids), frame(surfaced), "id", path, parts=3)
    text = b"".join(p.read_bytes() for folder in ("1-body", "2-end") for p in sorted((tmp_path / "export" / folder).glob("part-*")))
    assert text.decode() == tables.availability_document(frame(ids), frame(surfaced), "id").first()[0]


def test_sitemap_trees(spark):
    index = lambda *locs: "<sitemapindex xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>" + "".join(f"<sitemap><loc>\n{u} </loc><lastmod>2024</lastmod></sitemap>" for u in locs) + "</sitemapindex>"
    pages = lambda *locs: "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in locs) + "</urlset>"
    files = [("top", index("m/review-1", "m/other", "m/review-2", "m/review-lost")), ("m/review-1", pages("x/book-reviews/b", "x/book-reviews/a?q=1&amp;r=2", "x/films/c")), ("m/other", pages("x/book-reviews/never"))]
    files += [("m/review-2", index("m/review-3", "top", "m/review-1")), ("m/review-3", pages("x/book-reviews/b", "x/book-reviews/z")), ("m/review-3", "not xml"), ("m/none", None)]
    table = spark.createDataFrame(files, "url string, body string")
    urls, missing = landed.sitemap_tree(table, ["top"], r"/book-reviews/[^/?#]+", marker="review")
    assert [r[0] for r in urls.collect()] == ["x/book-reviews/a?q=1&r=2", "x/book-reviews/b", "x/book-reviews/z"]
    assert [r[0] for r in missing.collect()] == ["m/review-lost"]
    with pytest.raises(ValueError, match="no urls"):
        landed.sitemap_tree(table, ["top"], "nothing like this")


def test_sketches_roll_up(spark):
    rng = random.Random(1)
    rows = [(f"s{rng.randrange(3)}", rng.randrange(5), str(rng.randrange(4000))) for _ in range(20_000)] + [("none", 1, None)]
    df = spark.createDataFrame(rows, "service_id string, day int, title_id string")
    got = {r["service_id"]: r["titles"] for r in reports.rolled_up(reports.title_sketches(df, ["service_id", "day"]), ["service_id"]).collect()}
    for s in ("s0", "s1", "s2"):
        exact = len({t for k, _, t in rows if k == s})
        assert abs(got[s] - exact) <= 0.05 * exact


def test_runs_of_words_against_every_pair(spark):
    """Names from few words, so that the commonest is in most of them."""
    rng = random.Random(12)
    words = ["the"] * 6 + ["red", "of", "2", "3", "long", "house", "a", "10"]
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6)))
    titles = [(k, name(), rng.choice(["movie", "series"]), None) for k in range(60)]
    queries = [(k, name(), rng.choice(["movie", "series"]), None) for k in range(80)] + [(99, "", "movie", None)]

    def fits(q, t):
        short, long = (q, t) if len(q) <= len(t) else (t, q)
        at = next((i for i in range(len(long) - len(short) + 1) if long[i : i + len(short)] == short), None)
        if at is None or len("".join(short)) * 2 < len("".join(long)):
            return False
        if len(short) == len(long):
            return True
        end = at + len(short)
        return not (at == 0 and long[end].isdigit()) and not (at > 0 and end == len(long) and long[at - 1].isdigit())

    want = {}
    for k, text, kind, _ in queries:
        hits = {i for i, t, other, _ in titles if other == kind and text and fits(text.split(), t.split())}
        if hits:
            want[k] = hits.pop() if len(hits) == 1 else None
    kinds = "title string, type string, year int"
    got = match.subtitle_matches(spark.createDataFrame(queries, f"query_id int, {kinds}"), spark.createDataFrame(titles, f"id int, {kinds}"))
    assert {r["query_id"]: r["match_id"] for r in got.collect()} == want and len({v for v in want.values() if v}) > 5
