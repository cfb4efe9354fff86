"""Column expressions: golden cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weftline.functions import exprs as X


def one(spark, column, *values, kind="string"):
    rows = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in rows.select(column(F.col("v"))).collect()]


def test_names(spark):
    assert one(spark, X.normalize_title, "The  Cat's Meow!", "An Élan", "A", "Theory", None, "  ", "Ærø & Straße", "Œuvre — II", "日本") == ["cats meow", "elan", "a", "theory", None, "", "aero strasse", "oeuvre ii", ""]
    assert one(spark, X.normalize_author, " J. K. O’Neil ", "", "...") == ["j k oneil", None, None]
    assert one(spark, lambda c: X.last_name(X.normalize_author(c)), "Ursula K. Le Guin", "Agent 0", None) == ["guin", None, None]
    assert one(spark, X.squash, "Wall·E", "İstanbul", "M*A*S*H 2") == ["walle", "stanbul", "mash2"]
    assert one(spark, X.tokens, "We're Lalaloopsy!", "", "--") == [["we", "re", "lalaloopsy"], [], []]


def test_isbn(spark):
    got = one(spark, X.isbn13, "0-306-40615-2", "080442957X", "978 0 306 40615 7", "9780306406150", "123", None, "03064061521", "X306406152")
    assert got == ["9780306406157", "9780804429573", "9780306406157", "9780306406150", None, None, None, None]


def test_small_parsers(spark):
    assert one(spark, X.leading_year, "2021-05", "21", None) == [2021, None, None]
    assert one(spark, X.leading_age, " 8+", "12-14", "x9") == [8, 12, None]
    assert one(spark, X.video_id, "https://n/title/80057281?x", "n/watch/1") == [80057281, None]
    assert one(spark, X.basename, "/works/OL1W") == ["OL1W"]
    assert one(spark, X.blank_to_null, " ", " a ") == [None, " a "]
    rows = spark.createDataFrame([("movie/12",), ("tv/x1",), ("12",), ("a/b/3",), (None,)], "v string")
    assert [tuple(r) for r in rows.select(*X.split_type_id(F.col("v"))).collect()] == [("movie", 12), ("tv", None), (None, None), ("a", None), (None, None)]
    assert one(spark, lambda c: X.decode_entities(X.strip_tags(c)), "<b>Tom &amp; Jerry&#39;s</b>", None) == ["Tom & Jerry's", None]
    assert one(spark, X.list_age, "picture-books", "childrens-middle-grade-hardcover", "young-adult-paperback", "fiction") == [4, 8, 12, None]
    assert one(spark, X.band_age, "K-2", "3-5", "6-8", "9-12", "10") == [5, 8, 11, 14, None]


def test_times(spark):
    got = one(spark, lambda c: F.date_format(X.clamp_epoch(c), "yyyy-MM-dd HH:mm:ss"), 0, 253402300800, None, kind="long")
    assert got == ["1970-01-01 00:00:00", X.FAR_FUTURE, None]
    now = F.lit(dt.datetime(2024, 5, 1)).cast("timestamp_ntz")
    ts = [dt.datetime(2024, 4, 1), dt.datetime(2024, 4, 20), None]
    assert one(spark, lambda c: X.stale_or_never(c, now), *ts, kind="timestamp_ntz") == [True, False, True]
    assert one(spark, lambda c: X.lookback(c, now, 720), *ts, kind="timestamp_ntz") == [True, True, None]
    for hours in (0, 721, 1.5):
        with pytest.raises(ValueError):
            X.lookback(F.col("v"), now, hours)


def test_classes_and_picks(spark):
    rows = spark.createDataFrame([(None, True), (90, True), (50, None), (50, True)], "level int, hit boolean")
    assert [r[0] for r in rows.select(X.classified(F.col("level"), F.col("hit"), 70)).collect()] == [None, False, False, True]
    movie = "array<struct<iso_3166_1:string,release_dates:array<struct<certification:string,type:int>>>>"
    tv = "array<struct<iso_3166_1:string,rating:string>>"
    data = [
        ([("GB", [("15", 3)]), ("US", [("R", 1), ("PG", 3)])], [("US", "TV-Y")]),
        ([("US", [("", 3), ("G", 4)])], [("GB", "x"), ("US", "")]),
        ([("US", [("", 3)])], []),
        (None, None),
    ]
    got = spark.createDataFrame(data, f"m {movie}, t {tv}").select(*X.certification(F.col("m"), F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("PG", "TV-Y"), ("G", "NR"), ("NR", "NR"), ("NR", "NR")]
    video = "array<struct<site:string,type:string,official:boolean,key:string>>"
    clips = [[("Vimeo", "Trailer", True, "v"), ("YouTube", "Clip", True, "c"), ("YouTube", "Trailer", False, "t"), ("YouTube", "Trailer", True, "o")], [("YouTube", "Clip", True, "c")], []]
    assert one(spark, X.trailer_url, *clips, kind=video) == ["https://www.youtube.com/watch?v=o", "https://www.youtube.com/watch?v=c", None]
    us = "struct<flatrate:array<struct<provider_id:int>>,ads:array<struct<provider_id:int>>,flatrate_and_buy:array<struct<provider_id:int>>>"
    assert one(spark, X.on_provider, ([(9,)], [(1796,)], None), ([(9,)], None, None), (None, None, None), kind=us) == [True, False, False]
