"""Streams give what the batch operators give."""

import datetime as dt
import random
from pathlib import Path

from pyspark.sql import functions as F

from weftline.operators import works
from weftline.operators.store import KeyedStore
from weftline.streaming import streams


ROW = "k string, l int, seq long, day double, rank int, note string"


def test_newest_wins_in_any_order_of_arrival(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    rng = random.Random(4)
    data = [(rng.choice([*"abcdefgh", None]), rng.choice([1, 2, None]), s, rng.choice([None, 1.0, 2.0, 3.0]), rng.choice([None, s]), rng.choice([None, f"n{s}"])) for s in range(150)]
    stored = [(f"old{k}" if k < 2 else "a", k, -1, 2.5, 7, "stored") for k in range(4)]
    want = {(r["k"], r["l"]): tuple(r)[2:] for r in works.newest_wins(spark.createDataFrame([*stored, *data], ROW), ["k", "l"], "day", "seq").collect()}
    rng.shuffle(data)
    for k in range(3):
        spark.createDataFrame(data[k * 50 : k * 50 + 50], ROW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = []
    q = streams.newest_wins_stream(rows, ["k", "l"], "day", "seq", spark.createDataFrame(stored, ROW)).writeStream.foreachBatch(lambda df, n: out.extend((n, *r) for r in df.collect())).outputMode("update")
    q.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {(k, quality): rest for _, k, quality, *rest in sorted(out, key=lambda r: r[0])}
    untouched = {(f"old{k}", k) for k in range(2)}
    assert got == {key: list(row) for key, row in want.items() if key not in untouched and (key != ("a", 3))}
    state = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "rows").load().select("list_element.*")
    assert {(r["k"], r["l"]): tuple(r)[2:] for r in works.newest_wins(state, ["k", "l"], "day", "seq").collect()} == want


def test_newest_wins_in_a_keyed_store(spark, tmp_path):
    rng = random.Random(8)
    data = [(rng.choice([*"abcdefgh", None]), rng.choice([1, 2, None]), s, rng.choice([None, 1.0, 2.0, 3.0, 4.0, 5.0]), rng.choice([None, s]), rng.choice([None, f"n{s}"])) for s in range(200)]
    stored = [(f"old{k}" if k < 2 else "a", k, -1, 2.5, 7, "stored") for k in range(4)]
    want = sorted(map(tuple, works.newest_wins(spark.createDataFrame([*stored, *data], ROW), ["k", "l"], "day", "seq").collect()), key=str)
    rng.shuffle(data)
    store = KeyedStore.create(spark.createDataFrame(stored, ROW), str(tmp_path / "table"), ["k", "l"], buckets=4)
    for part in (data[:90], data[90:150], [("a", 2, -1, 2.5, 8, "again")] + data[150:]):
        spark.createDataFrame(part, ROW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.newest_wins_table(rows, store, "day", "seq", str(tmp_path / "state")).awaitTermination()
    held = KeyedStore(spark, str(tmp_path / "table")).read()
    assert sorted(map(tuple, works.newest_wins(held, ["k", "l"], "day", "seq").collect()), key=str) == want
    # no more is held than can still win: none is outdated by a later one
    for key in {r[:2] for r in want}:
        own = sorted((r for r in held.collect() if (r["k"], r["l"]) == key), key=lambda r: -r["seq"])
        days = [r["day"] for r in own]
        assert None not in days[:-1] and (days[:-1] if days[-1] is None else days) == sorted({d for d in days if d is not None})


def test_no_row_of_newest_wins_passes_through_python(spark):
    from weftline.plans import books

    states = lambda: set(Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).glob("**/state/**/*.zip"))  # noqa: E731 - of stores that rows go to from Python
    before = states()
    out = books.QUERIES["stream_newest_wins"](spark, "/root/testdata/sf0.001")
    assert "Python" not in out._jdf.queryExecution().toString() and states() == before


def test_changes_apply_once(spark, tmp_path):
    root, state = str(tmp_path / "table"), str(tmp_path / "state")
    KeyedStore.create(spark.createDataFrame([("a", 1), ("z", 9)], "k string, v long"), root, ["k"], buckets=4)
    at = dt.datetime(2024, 1, 1)
    for rows in ([(1, "a", 5, at), (2, "b", 6, at)], [(2, "b", 6, at)], [(2, "b", 6, at), (3, "a", 1, at)]):
        spark.createDataFrame(rows, "id long, k string, v long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def added(table, batch):
        """Not idempotent: a batch that is applied twice counts twice."""
        both = table.select("k", "v").union(batch.select("k", "v"))
        return both.groupBy("k").agg(F.sum("v").alias("v"))

    def run():
        feed = spark.readStream.schema("id long, k string, v long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        streams.apply_stream(feed, KeyedStore(spark, root), added, state, ["id"]).awaitTermination()
        return sorted(map(tuple, KeyedStore(spark, root).read().collect()))

    assert run() == [("a", 7), ("b", 6), ("z", 9)]
    # the stream doesn't know that its last batch was committed, and runs it again
    last = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert run() == [("a", 7), ("b", 6), ("z", 9)]


def test_new_urls(spark, tmp_path):
    rng = random.Random(3)
    urls = [f"u{rng.randrange(60)}" for _ in range(90)]
    root = str(tmp_path / "known")
    known = streams.KnownUrls.create(spark.createDataFrame([("u1",), ("u2",), (None,)], "url string"), root, blocks=8, buckets=4)
    assert known.maybe_known(spark.createDataFrame([("u1",), ("u2",)], "url string")).where("NOT hit").isEmpty()
    for k in range(2):
        spark.createDataFrame([(u,) for u in [*urls[k * 45 : k * 45 + 45], None]], "url string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    feed = spark.readStream.schema("url string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.new_urls(feed, known, lambda df, n: seen.extend((n, r[0]) for r in df.collect()), str(tmp_path / "state")).awaitTermination()
    assert sorted(u for _, u in seen) == sorted(set(urls) - {"u1", "u2"})
    again = streams.KnownUrls(spark, root)
    assert again.add(spark.createDataFrame([("new",)], "url string"), (str(tmp_path / "state"), 0)).isEmpty()
    assert not again.maybe_known(spark.createDataFrame([("new",)], "url string")).isEmpty() and {r[0] for r in again.urls.read().collect()} == set(urls) | {"u1", "u2"}

    def dies(*_):
        raise RuntimeError("killed")

    for sink in (dies, None):  # a batch that fails before its commit is told again in full
        try:
            assert [r[0] for r in again.add(spark.createDataFrame([("late",), ("u1",)], "url string"), ("s", 0), sink).collect()] == ["late"]
        except RuntimeError:
            assert sink is dies
        again = streams.KnownUrls(spark, root)
