"""Commits that count whole or not at all, and keyed tables against a dictionary."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import store
from weftline.operators.store import ConcurrentCommit, KeyedStore, read_snapshot, write_snapshot

KIND = "k string, q int, v long, w string"


def held(table):
    return sorted((tuple(r) for r in table.read().collect()), key=str)


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "t")
    write_snapshot(spark.range(3), root)
    write_snapshot(read_snapshot(spark, root).union(spark.range(1)), root, ("stream", 4))
    assert read_snapshot(spark, root).count() == 4
    write_snapshot(spark.range(9), root, ("stream", 4))  # the batch comes again
    assert read_snapshot(spark, root).count() == 4
    write_snapshot(spark.range(9), root, ("stream", 5))
    assert read_snapshot(spark, root).count() == 9


def test_a_run_that_dies_between_data_and_commit(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    table = KeyedStore.create(spark.createDataFrame([("a", 1, 1, "x"), ("b", 1, 2, "y")], KIND), root, ["k"], buckets=4)
    write_snapshot(spark.range(3), f"{root}-s")
    new = spark.createDataFrame([("a", 1, 5, "z")], KIND)

    def dies(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(store.CommitLog, "commit", dies)
        for change in (lambda: table.replace(new, new, ("s", 1)), lambda: write_snapshot(spark.range(7), f"{root}-s")):
            with pytest.raises(RuntimeError, match="killed"):
                change()
    again = KeyedStore(spark, root)
    assert held(again) == [("a", 1, 1, "x"), ("b", 1, 2, "y")] and read_snapshot(spark, f"{root}-s").count() == 3
    assert not again.done(("s", 1))
    assert again.replace(new, new, ("s", 1)) and again.done(("s", 1))
    assert not again.replace(new.withColumn("v", F.lit(9)), new, ("s", 1)) and not again.upsert(new, ["v"], ["q"], txn=("s", 0))
    assert held(KeyedStore(spark, root)) == [("a", 1, 5, "z"), ("b", 1, 2, "y")]
    with pytest.raises(ConcurrentCommit):
        table.replace(new, new, ("other", 1))
    with pytest.raises(FileNotFoundError):
        KeyedStore(spark, str(tmp_path / "none"))


def test_against_a_dictionary(spark, tmp_path):
    rng = random.Random(6)
    value = lambda: (rng.choice("abcdefgh") if rng.random() < 0.9 else None, rng.choice([1, 2, None]), rng.randrange(100), rng.choice(["x", None]))
    rows = {r[:2]: r for r in (value() for _ in range(12))}
    table = KeyedStore.create(spark.createDataFrame(list(rows.values()), KIND), str(tmp_path / "t"), ["k", "q"], buckets=5)
    for step in range(5):
        if step % 2:
            source = [(*value()[:3], s) for s in range(4)]
            table.upsert(spark.createDataFrame(source, "k string, q int, v long, s int"), ["v"], ["s"], {"w": F.lit("new")})
            for k, q, v, _ in source:
                rows[k, q] = (k, q, v, rows[k, q][3] if (k, q) in rows else "new")
        else:
            new = {r[:2]: r for r in (value() for _ in range(3))}
            gone = [rng.choice(list(rows))]
            touched = [*new, *gone]
            table.replace(spark.createDataFrame(list(new.values()), KIND), spark.createDataFrame(touched, "k string, q int"))
            for g in gone:
                rows.pop(g, None)
            rows |= new
        if step == 3:
            assert table.compact(2) > 0
    assert held(table) == held(KeyedStore(spark, str(tmp_path / "t"))) == sorted(rows.values(), key=str)
    some = list(rows)[:3]
    assert sorted((tuple(r) for r in table.matching(spark.createDataFrame(some, "k string, q int")).collect()), key=str) == sorted((rows[s] for s in some), key=str)
    table.vacuum(keep=1)
    assert held(KeyedStore(spark, str(tmp_path / "t"))) == sorted(rows.values(), key=str)


def test_a_small_change_touches_few_files(spark, tmp_path):
    root = str(tmp_path / "t")
    table = KeyedStore.create(spark.range(2000).select(F.col("id").alias("k"), F.lit(0).alias("v")), root, ["k"], buckets=16)
    files = lambda: {str(p) for p in (tmp_path / "t" / "data").rglob("*.parquet")}
    before = files()
    table.upsert(spark.createDataFrame([(3, 1, 0)], "k long, v int, s int"), ["v"], ["s"])
    assert len(files() - before) == 1
    read = table.matching(spark.createDataFrame([(3,)], "k long"))
    assert len(read.inputFiles()) == 2 and [tuple(r) for r in read.collect()] == [(3, 1)]
    assert table.read().where("v = 1").count() == 1 and table.read().count() == 2000


def test_groups_of_rows_and_empty_tables(spark, tmp_path):
    table = KeyedStore.create(spark.createDataFrame([("a", 1, 1, None), ("a", 2, 2, None), (None, 1, 3, None)], KIND), str(tmp_path / "t"), ["k"], buckets=3)
    table.replace(spark.createDataFrame([("a", 7, 7, None)], KIND), spark.createDataFrame([("a",), (None,), ("never",)], "k string"))
    assert held(table) == [("a", 7, 7, None)]
    table.replace(spark.createDataFrame([], KIND), spark.createDataFrame([("a",)], "k string"))
    assert held(table) == [] and table.compact(1) > 0 and held(table) == []
    empty = KeyedStore.create(spark.createDataFrame([], KIND), str(tmp_path / "e"), ["k"])
    assert held(empty) == []
    empty.upsert(spark.createDataFrame([("z", 1, 1, "s")], KIND), ["q", "v"], ["v"])
    assert held(empty) == [("z", 1, 1, None)]
