"""Mixing, packing and the pipeline."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm.mixing import fit, fit_steps, mix, rates
from weftline.llm.packing import column_generation, knapsack, pack, vocabulary

TABLES = "/root/testdata/sf0.001"


def test_knapsack_and_plan_are_exact():
    rng = np.random.default_rng(2)
    value, pattern = knapsack(np.array([0.1, 0.25, 0.9]), 7)
    assert abs(value - 1.9) < 1e-9 and pattern.tolist() == [1, 0, 2]
    for size in (8, 64):
        for _ in range(10):
            demand = rng.integers(0, 40, size) * (rng.random(size) < 0.5)
            plan = column_generation(demand, size)
            made = sum((p * n for p, n in plan), np.zeros(size, dtype=int))
            assert (made == demand).all() and all(p @ np.arange(1, size + 1) <= size for p, _ in plan)
            rooms: list[int] = []  # first fit, largest first
            for c in np.repeat(np.arange(1, size + 1), demand)[::-1]:
                k = next((k for k, r in enumerate(rooms) if r >= c), None)
                if k is None:
                    rooms.append(size - c)
                else:
                    rooms[k] -= c
            assert sum(n for _, n in plan) <= len(rooms)
    assert column_generation(np.zeros(4, dtype=int), 4) == []


def test_packing_round_trip(spark):
    texts = ["Hello, world's 42 <|endoftext|> naïve\u00a0ÉTÉ don't_x", "", None, "日本語 text İstanbul ŉ \u0130", "a\u2003b \x1c c", "the same words " * 3000, "x", "x", "word " * 4095, "e\u0301 combining ﬁ × ÷ ẞ"]
    texts += [" ".join(["tok"] * n) for n in range(1, 60)]
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)] + [(6, "x", 1, 2), (None, "no id", 1, 2)], "doc_id long, text string, start int, offset int")
    rows = pack(docs, with_ids=True).collect()
    tokenizer = vocabulary(None).tokenizer
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] and r["length"] > 0
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for k, t in [*enumerate(texts), (None, "no id")]:
        own = sorted(by_doc[k], key=lambda r: r["start"])
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        assert b"".join(bytes(r["ids"]) for r in own) == ids.tobytes() * (2 if k == 6 else 1)
        assert all(r["doc_tokens"] == len(ids) for r in own)
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= total / 4096 * 1.02 + 1
    assert pack(docs.limit(0)).count() == 0


def test_rates_meet_the_targets(spark):
    rng = np.random.default_rng(6)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    t = rng.integers(0, 900, 400)
    weighted = spark.createDataFrame([(int(b), [float(v) for v in a]) for a, b in zip(p, t)], "tokens long, p array<double>")
    for most, share in ((None, [0.6, 0.3, 0.1]), (1.0, [0.2, 0.1, 0.05])):
        targets = np.array(share) * t.sum()
        rate, _ = rates(p, fit_steps(weighted, targets, most, max_steps=300), most)
        assert (rate >= 0).all() and (most is None or (rate <= most).all())
        assert np.abs((rate * t) @ p - targets).max() <= 2e-4 * targets.sum()


def test_rates_meet_the_targets_with_a_rare_domain(spark):
    sharp = 1.5
    rng = np.random.default_rng(7)
    domain = rng.choice(3, 3000, p=[0.79, 0.2, 0.01])
    z = rng.normal(size=(3000, 3)) + sharp * np.eye(3)[domain] + np.log([0.79, 0.2, 0.01])
    p = np.exp(z) / np.exp(z).sum(axis=1)[:, None]
    t = rng.integers(20, 900, 3000)
    weighted = spark.createDataFrame([(int(b), [float(v) for v in a]) for a, b in zip(p, t)], "tokens long, p array<double>").coalesce(1)
    targets = np.array([0.9, 0.05, 0.05]) * t.sum()
    rate = rates(p, fit_steps(weighted, targets, None), None)[0]
    assert np.abs((rate * t) @ p - targets).max() <= 2e-4 * targets.sum()
    # without repeats: a total in reach, and no larger one
    share = np.array([0.9, 0.07, 0.03])
    steps, total, met = fit(weighted, share, float(((t @ p) / share).min()), 1.0, True, 1000, 1e-4)
    got = (rates(p, steps, 1.0)[0] * t) @ p
    assert met and total > 0 and np.abs(got - share * total).max() <= 2e-4 * total
    with pytest.warns(UserWarning, match="can't be met"):
        fit_steps(weighted, share * total * 1.02, 1.0, max_steps=60)


def test_mixing_small_and_odd_tables(spark):
    rows = [(k, ("good " if k % 3 else "bad ") * (20 + k), "c") for k in range(90)] + [(90, None, "c"), (91, "", "c"), (None, "good words", "c"), (0, "bad " * 20, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rate string")
    labels = spark.createDataFrame([(k, "good" if k % 3 else "bad") for k in range(60)] + [(None, "bad"), (1, None)], "id long, domain string")
    out = mix(docs, labels, {"good": 0.9, "bad": 0.1}).collect()
    assert len(out) == len(rows)
    tokens = sum(r["tokens"] for r in out)
    good = sum(r["rate"] * r["tokens"] * r["p"][0] for r in out)
    assert abs(good - 0.9 * tokens) < 0.01 * tokens and all(r["rate"] >= 0 and r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in out)
    thin = mix(docs, labels, {"good": 0.9, "bad": 0.1}, total="no repeats", most=1.0).collect()
    assert all(r["copies"] <= 1 for r in thin)
    even = mix(docs, labels.limit(0), {"good": 0.9, "bad": 0.1}).collect()
    assert {tuple(r["p"]) for r in even} == {(0.5, 0.5)}
    assert mix(docs.limit(0), labels, {"good": 1.0, "bad": 1.0}).count() == 0


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name.replace(" ", "_"))) + "/t"
        stage(spark, out[-1], TABLES).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_keep_the_columns_and_take_effect(stages):
    docs, good, lined, single, mixed, packed = stages
    for df in (good, lined, single, mixed):
        assert df.columns == docs.columns
    counts = [df.count() for df in stages[:5]]
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0] and counts[-1] > 0.5 * counts[0]
    assert lined.where(F.length("text") != F.col("n_chars")).count() == 0
    assert single.join(lined, "doc_id", "left_anti").count() == 0


def test_lines_stay_unique_and_documents_whole(stages):
    *_, mixed, packed = stages
    lines = stages[2].select(F.explode(F.split("text", "\n")).alias("l")).where(F.size(F.split(F.trim("l"), r"\s+")) >= 6)
    assert lines.groupBy("l").count().where("count > 1").count() == 0
    whole = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
    assert whole.count() == mixed.count() and whole.where("n <> m").count() == 0


def test_pipeline_on_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, TABLES).write.parquet(path)
        docs = spark.read.parquet(path)
    assert docs.count() == 0
