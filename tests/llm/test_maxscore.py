"""Exact top-k search against brute force with Python's integers."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.llm.maxscore import Postings, maxscore, quantised, searched, split, top_products

KIND = "vec_id long, embedding array<double>, score long, row int"


def brute(rows, k, scale=64):
    fine = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(scale * x) if abs(x) < 2**40 else int(x) * scale for x in v]) for i, v in fine]
    out = []
    for a, (i, q) in enumerate(whole):
        if i is not None and i % 20 == 0:
            fit = lambda s: max(-(2**63), min(2**63 - 1, s))
            scored = [(-fit(sum(x * y for x, y in zip(q, v))), math.inf if j is None else j) for b, (j, v) in enumerate(whole) if b != a]
            out += [(i, r, None if j == math.inf else j, -s) for r, (s, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(spark, rows, k, **more):
    df = spark.createDataFrame([(i, v, 3, 4) for i, v in rows], KIND)
    return sorted((tuple(r) for r in top_products(df, F.col("vec_id") % 20 == 0, k=k, **more).collect()), key=str)


def test_a_block_gives_all_that_reach_the_threshold():
    rng = np.random.default_rng(3)
    for fill in (1.0, 0.2, 0.02):
        block = [np.floor(rng.normal(0, 9, 30) * (rng.random(30) < fill)) for _ in range(200)]
        postings = Postings(block)
        for q in block[:20]:
            scores = np.array([x @ q for x in block])
            for least in (None, -50, 0, 1, int(np.sort(scores)[-5]), int(scores.max()), int(scores.max()) + 1):
                ((docs, got),) = maxscore(postings, [q], [least])
                want = np.flatnonzero(scores >= (-np.inf if least is None else least))
                assert docs.tolist() == want.tolist() and (got == scores[want]).all()


def test_few_postings_are_traversed():
    """Documents that score in non-essential terms alone are never looked at."""
    rng = np.random.default_rng(5)
    block = [np.concatenate(([k == 7], rng.integers(0, 2, 20))).astype(float) for k in range(500)]
    query = np.array([1000.0, *[1.0] * 20])
    postings = Postings(block)
    ((docs, scores),) = maxscore(postings, [query], [900])
    assert docs.tolist() == [7] and scores[0] == block[7] @ query
    own = split(postings, query, 900)
    assert own.order[own.minor :].tolist() == [0] and 0 in postings.lists


@pytest.mark.parametrize("cells", [1 << 18, 96])
def test_against_brute_force(spark, cells):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 0.13) for _ in range(16)]) for i in range(120)]
    rows += [(200 + i, rows[40][1]) for i in range(40)]  # a large group of copies: ties at the threshold
    rows += [(300 + i, [round(rng.gauss(0, 1)) / 64 if rng.random() < 0.1 else 0.0 for _ in range(16)]) for i in range(40)]
    for k in (1, 5, 30, 500):
        assert found(spark, rows, k, cells=cells) == brute(rows, k)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, None), (40, [nan, 1.0]), (60, [inf, 1.0]), (80, [None, 1.0]), (100, []), (120, [0.0, 0.0]), (None, [1.0, 2.0]), (None, None)]
    rows += [(1, [1.0]), (2, [5.0, 5.0, 5.0]), (3, [-0.001, 0.0]), (140, [-3.0, -4.0, 9.0])]
    assert found(spark, rows, 4) == brute(rows, 4) and found(spark, rows, 50, cells=4) == brute(rows, 50)
    assert found(spark, [], 3) == [] and found(spark, [(0, [1.0])], 3) == [] and found(spark, [(1, [1.0]), (2, [1.0])], 3) == []


def test_large_numbers_stay_exact(spark):
    rows = [(i, [2.0**40 + i, 3.0, -(2.0**30)]) for i in range(30)] + [(50, [1e18, 1.0, 1.0]), (60, [1e300, -1e300, 1.0]), (61, [-1e300, 1.0, 1.0])]
    assert found(spark, rows, 7) == brute(rows, 7)
    assert quantised([1e300], 64)[0] == int(1e300) * 64 and quantised([-0.001], 64)[0] == -1


def test_a_long_row_of_components(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3000)]) for i in range(30)]
    assert found(spark, rows, 5, cells=10_000) == brute(rows, 5)


def test_one_frame_for_all_queries_of_a_block(monkeypatch):
    rng = np.random.default_rng(5)
    x = [v.tolist() for v in rng.normal(size=(300, 16))]
    docs = pd.DataFrame({"row": range(300), "vec": range(300), "named": [k != 7 for k in range(300)], "embedding": x})
    queries = docs.iloc[:100].assign(free=[k % 2 == 0 for k in range(100)], least=100, least_id=2**63 - 1)
    made, frame = [], pd.DataFrame
    monkeypatch.setattr(pd, "DataFrame", lambda *a, **k: made.append(1) or frame(*a, **k))
    got = searched(5, 64)(docs, queries)
    assert len(made) == 1
    whole = np.floor(np.array(x) * 64) @ np.floor(np.array(x) * 64).T
    for q in range(100):
        own = got[got["query"] == q]
        want = sorted((-int(whole[q, d]), d) for d in range(300) if d != q and (q % 2 == 0 or whole[q, d] >= 100))[:5]
        assert [(-s, d) for s, d in zip(own["score"], own["row"])] == want
        assert own["query_id"].isna().all() == (q == 7) and (own["vec"].isna() == (own["row"] == 7)).all()
