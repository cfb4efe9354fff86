"""Fill-in-the-middle against a plain version, and back again."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import infill
from weftline.llm.infill import fill_in_middle, moved, restore


def plainly(doc_id, text, rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts():
    rng = random.Random(4)
    odd = ["a", "\n", "é", "日本", "x\n", "😀", "<", "S>", "<S", "P>", "<M", " ", "\r\n", " ", "\x0b", "\x85", "\x00"]
    out = [None, "", "\n", "\n\n\n", "no end", "one\n", "<P>in it\n", "a<M>", "<S>", "<\nS>\n<P\n>"]
    out += ["".join(rng.choice(odd) for _ in range(rng.randrange(60))) for _ in range(150)]
    return [*out, "line\n" * 50_000, "y" * 300_000 + "\n" + "z" * 10]


@pytest.mark.parametrize("chunk,batch,rate", [(1 << 20, 1 << 23, 100), (7, 40, 60)])
def test_against_a_plain_version(spark, monkeypatch, chunk, batch, rate):
    own = texts() if chunk > 7 else texts()[:-2]
    if chunk == 7:  # the functions themselves: Spark's workers have their own module
        monkeypatch.setattr(infill, "CHUNK", chunk)
        monkeypatch.setattr(infill, "BATCH", batch)
        raw = [(t or "").encode() for t in own]
        for part in infill._batches([len(t) for t in raw]):
            units, cuts, spm, plain = infill._scan(raw[part], list(range(len(raw)))[part], 7, rate, 30)
            made = infill.scatter(raw[part], cuts, spm, plain)
            want = [plainly(k, own[k], rate, 30) for k in range(len(raw))[part]]
            assert [m.decode() for m in made] == [w[4] for w in want] and units.tolist() == [w[0] for w in want]
            assert infill.gather(made, spm, plain) == raw[part]
        return
    rows = [*enumerate(own), (5, own[20]), (None, "with\nno\nid\n"), (2**53 + 1, "large\nid\n")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, form string, n int")
    out = fill_in_middle(docs).withColumn("back", restore(F.col("infill.output"), F.col("infill.form"))).collect()
    assert out[0].asDict().keys() == {"doc_id", "text", "form", "n", "infill", "back"} and len(out) == len(rows)
    for r in out:
        assert tuple(r["infill"]) == plainly(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "") and r["form"] == "x"
    assert {r["infill"]["form"] for r in out} == {"plain", "psm", "spm"}


def test_scatter_and_gather_are_inverse():
    rng = np.random.default_rng(2)
    source = rng.integers(0, 256, 1000).astype(np.uint8)
    starts, shifts = np.array([0, 300, 700]), np.array([700, 0, -700])
    there = moved(source, starts, shifts, 1000)
    assert (there == np.concatenate((source[700:], source[300:700], source[:300]))).all()
    assert (moved(there, starts, shifts, 1000, back=True) == source).all()


def test_an_empty_table_and_null_outputs(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fill_in_middle(docs).count() == 0
    nulls = spark.createDataFrame([(None, None), ("abc", None), ("abc", "plain")], "output string, form string")
    assert [r[0] for r in nulls.select(restore(F.col("output"), F.col("form"))).collect()] == [None, "abc", "abc"]
