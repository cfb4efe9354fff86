"""Operators that judge each text by itself: quality rules, languages, licences."""

import os
import random
import re
import textwrap
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from weftline.llm.langid import identify_languages, normalise
from weftline.llm.licenses import KNOWN, digest, known_licenses, scan_licenses
from weftline.llm.quality import COUNTS, learn_rules, quality_rules, text_counts

DOCS = "doc_id long, text string, lang string, quality string"


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:]))
    twice = Counter(windows)
    hit = {k + j for k, w in enumerate(windows) if twice[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_counts_against_plain_python():
    rng = random.Random(3)
    texts = [None, "", " \t\n", "a", "a b", "é ü x\x1cy", "a b c a b c", "x\n x\nx\n\n\n", "# * $"]
    for _ in range(300):
        texts.append("".join(rng.choice(["a", "b", "ç", "|", "#", " ", " ", "\n", "\t", "\x0b"]) for _ in range(rng.randrange(60))))
    for t in texts:
        assert text_counts(t)[:5] == plain_counts(t), repr(t)
    assert len(COUNTS) == len(text_counts("x"))


def test_rules_separate_a_conjunction_and_give_up_on_noise():
    rng = np.random.default_rng(1)
    x = {"a": rng.random(900), "b": rng.random(900)}
    bad = (x["a"] > 0.7) & (x["b"] < 0.4)
    rules = learn_rules(x, bad)
    said = np.zeros(900, dtype=bool)
    for r in rules:
        hit = np.ones(900, dtype=bool)
        for t in r:
            hit &= t.holds(x)
        said |= hit
    assert (said == bad).mean() > 0.97 and {t.feature for t in rules[0]} == {"a", "b"}
    assert learn_rules(x, rng.random(900) < 0.1) == []
    assert learn_rules({"a": np.array([])}, np.array([], dtype=bool)) == []


def test_quality_rules_learn_from_labels_and_keep_other_columns(spark):
    good = [(k, " ".join(f"w{k}x{j}" for j in range(80)), "en", "z") for k in range(60)]
    junk = [(k, " ".join(f"w{k}x{j}###" for j in range(80)), "en", "z") for k in range(60, 100)]
    odd = [(100, None, None, None), (101, "", "en", "z"), (None, good[0][1], "en", "z"), (0, good[0][1], "en", "z"), (102, "same words here " * 60, "en", None), (103, "long " + "y" * 200_000, "en", "z")]
    docs = spark.createDataFrame(good + junk + odd, DOCS)
    labels = spark.createDataFrame([(k, int(k < 60), 0) for k in range(0, 100, 2)] + [(None, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    out = quality_rules(docs, labels)
    assert out.columns == docs.columns  # a column called quality gives way
    rows = out.select("doc_id", "quality.*").collect()
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert kept == set(range(60)) | {None}
    assert all(r["rule"] and "symbols" in r["rule"] for r in rows if r["doc_id"] in range(60, 100))
    assert {r["doc_id"] for r in rows if r["base_failed"]} == {100, 101, 102, 103}
    assert quality_rules(docs.limit(0), labels).count() == 0
    assert quality_rules(docs, labels.limit(0)).where("quality.kept").count() == 102


def test_languages_held_out(spark):
    rng = random.Random(5)
    syllables = {"aa": ["ka", "lo", "mi", "the"], "bb": ["zu", "ver", "ein", "sch"], "cc": ["que", "ción", "los", "ado"]}
    rows = []
    for k in range(150):
        lang = rng.choice(list(syllables))
        rows.append((k, " ".join("".join(rng.choices(syllables[lang], k=rng.randrange(1, 4))) for _ in range(60)), lang))
    rows += [(200, None, "aa"), (201, "123 !!", "bb"), (202, "", None), (None, rows[0][1], "aa"), (203, rows[1][1] * 300, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in identify_languages(docs, F.crc32(F.col("doc_id").cast("string")) % 3 == 1).collect()}
    truth = {k: lang for k, _, lang in rows[:150]}
    held = [k for k in truth if out[k]["held_out"]]
    assert held and sum(out[k]["lang_pred"] == truth[k] for k in held) >= 0.95 * len(held)
    assert [out[k]["lang_pred"] for k in (200, 201, 202)] == ["und"] * 3
    assert out[203]["lang_pred"] == truth[1] and all(0 <= r["score"] <= 1 for r in out.values())
    assert identify_languages(docs.limit(0), F.lit(False)).count() == 0


def test_licences(spark):
    mit = next(t for i, k, t in KNOWN if i == "MIT" and k == "text")
    british = "Copyright (c) 2020 Someone\n\n" + mit.replace("MIT License", "MIT Licence").upper().replace(" ", "  ")
    rows = [(1, british), (2, mit + " And more."), (3, "Some text.\n  released under the MIT licence!\nLicensed under CC BY 4.0."), (4, None), (5, ""), (6, "...\n!!"), (1, british), (7, "a line\n" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = scan_licenses(docs, known_licenses(spark))
    got = sorted((r["doc_id"], r["license_id"], r["notices"], r["n_notices"]) for r in out.collect())
    assert got == [(1, "MIT", "", 0), (1, "MIT", "", 0), (2, None, "", 0), (3, None, "CC-BY-4.0,MIT", 2), (4, None, "", 0), (5, None, "", 0), (6, None, "", 0), (7, None, "", 0)]
    assert out.where("doc_id IN (4, 5, 6)").where("digest IS NOT NULL").count() == 0
    shuffled = scan_licenses(docs, known_licenses(spark), max_broadcast=0)
    assert sorted(map(tuple, shuffled.collect()), key=str) == sorted(map(tuple, out.collect()), key=str)
    assert scan_licenses(docs.limit(0), known_licenses(spark)).count() == 0
    assert spark.range(1).select(digest(F.lit("The  Licence"))).first()[0] == spark.range(1).select(digest(F.lit("the license."))).first()[0]


def test_languages_of_texts_without_letters(spark):
    assert [normalise(x) for x in (None, "", "½ ² ① 12 _", "́ !", "ABC½d", "नमस्ते 5")] == ["", "", "", "", "abc d", "नमस्ते"]
    rows = [(k, "some english words here " * 3, "en") for k in range(9)] + [(9, "½ ②", "en"), (9, "½ ②", "en"), (None, None, "en"), (10, "more words", None)]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = identify_languages(docs, F.lit(False)).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["lang_pred"]) for r in got} == {(k, "en") for k in range(9)} | {(9, "und"), (None, "und"), (10, "en")}


def test_whole_licences_in_other_clothes(spark):
    texts = {i: t for i, kind, t in KNOWN if kind == "text"}
    folder = "/usr/share/common-licenses"
    for i, name in (("Apache-2.0", "Apache-2.0"), ("GPL-3.0", "GPL-3"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")):
        if os.path.exists(f"{folder}/{name}"):
            with open(f"{folder}/{name}", encoding="utf-8") as f:
                texts[i] = f.read()
    rows, want = [], {}
    for k, (i, t) in enumerate(texts.items()):
        reflowed = "Copyright (c) 2020 A. N. Other\n" + "\n".join(textwrap.wrap(" ".join(x for x in t.splitlines() if "copyright (" not in x.lower() and "(c)" not in x.lower()), 50)).replace("license", "licence")
        for n, text in enumerate((t, t.upper(), f"{t}\nplus a word")):
            rows.append((10 * k + n, text))
            want[10 * k + n] = i if n < 2 else None
        if "copyright" not in t.lower():
            rows.append((10 * k + 3, reflowed))
            want[10 * k + 3] = i
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, license_id string, digest string")
    assert {r["doc_id"]: r["license_id"] for r in scan_licenses(docs, known_licenses(spark)).collect()} == want
