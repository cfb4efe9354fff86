"""Operators on pairs: documents, lines, vectors; each against brute force."""

import random
import re
import time

import numpy as np
import pytest

import weftline.llm.lines as lines_module
from weftline.llm.lines import _between_groups, _with_the_largest, dedup_lines
from weftline.llm.minhash import grouped, near_duplicates
from weftline.llm.shingles import band_keys, shingle_set, sketches, word_hashes
from weftline.llm.vectors import near_vectors


def closure(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def plain_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))}


def near_copies(rng, n, words=60):
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(5)):
            own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_shingle_sets_count_like_tuples():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["a", "B", "b", "é", " ", " ", "\n", "\x1c"]) for _ in range(rng.randrange(50)))
        for width in (2, 5):
            assert len(shingle_set(text, width)) == len(plain_set(text, width)), repr(text)
    assert len(shingle_set(None, 2)) == 0 and len(np.intersect1d(shingle_set("A b", 5), shingle_set("a B", 5))) == 1


def test_words_that_a_plain_polynomial_confuses():
    a = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    assert len(np.unique(word_hashes(f"{a} {b}"))) == 2
    assert len(shingle_set(f"{a} {b} {a} {a}", 2)) == 3
    long = "x" * (1 << 24) + "y" * 10
    assert len(np.unique(word_hashes(f"{long} {long} {long}z"))) == 2


def test_sketches_are_full_and_estimate_the_similarity():
    rng = np.random.default_rng(4)
    for n in (1, 3, 40, 2000):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = a.copy()
        b[: n // 5] = rng.integers(0, 2**63, n // 5, dtype=np.uint64)
        s = sketches([np.unique(a), np.unique(b)], 512)
        assert (s != np.uint64(2**64 - 1)).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - true) < 0.12
    assert band_keys(s, 4).shape == (2, 128)


@pytest.mark.parametrize("small,block", [(32, 1024), (2, 3)])
def test_near_duplicates_against_brute_force(spark, small, block):
    rng = random.Random(7)
    texts = [t for n in (2, 3, 12, 25) for t in near_copies(rng, n)] + near_copies(rng, 3, 4)
    texts += ["", None, "one", "One", "one two", " \n", "word " * 30_000, "word " * 20_000, texts[0], texts[0], texts[5].upper()]
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(30)) for _ in range(20)]
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, 0, "x") for i, t in zip(ids, texts)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, n long, component_id string")
    for width in (2, 5):
        sets = {i: plain_set(t, width) for i, t, *_ in rows}
        links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        want = closure(ids, links)
        got = near_duplicates(docs, width=width, small=small, block=block).collect()
        assert len(got) == len(rows) + 1
        assert {r["doc_id"]: r["component_id"] for r in got} == want
        assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["doc_id"] == want[r["doc_id"]]) for r in got)


def test_near_duplicates_odd_rows(spark):
    kind = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], kind)).count() == 0
    text = " ".join(f"a{k}" for k in range(50))
    rows = [(None, text), (5, text), (None, "other words " * 3), (5, "quite another text"), (7, text + " end")]
    got = [tuple(r) for r in near_duplicates(spark.createDataFrame(rows, kind), width=2).select("doc_id", "component_id", "kept").collect()]
    assert sorted(got, key=str) == sorted([(None, 5, False), (5, 5, True), (None, None, True), (5, 5, True), (7, 5, False)], key=str)


def test_grouped_sides():
    a = np.arange(10, dtype=np.uint64)
    sets = [a, a + np.uint64(1), a + np.uint64(100), a + np.uint64(1)]
    assert grouped(sets, 80, None) == [0, 0, 2, 0]
    assert grouped(sets, 80, np.array([True, True, False, True])) == [0, 1, 2, 3]


def similar(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a):
        prev, d[0] = d[0], i + 1
        for j, y in enumerate(b):
            prev, d[j + 1] = d[j + 1], min(d[j + 1] + 1, d[j] + 1, prev + (x != y))
    return 5 * d[-1] <= max(len(a), len(b))


def test_lines(spark):
    rng = random.Random(1)
    line = lambda n: " ".join(f"word{rng.randrange(10**5)}" for _ in range(n))
    a, b, c = line(40), line(30), line(8)
    near = a.replace(" ", ", ", 3).upper() + "!"  # the same after normalising
    fuzzy = a + " s"
    docs = [(1, f"{a}\nshort line\n{b}", "k", 9), (2, f"{b}\nshort line\n{near}", "k", 9), (3, f"{fuzzy}\n{c}\n{c}", "k", 9), (4, None, "k", 9), (5, "", "k", 9), (6, f"{a}", "k", 9), (7, "z" * 100_000 + " " + line(300) * 20, "k", 9), (1, f"{a}\nshort line\n{b}", "k", 9), (None, b, "k", 9)]
    out = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string, lines string, pos long"))
    assert out.columns == ["doc_id", "text", "pos", "lines"]
    got = {r["doc_id"]: (r["text"], r["lines"]["n_lines"], r["lines"]["n_kept"]) for r in out.collect()}
    assert out.count() == len(docs)
    assert got[1] == (f"{a}\nshort line", 3, 2)  # the null id sorts first and keeps b
    assert got[None] == (b, 1, 1)
    assert got[2] == ("short line", 3, 1)
    assert got[3] == (c, 3, 1)
    assert got[4] == (None, 0, 0) and got[5][0] == "" and got[6] == ("", 1, 0) and got[7][2] == 1
    assert similar(a, fuzzy)
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fuzzy_lines_of_a_large_group(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(k, " ".join(base[:-1] + [f"{base[-1]}{k % 7}"])) for k in range(300)]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r["doc_id"] for r in out.where("lines.n_kept = 1").collect()] == [0]


def test_lines_longer_than_the_exact_comparison(spark):
    rng = random.Random(4)
    words = [f"{rng.randrange(10**7)}"[: rng.randint(1, 7)] for _ in range(700)]
    change = lambda share: " ".join("other" if rng.random() < share else w for w in words)
    rows = [(1, " ".join(words)), (2, change(0.08)), (3, change(0.5))]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["lines"]["n_kept"] for r in out.collect()} == {1: 1, 2: 0, 3: 1}


def test_groups_of_a_wide_bucket(spark):
    placed = [(1, h, 50, 7 if h < 30 else h) for h in range(40)] + [(2, h, 50, h) for h in range(5)] + [(3, h, 50, 3) for h in range(60)]
    got = [tuple(r) for r in _with_the_largest(spark.createDataFrame(placed, "key long, h long, size int, own long"), 32).collect()]
    assert {(b, own, own2) for _, b, own, own2 in got} == {(h, h, 7) for h in range(30, 40)} and all(a < 30 for a, *_ in got)
    assert 20 <= len(got) <= 30


def test_pairs_between_groups_are_complete(spark):
    rng = random.Random(2)
    size = {h: rng.randint(20, 200) for h in range(1000)}
    placed = [(key, h, size[h], h % groups) for key, groups in ((1, 5), (2, 1), (3, 40)) for h in rng.sample(range(1000), 60)]
    got = [tuple(r) for r in _between_groups(spark.createDataFrame(placed, "key long, h long, size int, own long"), 7).collect()]
    want = {(a, b, x, y) for k, a, m, x in placed for q, b, n, y in placed if k == q and x < y and 5 * min(m, n) >= 4 * max(m, n)}
    assert want and len(got) == len(set(got)) and set(got) == want


def test_unlike_lines_of_a_bucket_make_no_rows_of_pairs(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    shared = [word() for _ in range(16)]
    lines = [shared + [word() for _ in range(8)] for _ in range(150)]
    lines += [x[:-1] + [word()] for x in lines[:20]]
    texts = [" ".join(x) for x in lines]
    counts = []
    verified = lines_module._verified
    monkeypatch.setattr(lines_module, "_verified", lambda pairs, texts: counts.append(pairs.count()) or verified(pairs, texts))
    out = dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    gone = {r["doc_id"] for r in out.where("lines.n_kept = 0").collect()}
    assert gone == set(range(150, 170))
    assert sum(counts) <= 6 * len(texts)

    # in blocks of 16, the pairs within the similarity are those of a brute-force comparison
    placed = spark.createDataFrame([(key, h, len(texts[h]), h) for key in (1, 2) for h in (*range(40), *range(150, 170))], "key long, h long, size int, own long")
    by_h = spark.createDataFrame(list(enumerate(texts)), "h long, norm string")
    got = [(r["a"], r["b"]) for r in _between_groups(placed, 16, lambda ends: by_h.join(ends.distinct(), "h")).collect()]
    assert sorted(got) == [(k, 150 + k) for k in range(20)]


def test_members_of_the_largest_group_make_no_rows(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    base = [word() for _ in range(30)]
    put = lambda x, *at: [word() if k in at else w for k, w in enumerate(x)]
    lines = [base] + [put(base, k % 30) for k in range(99)] + [put(base, *range(4, 10))]  # the last one is a member too, not like the first line
    lines += [put(lines[100], *range(22, 27)), put(base, *range(2, 9))] + [[word() for _ in range(30)] for _ in range(10)]
    texts = [" ".join(x) for x in lines]
    own = [0 if h < 101 else h for h in range(len(texts))]
    want = [(a, b) for a in range(len(texts)) for b in range(101, len(texts)) if a < b and similar(texts[a], texts[b])]
    assert (100, 101) in want and not similar(texts[0], texts[101])
    counts = []
    guests = lines_module._guests
    monkeypatch.setattr(lines_module, "_guests", lambda *x: counts.append(guests(*x).groupBy("side").count().collect()) or guests(*x))
    by_h = spark.createDataFrame(list(enumerate(texts)), "h long, norm string")
    placed = spark.createDataFrame([(1, h, len(t), own[h]) for h, t in enumerate(texts)], "key long, h long, size int, own long")
    got = [(r["a"], r["b"]) for r in _between_groups(placed, 16, lambda ends: by_h.join(ends.distinct(), "h")).collect()]
    assert sorted(got) == want
    # lines unlike all of the group don't meet its blocks, of which there are seven at least
    assert sum(r["count"] for r in counts[0] if r["side"] == 1) <= 2 * 3 * 7


def edit_distance(s, t):
    row = np.arange(len(t) + 1)
    codes, places = np.array([ord(c) for c in t]), np.arange(len(t) + 1)
    for i, c in enumerate(s):
        up = np.concatenate([[i + 1], np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)))])
        row = np.minimum.accumulate(up - places) + places
    return int(row[-1])


def edited(rng, text, share):
    """The text with letters and whole words changed, taken out and put in, a piece moved away from an end, or runs of a word made longer."""
    words, kind = text.split(" "), rng.randrange(4)
    k = max(1, int(len(words) * share))
    if kind == 0:
        return "".join(rng.choice(["", c + "é", "q"]) if rng.random() < share else c for c in text)
    if kind == 1:
        return " ".join(words[k:] if rng.random() < 0.5 else words[:-k] + words[:k])
    if kind == 2:
        return " ".join(w for word in words for w in [word] * (1 if rng.random() > share else rng.choice([0, 2])))
    return " ".join(w if rng.random() > share else rng.choice(words) for w in words)


def test_similar_lines_are_told_exactly(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["th", "er", "on", "é", "a", "ion", "x"]) for _ in range(rng.randint(1, 4)))
    rows = [("", ""), ("a", ""), ("abcde", "abcd"), ("ab" * 40, "ab" * 50), ("ab" * 39, "ab" * 50)]
    for _ in range(500):
        text = " ".join(word() for _ in range(rng.choice([3, 10, 25, 60])))
        text = " ".join(w for x in text.split() for w in [x] * rng.choice([1, 1, 9])) if rng.random() < 0.2 else text
        other = edited(rng, text, rng.choice([0.02, 0.1, 0.2, 0.3])) if rng.random() < 0.85 else " ".join(word() for _ in text.split())
        rows.append((text, other) if rng.random() < 0.5 else (other, text))
    df = spark.createDataFrame(rows, "s string, t string").withColumn("by_ends", lines_module._similar("s", "t")).withColumn("by_cuts", lines_module._aligned("s", "t"))
    like, cuts = 0, 0
    for r in df.collect():
        want = edit_distance(r["s"], r["t"]) <= max(len(r["s"]), len(r["t"])) // 5
        assert r["by_ends"] == want and (want or not r["by_cuts"]), r
        like, cuts = like + want, cuts + r["by_cuts"]
    assert 150 < like < 450 and cuts > 0.8 * like


def test_long_near_copies_cost_no_full_table(spark):
    rng = random.Random(6)
    runs = [["".join(rng.choice("abcdefghij") for _ in range(6))] * 1400 for _ in range(8)]
    letters = "".join(rng.choice("abcdefghij ") for _ in range(60_000))
    pairs = [(" ".join(w for run in runs for w in run), " ".join(w for run in runs for w in run[100:])), (letters, "".join(c if i % 25 else "k" for i, c in enumerate(letters)))]
    rows = [x for k, pair in enumerate(pairs) for x in ((2 * k, pair[0]), (2 * k + 1, pair[1]))]
    texts, ends = spark.createDataFrame(rows, "h long, norm string"), spark.createDataFrame([(0, 1), (2, 3)], "a long, b long")
    spark.createDataFrame([("a", "b")], "s string, t string").select(lines_module._similar("s", "t")).collect()
    start = time.time()
    assert lines_module._verified(ends, texts).count() == 2
    assert time.time() - start < 12


@pytest.mark.parametrize("words", [10, 20, 50])
def test_fuzzy_lines_recall(spark, words):
    rng = random.Random(words)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice((2, 3, 4, 6, 8, 10))))
    common = [word() for _ in range(30)]
    rows, near = [], {}
    for k in range(120):
        base = [rng.choice(common) if rng.random() < 0.3 else word() for _ in range(words)]
        own = list(base)
        for at in rng.sample(range(words), rng.randint(1, words // 5)):
            own[at] = word()
        if k % 3 == 2:  # wrong letters instead
            own = [w[:-1] + "q" if rng.random() < 0.1 else w for w in base]
        near[1000 + k] = own != base and similar(" ".join(base), " ".join(own))
        rows += [(k, " ".join(base)), (1000 + k, " ".join(own))]
    out = dedup_lines(spark.createDataFrame([*rows], "doc_id long, text string"))
    gone = {r["doc_id"] for r in out.where("lines.n_kept = 0").select("doc_id").collect()}
    want = {k for k, v in near.items() if v}
    same = {i for i, t in rows if i >= 1000 and t == dict(rows)[i - 1000]}
    assert gone <= want | same and same <= gone
    assert len(want) > 80 and len(gone & want) >= 0.93 * len(want)


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 32))
    x[100:160] = x[100] + rng.normal(size=(60, 32)) * 0.08
    x[160:220] = x[160:161]
    labels = [int(k % 3) if k < 100 else 1 for k in range(300)]
    rows = [(k, [float(v) for v in x[k]], labels[k], 7) for k in range(300)]
    bad = [(300, None, 1, 0), (301, [0.0] * 32, 1, 0), (302, [float("nan")] + [1.0] * 31, 1, 0), (303, [None] + [1.0] * 31, 1, 0), (304, rows[0][1], None, 0), (305, [], 1, 0), (306, [1.0, 2.0], 1, 0)]
    df = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<double>, label int, n_links long")
    got = {r["vec_id"]: r for r in near_vectors(df, block=16).collect()}
    assert len(got) == 307
    u = x / np.linalg.norm(x, axis=1)[:, None]
    close = (u @ u.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(close, False)
    want = closure(range(300), [(a, b) for a, b in zip(*np.nonzero(close)) if a < b])
    found = sum(got[k]["n_links"] for k in range(300))
    assert 0.9 * close.sum() <= found <= close.sum()
    assert sum(got[k]["component_id"] == want[k] for k in range(300)) >= 295
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(300, 307))
    assert near_vectors(df.limit(0)).count() == 0
    assert near_vectors(df.where("vec_id >= 300")).where("n_links > 0").count() == 0


def test_vectors_of_a_large_dense_group(spark):
    rng = np.random.default_rng(8)
    n, dim = 10_000, 64
    x = rng.normal(size=(n, dim))
    x[: n // 3] = x[0] + rng.normal(size=(n // 3, dim)) * 0.1
    u = x / np.linalg.norm(x, axis=1)[:, None]
    close = u @ u.T >= 0.98
    np.fill_diagonal(close, False)
    df = spark.createDataFrame([(k, v, 1) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in near_vectors(df).collect()}
    found = sum(r["n_links"] for r in got.values())
    assert 0.9 * close.sum() <= found <= close.sum()
    want = closure(range(n), [(int(np.flatnonzero(close[k])[0]), k) for k in range(n) if close[k].any()])
    assert all(got[k]["component_id"] == want[k] for k in range(n))


@pytest.mark.parametrize("n", [200, 2000])
def test_vectors_planted_in_noise(spark, n):
    rng = np.random.default_rng(n)
    base = rng.normal(size=(n, 48))
    near = base[: n // 10] + 0.02 * rng.normal(size=(n // 10, 48))
    rows = [(k, [float(v) for v in x], 1 if k % n < n // 2 else 2) for k, x in enumerate(np.concatenate((base, near)))]
    rows += [(0, rows[0][1], 1), (None, rows[0][1], 1), (n + 7, rows[1][1], None)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], []).append(r)
    pairs = [(k, n + k) for k in range(1, n // 10) if k != 7]
    hit = sum(by_id[b][0]["component_id"] == a and by_id[b][0]["n_links"] == 1 for a, b in pairs)
    assert hit >= 0.9 * len(pairs)
    # a repeated row and one without an id are vectors of their own; ties go to the smallest id
    assert [r["n_links"] for r in by_id[0]] == [3, 3] and by_id[None][0]["component_id"] == 0 and not by_id[None][0]["kept"]
    assert sorted(r["n_links"] for r in by_id[n + 7]) == [0, 1]
