"""Operators against golden cases and plain sequential models."""

import datetime as dt
import random

from pyspark.sql import functions as F

from weftline.operators import audit, changes, enrich, graph, ingest, match, reports, tables, works


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(k, 500) for k in range(400, 480)] + [(k, k + 1) for k in range(1000, 1060)]
    parent = {n: n for e in edges for n in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    touched = {n for a, b in edges if a != b for n in (a, b)}
    got = graph.components(spark.createDataFrame(edges + [(None, 1)], "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in got} == {n: root(n) for n in touched} and len(got) == len(touched)


def test_upsert_matches_null_keys_and_overwrites_with_nulls(spark):
    target = spark.createDataFrame([("a", None, 1, "keep"), ("a", "hd", 2, "keep"), (None, None, 3, "keep")], "k string, q string, v int, other string")
    source = spark.createDataFrame([("a", None, 7, 1), ("a", None, None, 2), ("b", None, 8, 1), (None, None, 9, 1)], "k string, q string, v int, seq int")
    got = rows(tables.upsert(target, source, ["k", "q"], ["v"], ["seq"]))
    assert got == sorted([("a", None, None, "keep"), ("a", "hd", 2, "keep"), ("b", None, 8, None), (None, None, 9, "keep")], key=str)
    again = tables.upsert(tables.upsert(target, source, ["k", "q"], ["v"], ["seq"]), source, ["k", "q"], ["v"], ["seq"])
    assert rows(again) == got


def test_run_log(spark, tmp_path):
    for k in range(2):
        tables.append_run(spark, str(tmp_path / "log"), sync_type="x", status="completed", metadata={"n": k})
    assert rows(spark.read.parquet(str(tmp_path / "log")), "id", "metadata") == [(1, '{"n": 0}'), (2, '{"n": 1}')]


TITLES = "id string, title string, type string, year int"


def test_exact_names_and_years(spark):
    titles = spark.createDataFrame([("1", "Frozen", "movie", 2013), ("2", "FROZEN!", "movie", 2010), ("3", "Frozen", "series", 2013), ("4", "Twin", "movie", 2000), ("5", "Twin", "movie", 2004), ("6", "Lone", "movie", None), ("7", "Pair", "movie", None), ("8", "Pair", "movie", 1990)], TITLES)
    q = [(1, "frozen", "movie", 2014), (2, "frozen", "movie", None), (3, "twin", "movie", 2002), (4, "lone", "movie", 1900), (5, "pair", "movie", 2020), (6, "frozen", "series", None), (7, "?!", "movie", 1)]
    got = {r["query_id"]: r["match_id"] for r in match.exact_nearest_year(spark.createDataFrame(q, "query_id int, title string, type string, year int"), titles).collect()}
    assert got == {1: "1", 2: None, 3: None, 4: "6", 5: "8", 6: "3"}


def test_subtitles(spark):
    def model(q, names):
        tok = lambda s: [w for w in "".join(c if c.isalnum() else " " for c in s.lower()).split()]
        hits = set()
        a = tok(q)
        for i, n in names:
            b = tok(n)
            s, long = (a, b) if len(a) <= len(b) else (b, a)
            at = next((k for k in range(len(long) - len(s) + 1) if long[k : k + len(s)] == s), None) if s else None
            if at is None or len("".join(s)) * 2 < len("".join(long)):
                continue
            if len(s) < len(long) and ((at == 0 and long[len(s)].isdigit()) or (at + len(s) == len(long) and at > 0 and long[at - 1].isdigit())):
                continue
            hits.add(i)
        return hits

    rng = random.Random(8)
    words = ["we", "re", "lalaloopsy", "coco", "coconut", "2", "the", "frozen", "part", "1"]
    names = [(f"t{k}", " ".join(rng.choices(words, k=rng.randrange(1, 5)))) for k in range(60)] + [("x", "We're Lalaloopsy"), ("y", "Coconut tree")]
    queries = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 5)))) for k in range(80)] + [(100, "Lalaloopsy"), (101, "!!")]
    got = match.subtitle_matches(
        spark.createDataFrame([(k, n, "m") for k, n in queries], "query_id int, title string, type string"), spark.createDataFrame([(i, n, "m", None) for i, n in names], TITLES)
    )
    want = {}
    for k, n in queries:
        hits = model(n, names)
        if hits:
            want[k] = next(iter(hits)) if len(hits) == 1 else None
    assert {r["query_id"]: r["match_id"] for r in got.collect()} == want


def test_cascade_and_ranked(spark):
    titles = spark.createDataFrame([("1", "Frozen", "movie", 2013), ("2", "Frozen", "movie", 2013), ("3", "Frozen II the movie", "movie", 2019), ("4", "Moana song", "movie", 2016)], TITLES)
    q = spark.createDataFrame([(1, "Frozen", "movie", 2013), (2, "Moana", "movie", 2016), (3, "Zz", "movie", None)], "query_id int, title string, type string, year int")
    assert rows(match.match_titles(q, titles)) == [(1, None, None), (2, "4", "subtitle"), (3, None, None)]
    r = [(2, 1, 10, "Moana 2", "movie"), (2, 2, 11, "Moana: film", "movie"), (2, 3, 12, "moana", "movie"), (1, 1, 20, "Frozen 2", "movie"), (1, 2, 21, "The Frozen", "movie"), (1, 0, 22, "Frozen", "series")]
    assert rows(match.resolve_ranked(q, spark.createDataFrame(r, "query_id int, rank int, video_id int, title string, type string"))) == [(1, 21), (2, 12)]


def fold_changes(offers, events):
    """The changes one by one. offers: {key: [value, expires, available, source]}."""
    held = {k: list(v) for k, v in offers.items()}
    for kind, title, service, type_, ts, options in events:
        if kind in ("removed", "expiring"):
            for k in [k for k, v in held.items() if k[:3] == (title, service, type_) and v[3] == "motn"]:
                if kind == "removed":
                    del held[k]
                else:
                    held[k][1] = ts
        elif options is not None:
            named = {o[0] for o in options}
            for k in [k for k, v in held.items() if k[0] == title and v[2] is None and (v[3] == "motn" or k[1] in named)]:
                del held[k]
            for service_, type__, quality, link, expires in options:
                k = (title, service_, type__, quality)
                held[k] = [link, expires, held[k][2] if k in held else None, "motn"]
    return held


def test_change_replay_against_a_fold(spark):
    rng = random.Random(11)
    day = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k)
    offers, events = {}, []
    for case in range(150):
        title = f"t{case}"
        for s in "ab":
            for q in (None, "hd"):
                if rng.random() < 0.5:
                    source = rng.choice(["motn", "motn", "discovery"])
                    coming = day(900) if source == "motn" and rng.random() < 0.4 else None
                    offers[title, s, "sub", q] = [f"old{s}{q}", day(rng.randrange(50)), coming, source]
        for _ in range(rng.randrange(6)):
            kind = rng.choice(["removed", "expiring", "updated", "updated"])
            options = [(s, "sub", q, f"new{rng.randrange(99)}", day(rng.randrange(100, 200))) for s in "ab" for q in (None, "hd") if rng.random() < 0.4]
            events.append((kind, title, rng.choice("ab"), "sub", day(rng.randrange(300, 400)), options if rng.random() < 0.9 else None))
    want = fold_changes(offers, events)

    columns = ["title_id", "service_id", "region", "type", "video_quality", "link", "expires_on", "available_from", "source"]
    kind = changes.OFFER_TYPE
    stored = [(t, s, "US", y, q, v[0], None, None, None, v[1], v[2], v[3]) for (t, s, y, q), v in offers.items()] + [("t0", "a", "GB", "sub", None, "abroad", None, None, None, None, None, "motn")]
    batch = [(k, e[0], e[1], e[2], e[3], e[4]) for k, e in enumerate(events)]
    payloads = [(k, e[1]) for k, e in enumerate(events) if e[0] == "updated" and e[5] is not None]
    options = [(k, e[1], p, o[0], o[1], o[2], o[3], None, None, None, o[4]) for k, e in enumerate(events) if e[0] == "updated" and e[5] for p, o in enumerate(e[5])]
    got = changes.apply_changes(
        spark.createDataFrame(stored, kind),
        spark.createDataFrame(batch, "seq int, kind string, title_id string, service_id string, type string, ts timestamp"),
        spark.createDataFrame(payloads, "seq int, title_id string"),
        spark.createDataFrame(options, "seq int, title_id string, pos int, service_id string, type string, video_quality string, link string, deep_link string, price_amount decimal(8,2), price_currency string, expires_on timestamp"),
    )
    got = {(r["title_id"], r["service_id"], r["type"], r["video_quality"]): [r["link"], r["expires_on"], r["available_from"], r["source"]] for r in got.select(*columns).where("region = 'US'").collect()}
    assert got == want


def fold_newest(items):
    held = None
    for date, seq in items:
        if held is None or held[0] is None or date is None or date >= held[0]:
            held = (date, seq)
    return held


def test_ordered_folds(spark):
    rng = random.Random(5)
    data, ages = {}, []
    for k in range(300):
        data[k] = [(rng.choice([None, 1, 2, 3, 4]), s) for s in range(rng.randrange(1, 7))]
        ages += [(k, s, rng.choice([None, 4, 8]), rng.choice([None, "csm", "wkar", "zz"])) for s in range(4)]
    df = spark.createDataFrame([(k, d, s) for k, own in data.items() for d, s in own], "k int, d int, s int")
    assert {r["k"]: (r["d"], r["s"]) for r in works.newest_wins(df, ["k"], "d", "s").collect()} == {k: fold_newest(own) for k, own in data.items()}
    want = {}
    for k, _, value, source in ages:
        rank = works.AGE_RANKS.get(source, 0)
        if value is not None and source is not None and (k not in want or rank >= want[k][2]):
            want[k] = (value, source, rank)
    got = works.ranked_value(spark.createDataFrame(ages, "k int, s int, v int, src string"), "k", "v", "src", "s").collect()
    assert {r["k"]: (r["v"], r["src"]) for r in got} == {k: v[:2] for k, v in want.items()}


def test_merge_and_stamp(spark):
    data = [(1, 1, "T", None, 2000, None, None, ["b", "a"]), (1, 0, "S", None, None, "c", None, ["a"]), (1, 2, "U", "x", 1999, "d", "e", ["c", None, "a"]), (2, 0, "V", None, None, None, None, None)]
    df = spark.createDataFrame(data, "work int, seq int, title string, author string, year int, cover_url string, description string, isbn13s array<string>")
    got = rows(works.merge_works(df), "work", "title", "author", "year", "cover_url", "description", "isbn13s")
    assert got == [(1, "S", "x", 2000, "c", "e", ["a", "b", "c"]), (2, "V", None, None, None, None, [])]
    candidates = spark.createDataFrame([("K", 2, 2), ("K", 1, 1), ("L", 3, 1), ("M", 4, 1)], "work_key string, work int, seq int")
    holders = spark.createDataFrame([(9, "L"), (4, "M"), (7, None)], "work int, work_key string")
    assert rows(works.stamp_unique(candidates, holders)) == [(1, "K", True), (2, "K", False), (3, "L", False), (4, "M", True)]


ITEM = "seq long, title string, author string, isbn13s array<string>"
WORK = "work long, title string, author string, isbn13s array<string>, work_key string"
EDITION = "isbn string, work_key string, isbn13s array<string>"


def fold_items(items, stored, editions):
    known = {w: {"i": list(i), "t": t, "l": a, "k": k} for w, t, a, i, k in stored}
    out = {}
    for seq, title, author, isbns in items:
        hits = [w for w, x in known.items() if set(isbns) & set(x["i"])]
        step, more, key = "isbn", [], None
        if not (len(hits) == 1 and known[hits[0]]["k"]) and len(hits) <= 1:
            edition = next((editions[i] for i in isbns if i in editions), None)
            if edition:
                key, more = edition
        if not hits and key:
            step, hits = "work_key", [w for w, x in known.items() if x["k"] == key]
        if not hits and title:
            step, hits = "title_author", [w for w, x in known.items() if x["t"] == title and (x["l"] is None or author is None or x["l"] == author)]
        if len(hits) > 1:
            out[seq] = (None, f"ambiguous_{step}")
            continue
        if not hits:
            step, hits = "new", [-1 - seq]
            known[hits[0]] = {"i": [], "t": title, "l": author, "k": None}
        x = known[hits[0]]
        x["i"] += [i for i in [*isbns, *more] if i not in x["i"]]
        x["l"] = x["l"] or author
        if key and x["k"] is None and not any(y["k"] == key for y in known.values()):
            x["k"] = key
        out[seq] = (hits[0], step)
    return out


def test_ingest_against_a_fold(spark):
    rng = random.Random(21)
    items, stored, editions, seq, work = [], [], {}, 0, 0
    for case in range(60):
        name = lambda: rng.choice([f"n{case}", f"n{case}", f"m{case}", ""])  # noqa: E731, B023
        isbn = lambda k: [f"{case}-{rng.randrange(5)}" for _ in range(rng.randrange(k))]  # noqa: E731, B023
        who = lambda: rng.choice([None, "smith", "jones"])
        for k in range(3):
            if rng.random() < 0.5:
                editions[f"{case}-{k}"] = (f"K{case}{rng.randrange(2)}", list(dict.fromkeys([f"{case}-{k}", *isbn(2)])))
        for _ in range(rng.randrange(3)):
            key = f"K{case}{work}" if rng.random() < 0.3 else None
            stored.append((work, name(), who(), list(dict.fromkeys(isbn(3))), key))
            work += 1
        for _ in range(rng.choice([1, 1, 2, 4])):
            items.append((seq, name(), who(), list(dict.fromkeys(isbn(3)))))
            seq += 1
    want = fold_items(items, stored, editions)
    got = ingest.ingest_items(spark.createDataFrame(items, ITEM), spark.createDataFrame(stored, WORK), spark.createDataFrame([(i, k, m) for i, (k, m) in editions.items()], EDITION))
    assert {r["seq"]: (r["work"], r["step"]) for r in got.collect()} == want


def test_ingest_of_large_components(spark):
    """A third of all items under one title, chains in which each item joins the work of the one before, all against the fold."""
    rng = random.Random(5)
    items = [(k, "hot", rng.choice([None, None, "smith", "jones", "wu"]), [f"h{k}"] if k % 5 == 0 else []) for k in range(300)]
    items += [(300 + k, f"c{k}", "x", [f"c{k}", f"c{k + 1}"]) for k in range(300)]
    items += [(600 + k, "chain of keys", rng.choice([None, "y"]), [f"e{k // 3}"]) for k in range(60)]
    items += [(700 + k, f"s{k % 7}", rng.choice([None, "a", "b"]), [f"z{rng.randrange(15)}"] if rng.random() < 0.3 else []) for k in range(150)]
    stored = [(0, "s0", None, ["z1"], None), (1, "s0", None, ["z2"], "K"), (2, "s1", "a", [], None), (3, "s2", None, ["z3"], None), (4, "s2", None, ["z4"], None), (5, "s2", "b", ["z5"], None), (6, "hot", None, ["h5"], None)]
    editions = {f"e{k}": (f"E{k // 2}", [f"e{k}", f"e{k + 1}"]) for k in range(12)} | {"z7": ("K", ["z1"]), "z8": ("M", ["z9"])}
    rng.shuffle(items)
    items = [(k, *item[1:]) for k, item in enumerate(items[:400])] + [(400 + k, *item[1:]) for k, item in enumerate(sorted(items[400:]))]
    want = fold_items(items, stored, editions)
    got = ingest.ingest_items(spark.createDataFrame(items, ITEM), spark.createDataFrame(stored, WORK), spark.createDataFrame([(i, k, m) for i, (k, m) in editions.items()], EDITION)).collect()
    assert {r["seq"]: (r["work"], r["step"]) for r in got} == want and all(r["created"] == (r["step"] == "new") for r in got)
    chain = [(k, f"c{k}", "x", [f"c{k}", f"c{k + 1}"]) for k in range(2000)]
    got = ingest.ingest_items(spark.createDataFrame(chain, ITEM), spark.createDataFrame([], WORK), spark.createDataFrame([], EDITION)).collect()
    assert {r["work"] for r in got} == {-1}


def test_ingest_merges_items_and_editions(spark):
    item = "seq long, title string, author string, year int, isbn13s array<string>, cover_url string, description string, min_age int, min_age_source string, list_source string, list_key string, as_of_date int, rank int, weeks_on_list int, review_url string, metadata string"
    work = "work long, title string, author string, year int, isbn13s array<string>, cover_url string, description string, work_key string, min_age int, min_age_source string"
    listed = "work long, list_source string, list_key string, as_of_date int, rank int, weeks_on_list int, review_url string, metadata string"
    works_ = [(5, "Stored", None, None, ["111"], None, None, None, None, None), (6, "Twin", "a", 1990, [], None, "d", None, 3, "nyt"), (7, "Twin", None, None, [], None, None, "K7", None, None)]
    items = [
        (0, "Incoming", "Ann", 2000, ["111", "9780306406157"], None, "text", 7, None, "nyt", "fiction", 20, 4, 9, None, "m0"),
        (1, "Twin", "a", None, [], "c", None, 9, "csm", "csm", "k", None, 1, 1, "u1", None),
        (2, "New one", None, None, ["555"], "own", None, 8, "wkar", "nyt", "fiction", 20, 1, 2, None, None),
        (3, "New one", "Bo", 1999, [], "late", "late", 6, "nyt", "nyt", "fiction", 10, 2, 1, None, "older"),
        (4, "Incoming", None, 1900, ["111"], "no", None, 5, "csm", "", "fiction", 30, None, None, None, None),
        (5, "Other", None, None, ["222"], None, None, None, None, "nyt", "fiction", 30, 8, 10, "r5", "m5"),
    ]
    editions = spark.createDataFrame([("9780306406157", "OL1", ["222", "9780306406157"], "cover"), ("555", "K7", ["556"], "x")], EDITION + ", cover_url string")
    held = spark.createDataFrame([(5, "nyt", "fiction", 25, 1, 1, "stored", "stored"), (9, "q", "q", None, None, None, None, None)], listed)
    out = ingest.ingest_batch(spark.createDataFrame(items, item), spark.createDataFrame(works_, work), editions, held)
    got = {r["work"]: (r["title"], r["author"], r["year"], r["cover_url"], r["description"], r["work_key"], r["isbn13s"]) for r in out["works"].collect()}
    assert got == {
        5: ("Stored", "Ann", 2000, "cover", "text", "OL1", ["111", "9780306406157", "222"]),
        6: ("Twin", "a", 1990, None, "d", None, []),
        7: ("Twin", None, None, "own", None, "K7", ["555", "556"]),
        -4: ("New one", "Bo", 1999, "late", "late", None, []),
    }
    assert rows(out["ages"]) == [(-4, 6, "nyt"), (5, 5, "csm"), (6, 3, "nyt"), (7, 8, "wkar")]
    member = {(r["work"], r["list_source"]): tuple(r)[3:] for r in out["memberships"].collect()}
    assert member == {(5, "nyt"): (30, 8, 10, "r5", "m5"), (7, "nyt"): (20, 1, 2, None, None), (-4, "nyt"): (10, 2, 1, None, "older"), (9, "q"): (None,) * 5}
    assert rows(out["ambiguous"]) == [(1, "Twin", "csm", "k", "ambiguous_title_author")] and rows(out["candidates"]) == [(1, 6, "Twin"), (1, 7, "Twin")]


def test_enrichment(spark):
    data = spark.createDataFrame([(1, None, "x"), (2, 5, None), (3, None, None)], "k int, a int, b string")
    lookup = spark.createDataFrame([(1, 9, "y"), (3, None, "z"), (3, None, "z"), (None, 1, "q")], "k int, a int, b string")
    assert rows(enrich.enrich_fill_null(data, lookup, "k", ["a", "b"], "at", F.lit("now"))) == [(1, 9, "x", "now"), (2, 5, None, "now"), (3, None, "z", "now")]
    own = spark.createDataFrame([(1, "The Cat", ["x", "b", "a"]), (2, "Dog", []), (3, "Fox", ["q", "w", "e", "a"])], "work int, title string, isbn13s array<string>")
    volumes = spark.createDataFrame([("a", "va"), ("b", "vb")], "isbn string, volume string")
    found = spark.createDataFrame([(2, 1, "v2", "DOG!"), (2, 2, "v3", "Dog"), (3, 1, "v4", "Foxes")], "work int, rank int, volume string, title string")
    assert rows(enrich.lookup_volumes(own, volumes, found)) == [(1, "vb"), (2, "v2")]
    costs = [(k, (k * 7) % 5) for k in range(100)]
    got = {r["k"] for r in enrich.budgeted_prefix(spark.createDataFrame(costs, "k int, c int"), "k", "c", 60, 5).collect()}
    want, spent = set(), 0
    for k, c in costs:
        if spent < 60:
            want.add(k)
        spent += c
    assert got == want


def test_editions_collide(spark):
    own = spark.createDataFrame([(1, None, ["a"], None), (2, None, ["b"], "c"), (3, "K9", [], None), (4, None, ["d"], None), (5, "K1x", ["999"], None), (6, "none", None, None)], "work int, work_key string, isbn13s array<string>, cover_url string")
    editions = spark.createDataFrame([("a", "K1", ["a", "z"], "u"), ("b", "K1", ["b"], "u"), ("d", "K9", ["d"], "u"), ("999", "other", ["never"], "never")], "isbn string, work_key string, isbn13s array<string>, cover_url string")
    out, lost = enrich.stamp_editions(own, editions)
    assert rows(out.where("work < 5")) == [(1, "K1", ["a", "z"], "u"), (2, None, ["b"], "c"), (3, "K9", [], None), (4, None, ["d"], "u")]
    assert rows(lost) == [(2, "K1"), (4, "K9")]
    # a work with a key takes what the key's first two pages hold, whatever its own ISBNs are
    listed = [("K1x", 0, 0, ["111"], None), ("K1x", 0, 1, ["222", None, "111"], "cover"), ("K1x", 1, 0, ["999", "333"], "late"), ("K1x", 2, 0, ["444"], "later"), ("K1", 0, 0, ["y"], "w"), (None, 0, 0, ["q"], "q")]
    out, _ = enrich.stamp_editions(own, editions, spark.createDataFrame(listed, "work_key string, page int, pos int, isbn13s array<string>, cover_url string"))
    assert rows(out) == [(1, "K1", ["a", "z", "y"], "u"), (2, None, ["b"], "c"), (3, "K9", [], None), (4, None, ["d"], "u"), (5, "K1x", ["999", "111", "222", "333"], "cover"), (6, "none", [], None)]


def walk_plainly(pages, lists, budget, limit=None, resume=None):
    """The run as a loop over pages, one call at a time."""
    calls, fetched, out = 0, 0, []
    names = lists[[n for n in lists].index(resume[0]) :] if resume else lists
    for name in names:
        own = {p: q for n, p, q in pages if n == name}
        at, first = (resume[1] if resume and name == resume[0] else max(own, default=None)), True
        while at is not None or first:
            if calls >= budget or (limit is not None and fetched >= limit):
                return out, [(name, at, calls)]
            out.append((name, at, calls, at in own))
            calls, first = calls + 1, False
            if at not in own:
                break
            fetched += 1
            at = own[at] if own[at] is not None and own[at] < at else None
    return out, []


def test_chain_walk(spark):
    kind, names = "list string, published int, previous int", spark.createDataFrame([("b", 1), ("a", 2), ("empty", 3), ("c", 4)], "list string, seq int")
    pages = [("a", 10, 8), ("a", 9, 7), ("a", 8, 6), ("a", 6, None), ("b", 5, 4), ("b", 4, 1), ("b", 3, 2), ("b", 2, None), ("c", 9, 9), ("c", 8, 1)]
    df = spark.createDataFrame([*pages, ("x", 1, None), (None, 1, None), ("a", None, 3)], kind)
    walk, _ = enrich.chain_walk(df.where("list = 'a'"), names.where("list = 'a'"), 99)
    assert {r["published"] for r in walk.collect()} == {10, 8, 6}
    for budget, limit, resume in ((0, None, None), (3, None, None), (50, None, None), (7, 5, None), (50, 6, ("b", 4)), (4, None, ("a", 9)), (50, None, ("a", 77))):
        walk, stop = enrich.chain_walk(df, names, budget, limit, resume)
        want, end = walk_plainly(pages, ["b", "a", "empty", "c"], budget, limit, resume)
        assert sorted(map(str, map(tuple, walk.collect()))) == sorted(map(str, want)), (budget, limit, resume)
        assert [tuple(r) for r in stop.collect()] == end


def test_a_long_chain(spark):
    long = spark.range(3000).selectExpr("'l' list", "cast(id AS int) published", "cast(CASE WHEN id % 2 = 1 THEN id - 2 WHEN id > 0 THEN id - 1 END AS int) previous")
    walk, stop = enrich.chain_walk(long, spark.createDataFrame([("l", 0)], "list string, seq int"), 1000)
    assert walk.count() == 1000 and walk.agg(F.min("published")).first()[0] == 2999 - 2 * 999 and tuple(stop.first()) == ("l", 999, 1000)


def offer(title, link="n/title/1", source="discovery", service="netflix", region="US", kind="subscription", quality=None, start=None, end=None):
    return (title, service, region, kind, quality, link, None, None, None, end, start, source)


def test_audits(spark):
    now = F.lit(dt.datetime(2024, 5, 1))
    offers = spark.createDataFrame([offer("a"), offer("b", source="motn"), offer("c", link="bad"), offer("d", end=dt.datetime(2024, 1, 1)), offer("e", link="n/title/5")], changes.OFFER_TYPE)
    found = spark.createDataFrame([("a", 7, 1), ("b", 8, 1), ("z", 9, 1), ("z", 10, 2)], "title_id string, video_id long, seq int")
    got = {r["title_id"]: (r["link"].split("/")[-1], r["source"]) for r in audit.discovery_upsert(offers, found, now).collect()}
    assert got["a"] == ("7", "discovery") and got["b"] == ("1", "motn") and got["z"] == ("10", "discovery")
    titles = spark.createDataFrame([(t, True, dt.datetime(2024, 4, 30)) for t in "abcde"], "title_id string, surfaced boolean, checked_at timestamp")
    reset = {r["title_id"]: r["surfaced"] for r in audit.reset_orphans(titles, offers, now).collect()}
    assert reset == {"a": True, "b": True, "c": None, "d": None, "e": True}
    classes = spark.createDataFrame([("a", False), ("b", None)], "title_id string, surfaced boolean")
    after, left = audit.write_back(titles, offers, classes, now)
    assert {r["title_id"]: r["surfaced"] for r in after.collect()} == {"a": False, "b": None, "c": True, "d": True, "e": True}
    assert {r["title_id"] for r in left.collect()} == set("bcde")
    names = spark.createDataFrame([("a", "Alpha", "movie", None), ("e", "Echo", "movie", None)], TITLES)
    videos = spark.createDataFrame([(1, "Alpha", "movie", None), (5, "Alpha", "movie", None)], "video_id long, title string, type string, year int")
    classes = audit.reconcile(offers, names, videos)
    assert rows(classes, "title_id", "class") == [("a", "ok"), ("c", "bad_link"), ("d", "move"), ("e", "move")]
    moved, flags = audit.apply_moves(offers, titles, classes, now)
    assert {r["title_id"] for r in moved.collect()} == {"a", "b", "c"}
    assert {r["title_id"]: r["surfaced"] for r in flags.collect()}["e"] is None


def test_reports(spark):
    log = [(1, "sync", "completed", 1, 2), (2, "sync", "running", 100, None), (3, "verify", "completed", 90, 95), (4, "pipe", "completed", 97, 98), (5, "old", "completed", 1, 2)]
    at = lambda h: None if h is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    df = spark.createDataFrame([(i, t, s, at(a), at(b)) for i, t, s, a, b in log], "id int, sync_type string, status string, started_at timestamp, completed_at timestamp")
    watch = spark.createDataFrame([("sync", "daily"), ("verify", "daily"), ("old", "daily"), ("none", "daily"), ("rare", "weekly")], "job string, cadence string")
    health = reports.job_health(df, watch, F.lit(at(101)), verify="verify", pipeline="pipe")
    assert rows(health, "job", "verdict") == [("none", "fail"), ("old", "fail"), ("rare", "warn"), ("sync", "warn"), ("verify", "warn")]
    assert reports.overall(health).first()[0] == "fail" and reports.overall(health.limit(0)).first()[0] == "ok"
    assert tuple(reports.coverage(spark.range(0), F.col("id")).first()) == (0, 0, 0.0, 0, None)


def test_fills(spark):
    now = F.lit(dt.datetime(2024, 5, 1))
    offers = spark.createDataFrame([offer("a", source="motn"), offer("b")], changes.OFFER_TYPE)
    titles = spark.createDataFrame([("a", "Alpha", "movie", None), ("b", "Beta", "movie", None), ("c", "Gamma", "movie", None)], TITLES)
    browse = spark.createDataFrame([(1, 11, "alpha", "movie", None), (2, 12, "beta", "movie", None), (3, 13, "gamma", "movie", None), (4, 14, "Gamma", "movie", None), (5, 15, "zz", "movie", None)], "seq int, video_id long, title string, type string, year int")
    assert rows(audit.discover(offers, titles, browse), "seq", "outcome") == [(1, "skipped"), (2, "restamped"), (3, "created"), (4, "restamped"), (5, "unmatched")]
    filled = audit.discovery_fill(offers, titles, browse, now)
    assert {r["title_id"]: r["link"].split("/")[-1] for r in filled.collect()} == {"a": "1", "b": "12", "c": "14"}
    live = spark.createDataFrame([("b", "Beta", "movie", 1, None), ("d", "Delta", "tv", 2, None), ("e", "Eps", "tv", 0, None), ("f", "Phi", "movie", 3, dt.datetime(2024, 1, 1)), ("g", "Eta", "tv", 4, None)], "title_id string, title string, tmdb_type string, tmdb_id int, deleted_at timestamp")
    on = spark.createDataFrame([("b",), ("d",), ("e",), ("f",)], "title_id string")
    results = spark.createDataFrame([(t, 1, k, n, y) for k, (t, n, y) in enumerate([("b", "Beta", "movie"), ("d", "Delta", "movie"), ("d", "Delta!", "series"), ("e", "Eps", "series"), ("f", "Phi", "movie"), ("g", "Eta", "series")])], "query_id string, rank int, video_id long, title string, type string")
    assert {r["title_id"] for r in audit.backstop_fill(offers, live, on, results, now).collect()} == {"a", "b", "d"}


def test_status_reports(spark):
    at = dt.datetime(2024, 5, 2)
    log = spark.createDataFrame([(1, "sync", "completed", at, at, 7, "{}"), (2, "sync", "running", at, None, 5, '{"exhausted":false}'), (3, "sync", "completed", dt.datetime(2024, 4, 1), at, 9, None)], "id int, sync_type string, status string, started_at timestamp, completed_at timestamp, api_calls_used long, metadata string")
    titles = spark.createDataFrame([("a", None), ("b", at)], "title_id string, deleted_at timestamp")
    offers = spark.createDataFrame([offer("a"), offer("a", quality="hd")], changes.OFFER_TYPE)
    services = spark.createDataFrame([("netflix", "N")], "service_id string, name string")
    got = reports.streaming_status(log, titles, offers, services, "US", F.lit(dt.datetime(2024, 5, 9)))
    assert got["calls"].first()[0] == 12 and got["running"].count() == 1 and rows(got["services"]) == [("N", 1)]
    assert rows(got["sizes"]) == [("offers", 2), ("services", 1), ("titles", 1)] and got["recent"].count() == 3
    books = reports.book_status(log, spark.range(4), spark.createDataFrame([("s", "k")], "list_source string, list_key string"), F.nullif("id", F.lit(0)), 2)
    assert tuple(books["coverage"].first()) == (4, 3, 75.0, 1, 1) and rows(books["recent"], "id", "exhausted") == [(1, True), (2, False), (3, True)]
    todo = enrich.pending(spark.createDataFrame([(2, None), (1, None), (3, 5)], "id int, at int"), "at", "id", also=F.col("id") > 1)
    assert [r["id"] for r in todo.collect()] == [2]
