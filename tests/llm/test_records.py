"""Tool-call linking and URL filters."""

import json
import random
import time
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from weftline.llm.tools import link_tool_calls, parse_messages
from weftline.llm.urls import filter_urls, host_and_path, mine_rules

CALLS = "conv long, pos long, call_id string, name string, arguments string, after array<string>"
RESULTS = "conv long, pos long, call_id string, content string"
SCHEMAS = [("add", "x", "integer", True), ("add", "y", "number", True), ("add", "note", "string", False)]


def linked(spark, calls, results):
    schemas = spark.createDataFrame(SCHEMAS, "name string, param string, type string, required boolean")
    out = link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), schemas)
    return {(r["conv"], r["call_id"]): r for r in out.collect()}


def test_links_checks_and_writes_canonical_json(spark):
    got = linked(
        spark,
        [
            (1, 0, "a", "add", '{"y": 2.5, "x": 1}', []), (1, 1, "b", "add", '{"x":"1","z":{"q":1,"a":[1, 2]}}', ["a"]), (1, 2, "c", "sub", "{}", ["zz"]), (1, 3, "d", "add", "nope", []),
            (1, 5, "e", None, None, None), (1, 7, "a", "add", '{"x":9,"y":9}', []), (None, 0, "a", "add", "{}", []), (1, 0, None, "add", "{}", []), (1, 0, "a", "add", '{"y": 2.5, "x": 1}', []), (2, 0, "a", "add", '{"x":1,"y":1,"note":"é\\"\\n"}', []),
        ],
        [(1, 4, "a", '"three"'), (1, 6, "a", '"late"'), (1, 8, "orphan", '{"b":1,"a":2}'), (None, 1, "a", "1"), (2, 1, "a", None)],
    )
    assert len(got) == 7
    a = got[1, "a"]
    assert (a["status"], a["errors"], a["n_calls"], a["n_results"]) == ("linked", "", 3, 2)
    assert a["json"] == '{"arguments":{"x":1,"y":2.5},"id":"a","name":"add","result":"three"}'
    assert got[1, "b"]["errors"] == "missing y; not integer x; unknown z" and '"z":{"a":[1,2],"q":1}' in got[1, "b"]["json"]
    assert got[1, "c"]["errors"] == "no such tool; unknown call zz" and got[1, "c"]["status"] == "no result"
    assert got[1, "d"]["errors"] == "arguments are no object"
    assert got[1, "e"]["errors"] == "no such tool"
    assert (got[1, "orphan"]["status"], got[1, "orphan"]["n_calls"]) == ("no call", 0)
    assert got[2, "a"]["status"] == "linked" and json.loads(got[2, "a"]["json"])["arguments"]["note"] == 'é"\n'
    assert all(r["level"] == 0 for r in got.values())


def test_topological_order(spark):
    after = {"a": ["d"], "b": ["a", "e"], "c": [], "d": ["c"], "e": [], "x": ["y"], "y": ["x"], "z": ["y"], "s": ["s"]}
    calls = [(1, k, c, "add", "{}", need) for k, (c, need) in enumerate(after.items())]
    calls += [(2, k, f"i{k}", "add", "{}", [f"i{k - 1}"] if k else []) for k in range(200)]  # a long chain in order takes no rounds
    got = linked(spark, calls, [])
    level = {c: got[1, c]["level"] for c in after}
    cyclic = {c for c in after if "cycle" in got[1, c]["errors"]}
    assert cyclic == {"x", "y", "z", "s"}
    assert all(level[n] < level[c] for c, need in after.items() if c not in cyclic for n in need)
    assert all(level[c] > level["b"] for c in cyclic)
    assert all(r["level"] == 0 for (conv, _), r in got.items() if conv == 2)


def test_long_chains_and_many_levels(spark):
    n = 1500  # newest first, each call needs the one behind it
    calls = [(1, k, f"c{k}", "add", "{}", [f"c{k + 1}"] if k < n - 1 else []) for k in range(n)]
    calls += [(2, k, f"d{k}", "add", "{}", [f"d{k + 1}"]) for k in range(5)] + [(2, 5, "d5", "add", "{}", ["d3"]), (2, 6, "free", "add", "{}", [])]
    calls += [(3, k, f"e{k}", "add", "{}", [f"e{k + 1}", f"e{k + 2}"] if k < 12 else []) for k in range(14)]
    # a chain of 5,000 in which one call needs a second one, from another chain
    calls += [(4, k, f"f{k}", "add", "{}", [f"f{k + 1}"] + ["g0"] * (k == 2500) if k < 4999 else []) for k in range(5000)] + [(4, 6000 + k, f"g{k}", "add", "{}", [f"g{k + 1}"] if k < 2999 else []) for k in range(3000)]
    # a call with two needs, one of which is on a cycle, and what needs it
    calls += [(5, 0, "h0", "add", "{}", ["h1"]), (5, 1, "h1", "add", "{}", ["h2", "h3"]), (5, 2, "h2", "add", "{}", ["h4"]), (5, 3, "h3", "add", "{}", []), (5, 4, "h4", "add", "{}", ["h2"]), (5, 5, "h5", "add", "{}", ["h3"])]
    got = linked(spark, calls, [])
    assert all(got[1, f"c{k}"]["level"] == n - 1 - k and "cycle" not in got[1, f"c{k}"]["errors"] for k in range(n))
    assert all("cycle" in got[2, f"d{k}"]["errors"] and got[2, f"d{k}"]["level"] == 7 for k in range(6)) and got[2, "free"]["level"] == 0
    assert [got[3, f"e{k}"]["level"] for k in range(14)] == [*range(12, 0, -1), 0, 0]
    assert all(got[4, f"f{k}"]["level"] == (4999 - k if k > 2500 else 3000 + 2500 - k) for k in range(5000)) and got[4, "g0"]["level"] == 2999
    assert ["cycle" in got[5, f"h{k}"]["errors"] for k in range(6)] == [True, True, True, False, True, False] and got[5, "h5"]["level"] == 1


def test_parsing_and_empty_tables(spark):
    text = '{"tool_calls":[{"id":"a","name":"f","arguments":{"b":1,"a":[2]}},{"name":"no id"}]}'
    rows = [(1, 0, text, "x"), (1, 1, '{"tool_call_id":"a","content":{"k":[1]}}', "x"), (1, 2, "plain", "x"), (1, 3, None, "x"), (1, 4, "{broken", "x"), (1, 5, "[]", "x"), (1, 6, "y" * 100_000, "x")]
    calls, results = parse_messages(spark.createDataFrame(rows, "conv_id long, turn long, text string, call_id string"))
    assert [(r["call_id"], r["name"], r["arguments"]) for r in calls.collect()] == [("a", "f", '{"a":[2],"b":1}')]
    assert [(r["call_id"], r["content"]) for r in results.collect()] == [("a", '{"k":[1]}')]
    assert linked(spark, [], []) == {}


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def test_hosts_and_stated_rules(spark):
    cases = {
        "http://WWW.Example.org/es/5?x": ("www.example.org", "/es/5", "example.org/es/", "block"),
        "https://example.org/en/17": ("example.org", "/en/17", "example.org/en/1", "block"),
        "https://notexample.org/en/17": ("notexample.org", "/en/17", "org/", "allow"),
        "https://a.com/de/1#top": ("a.com", "/de/1", "com/de/", "block"),
        "https://a.com/it": ("a.com", "/it", None, "allow"),
        "https://x.org": ("x.org", "", None, "allow"),
        "x.org/a": ("", "", None, "allow"),
        "http://x.org?u=http://y.org/": ("x.org", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://" + "h" * 50_000 + ".org/" + "p" * 50_000: ("h" * 50_000 + ".org", "/" + "p" * 50_000, "org/", "allow"),
    }
    pages = spark.createDataFrame([(k, u, "r", "h") for k, u in enumerate([*cases, *cases])], "page_id long, url string, rule string, host string")
    none = spark.createDataFrame([], "url string, verdict string")
    got = filter_urls(pages, none, RULES).collect()
    want = [*cases.values()] * 2
    assert len(got) == len(want)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == want[r["page_id"]]
    assert filter_urls(pages.limit(0), none, []).count() == 0
    assert spark.range(1).select(*host_and_path(F.lit("s://H/p?q"))).first()[0] == "h"


def test_mined_rules_against_counts(spark):
    labelled = [(f"http://spam.example.net/en/{k}", "block") for k in range(20)] + [(f"http://spam.example.net/de/{k}", "allow" if k % 2 else "block") for k in range(10)]
    labelled += [(f"http://good.example.net/{'en' if k % 2 else 'de'}/{k}?utm=1", "allow") for k in range(60)] + [(None, "block"), ("http://n.net/x", None)]
    pages = spark.createDataFrame([(1, "http://spam.example.net/en/777"), (2, "http://good.example.net/de/1?utm=3"), (3, "http://other.net/zz"), (3, "http://other.net/zz"), (None, "http://spam.example.net/en/7")], "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["mined"]) for r in filter_urls(pages, spark.createDataFrame(labelled, "url string, verdict string"), []).collect()}
    assert got[1] == ("block", "h:spam & p:en") and got[None] == got[1]
    assert got[2][0] == "allow" and got[2][1] and got[3] == ("allow", None)


def test_ties_between_mined_rules(spark):
    labelled = [(f"http://a.net/x/{k}", "block") for k in range(10)] + [(f"http://b.net/y/{k}", "allow") for k in range(10)]
    pages = spark.createDataFrame([(1, "http://a.net/y/1"), (2, "http://a.net/y/1"), (3, "http://b.net/x/3"), (4, None)], "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["mined"]) for r in filter_urls(pages, spark.createDataFrame(labelled, "url string, verdict string"), []).collect()}
    # equally sure, equally frequent and equally long: the first in the order of tokens
    assert got == {1: ("block", "h:a"), 2: ("block", "h:a"), 3: ("allow", "h:b"), 4: ("allow", None)}


def test_mining_against_all_subsets(spark):
    """Every set of up to three tokens counted one by one; sets that say no more than a subset may be left out."""
    rng = random.Random(4)
    words = [f"t{k}" for k in range(7)]
    urls = [(sorted({w for w in words if rng.random() < 0.5} | {"t0"} | ({"u1", "u2"} if rng.random() < 0.3 else set())), rng.choice(["allow", "block", "block"])) for _ in range(120)]
    got = mine_rules(spark.createDataFrame([*urls, (["t0"], None)], "tokens array<string>, verdict string"), min_confidence=0.5, min_lift=1.0)
    counts, share = Counter(), Counter(v for _, v in urls)
    for tokens, verdict in urls:
        for size in (1, 2, 3):
            for some in combinations(tokens, size):
                counts[some, verdict] += 1
                counts[some] += 1
    good = {}
    for key, c in counts.items():
        if isinstance(key[0], tuple) and c >= 5 and c / counts[key[0]] >= 0.5 and (c / counts[key[0]]) / (share[key[1]] / 120) >= 1:
            good[key] = c / counts[key[0]]
    wanted = {k: v for k, v in good.items() if not any(good.get((s, k[1]), -1) >= v for n in range(1, len(k[0])) for s in combinations(k[0], n))}
    found = {(r.tokens, r.verdict): r.confidence for r in got}
    assert found.items() <= wanted.items() and len(got) > 5
    assert all(any(v == found.get((s, k[1])) and counts[s] == counts[k[0]] for n in (1, 2, 3) for s in map(tuple, map(sorted, combinations([*words, "u1", "u2"], n)))) for k, v in wanted.items() if k not in found)


def test_long_labelled_urls_dont_explode(spark):
    """Sixty tokens in common, fifty times over: 2^60 subsets, of which three tokens at most are looked at."""
    slug = "/".join(f"w{k}" for k in range(60))
    labelled = [(f"http://long.net/{slug}?id={k % 7}", "block") for k in range(50)] + [(f"http://good.net/{'/'.join(f'w{j}' for j in range(k % 60))}/x", "allow") for k in range(90)]
    pages = spark.createDataFrame([(1, f"http://long.net/{slug}"), (2, "http://good.net/w1/x"), (3, f"http://else.net/{slug}")], "page_id long, url string")
    began = time.monotonic()
    got = {r["page_id"]: (r["verdict"], r["mined"]) for r in filter_urls(pages, spark.createDataFrame(labelled, "url string, verdict string"), []).collect()}
    assert got[1] == ("block", "h:long") and got[2] == ("allow", "h:good") and got[3][0] == "block"
    assert time.monotonic() - began < 120
