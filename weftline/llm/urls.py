"""URL filters: stated host and path rules, and association rules mined by pattern growth and matched by an inverted index."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` (A-Z lower case) and the path up to ``?``, ``#`` or the end; empty where there is none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _AZ, _az)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: host labels, path words and query parameter names, marked by their place."""
    words = lambda c, mark, cut: F.transform(F.filter(F.split(c, cut), lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    names = F.transform(F.filter(names, lambda x: x != ""), lambda x: F.concat(F.lit("q:"), x))
    return F.array_sort(F.array_distinct(F.concat(words(host, "h:", r"\."), words(F.lower(path), "p:", r"[^\p{L}\p{N}]+"), names)))


@dataclass(frozen=True)
class UrlRule:
    """If a url has all the tokens, its verdict is ``verdict``."""

    tokens: tuple[str, ...]
    verdict: str
    confidence: float
    support: float


def _free_tokens(urls: DataFrame, least: int) -> DataFrame:
    """(set, n) of the frequent tokens, one for all tokens that the same urls have: the smallest."""
    each = urls.select("id", "verdict", "w", F.explode("tokens").alias("token"))
    by_verdict = each.groupBy("token", "verdict").agg(F.sum("w").alias("c"), F.count("*").alias("urls"), *[F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"h{k}") for k in (1, 2)])
    own = by_verdict.groupBy("token").agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.sum("urls").alias("urls"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    return own.where(F.col("most") >= least).groupBy("urls", "h1", "h2").agg(F.min("token").alias("token"), F.min("n").alias("n")).select(F.array("token").alias("set"), "n")


def _grown(urls: DataFrame, held: DataFrame, items: DataFrame, sets: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(rows, sets) with one token more: ``held(id, set)`` are the urls' sets of the last size, ``sets(set, n)`` those kept.

    A set counts only if fewer urls have it than any of its subsets; else its rules say
    what a subset's say, and so do those of all that it could grow into.
    """
    size = held.select(F.size("set")).first()
    if size is None:
        return held, sets.limit(0)
    wider = held.join(items, "id").where(F.col("token") > F.element_at("set", -1)).select("id", F.concat("set", F.array("token")).alias("set"))
    wider = saved(wider)
    counts = wider.join(urls.select("id", "verdict", "w"), "id").groupBy("set", "verdict").agg(F.sum("w").alias("c"))
    counts = counts.groupBy("set").agg(F.sum("c").alias("n"), F.max("c").alias("most")).where(F.col("most") >= least).select("set", "n")
    places = F.sequence(F.lit(0), F.lit(size[0]))
    parts = counts.select("set", "n", F.explode(F.transform(places, lambda k: F.filter("set", lambda _, j: j != k))).alias("part"))
    below = parts.join(sets.toDF("part", "n_part"), "part").where("n < n_part").groupBy("set", "n").agg(F.count("*").alias("parts"))
    kept = saved(below.where(F.col("parts") == size[0] + 1).select("set", "n"))
    return wider.join(kept.select("set"), "set", "left_semi").select("id", "set"), kept


def mine_rules(labelled: DataFrame, min_support: float = 0.005, min_count: int = 5, min_confidence: float = 0.6, min_lift: float = 1.1, max_tokens: int = 3) -> list[UrlRule]:
    """Association rules {tokens} -> verdict from ``labelled(tokens, verdict)``, the best first.

    Pattern growth finds the token sets that ``min_support`` of all labelled urls have with
    one verdict, and ``min_count`` of them; a rule needs ``min_confidence``, ``min_lift`` over
    its verdict's share, and at most ``max_tokens`` tokens. As in FP-growth sets grow by one token
    at a time, within the urls that have them, but only to ``max_tokens``: a url of n tokens costs
    no more than its sets of that size, where all its 2^n subsets would be listed. Urls with the
    same tokens are counted together; tokens that the same urls have count as one, and
    sets that as many urls have as a subset of theirs aren't grown, as their rules add
    nothing. A rule with a rule on fewer of its tokens, for the same verdict and as sure,
    is pruned too. There are at most a few combinations of a url's tokens over
    min_support rules: the driver's share doesn't grow with the table. No labelled url: no rules.
    """
    rows = labelled.where("verdict is not null").groupBy("tokens", "verdict").agg(F.count("*").alias("w"))
    urls = saved(rows.withColumn("id", F.monotonically_increasing_id()))
    share = {r["verdict"]: r["c"] for r in urls.groupBy("verdict").agg(F.sum("w").alias("c")).collect()}
    n = sum(share.values())
    if not n:
        return []
    # half a url below the count, so that rounding can't lose a set that has it
    least = math.ceil(min(1.0, max(min_support, (min_count - 0.5) / n)) * n - 1e-9)
    sets = saved(_free_tokens(urls, least))
    items = saved(urls.select("id", F.explode("tokens").alias("token")).join(sets.select(F.get("set", F.lit(0)).alias("token")), "token", "left_semi").select("id", "token"))
    held, levels = items.select("id", F.array("token").alias("set")), []
    for size in range(1, max_tokens + 1):
        counts = held.join(urls.select("id", "verdict", "w"), "id").groupBy("set", "verdict").agg(F.sum("w").alias("c")).where(F.col("c") >= least)
        levels.append(counts.join(sets, "set"))
        if size < max_tokens:
            held, sets = _grown(urls, held, items, sets, least)
    found = levels[0]
    for more in levels[1:]:
        found = found.union(more)
    found = found.where(F.col("c") / F.col("n") >= min_confidence)
    rules = [UrlRule(tuple(r["set"]), r["verdict"], r["c"] / r["n"], r["c"] / n) for r in found.collect() if (r["c"] / r["n"]) / (share[r["verdict"]] / n) >= min_lift]
    rules.sort(key=lambda r: (-r.confidence, -r.support, len(r.tokens), r.tokens, r.verdict))
    sure = {(r.tokens, r.verdict): r.confidence for r in rules}

    def implied(rule: UrlRule) -> bool:
        size = len(rule.tokens)
        subsets = (tuple(t for k, t in enumerate(rule.tokens) if bits >> k & 1) for bits in range(1, 2**size - 1))
        return any(sure.get((s, rule.verdict), -1) >= rule.confidence for s in subsets)

    return [r for r in rules if not implied(r)]


def match_rules(urls: DataFrame, rules: list[UrlRule], max_broadcast: int = 100_000) -> DataFrame:
    """(url, verdict, mined) of the first rule whose tokens are all in a url, for the rows of ``urls(url, tokens)`` that have one; repeated urls give one row.

    The rules stand in an inverted index, a table from token to rule numbers; a url's
    tokens are joined with it and a rule matches if it is met as often as it has tokens.
    """
    spark = urls.sparkSession
    index = spark.createDataFrame([(t, k, len(r.tokens)) for k, r in enumerate(rules) for t in r.tokens], "token string, k int, size int")
    said = spark.createDataFrame([(k, r.verdict, " & ".join(r.tokens)) for k, r in enumerate(rules)], "k int, verdict string, mined string")
    hint = F.broadcast if 3 * len(rules) <= max_broadcast else (lambda x: x)
    met = urls.select("url", F.explode_outer("tokens").alias("token")).distinct().join(hint(index), "token")
    full = met.groupBy("url", "k", "size").agg(F.count("*").alias("n")).where("n = size")
    return full.groupBy("url").agg(F.min("k").alias("k")).join(hint(said), "k").drop("k")


def stated_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of the rules ``(verdict, "host/path")`` that fit; nulls if none does.

    A rule fits its host and every subdomain, if the path starts with the rule's path.
    The host's own suffixes are looked up, so the work doesn't grow with the rules.
    """
    index: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        index.setdefault(name, []).append((rule, slash + rest, verdict))
    if not index:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    struct = lambda r: F.struct(F.lit(r[0]).alias("rule"), F.lit(r[1]).alias("path"), F.lit(r[2]).alias("verdict"))
    entries = F.create_map(*[x for name, own in sorted(index.items()) for x in (F.lit(name), F.array(*map(struct, own)))])
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fits = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(entries, s)), lambda x: x.isNotNull()))
    fits = F.filter(fits, lambda r: F.startswith(path, r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return best["rule"], best["verdict"]


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow", **mining) -> DataFrame:
    """(id, host, path, rule, verdict, mined) for every row.

    ``rule`` is the stated rule that decides, if any; else the best mined rule that
    matches decides and is shown in ``mined``; else ``default``. ``labelled`` has
    (url, verdict); null urls and verdicts teach nothing. Null and odd urls have an
    empty host and path and get the default. Every row is judged by its own url, so
    repeated rows agree; other columns are ignored; an empty table gives an empty
    result and an empty label table only stated rules.
    """
    host, path = host_and_path(F.col("url"))
    own = labelled.select("url", "verdict").dropna()
    own = own.select("url", "verdict", host.alias("host"), path.alias("path"))
    mined = mine_rules(own.select(url_tokens(F.col("host"), F.col("path"), F.col("url")).alias("tokens"), "verdict"), **mining)
    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = stated_rule(F.col("host"), F.col("path"), rules)
    out = out.select("*", rule.alias("rule"), verdict.alias("stated"))
    judged = out.where("stated IS NULL").select("url", url_tokens(F.col("host"), F.col("path"), F.col("url")).alias("tokens"))
    out = out.join(match_rules(judged, mined), "url", "left")
    final = F.coalesce("stated", "verdict", F.lit(default))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", final.alias("verdict"), F.when(F.col("stated").isNull(), F.col("mined")).alias("mined"))
