"""Exact top-k search by inner product: MaxScore over inverted lists, in blocks of documents."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import cached_property
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Up to here a double counts every integer.
_EXACT = 2.0**53
#: Each round of blocks ends at so many times the blocks before it.
_WIDEN = 16
#: Queries that traverse the lists together, and terms that are looked up together.
_TOGETHER, _PROBED = 64, 8
#: Where more than this share of a block's documents is still able to compete, lists are traversed and not looked up.
_MANY = 1 / 16


def quantised(values, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, as doubles, or as Python's integers where doubles aren't exact."""
    x = np.asarray(values, dtype=np.float64)
    if not len(x) or np.abs(x).max() < _EXACT / scale:
        return np.floor(x * scale)
    return np.array([int(v) * scale if abs(v) >= _EXACT else math.floor(v * scale) for v in x.tolist()], dtype=object)


def _integers(x: np.ndarray) -> np.ndarray:
    return np.array([int(v) for v in x] + [None], dtype=object)[:-1]


@dataclass
class Term:
    """A term's inverted list: documents in order and their weights."""

    docs: np.ndarray
    weights: np.ndarray

    def at(self, docs: np.ndarray) -> np.ndarray:
        """The weights that these documents have."""
        if not len(self.docs):
            return np.zeros(len(docs), dtype=self.weights.dtype)
        place = np.minimum(np.searchsorted(self.docs, docs), len(self.docs) - 1)
        return np.where(self.docs[place] == docs, self.weights[place], 0)


class Postings:
    """The inverted lists of a block of documents, one per component, with what bounds a score.

    Lists that hold more than half of the documents are the rows of a matrix.
    """

    def __init__(self, vectors: list[np.ndarray]) -> None:
        self.vectors, self.n = vectors, len(vectors)
        self.exact = any(x.dtype == object for x in vectors)
        self.width = max(map(len, vectors), default=0)
        matrix = np.full((self.width, self.n), 0, dtype=object if self.exact else np.float64)
        for k, x in enumerate(vectors):
            matrix[: len(x), k] = _integers(x) if self.exact else x
        self.high, self.low = matrix.max(axis=1, initial=0), matrix.min(axis=1, initial=0)
        self.longest = math.inf if self.exact else math.sqrt(float((matrix**2).sum(axis=0).max(initial=0)))
        full = 2 * (matrix != 0).sum(axis=1) > self.n
        self.dense = np.flatnonzero(full)
        self.matrix = matrix if full.all() else matrix[self.dense]
        self.row = np.where(full, np.cumsum(full) - 1, -1)
        self.lists = {}
        for t in np.flatnonzero(~full):
            docs = np.flatnonzero(matrix[t])
            self.lists[int(t)] = Term(docs, matrix[t, docs])

    @cached_property
    def whole(self) -> Postings:
        """The same lists with Python's integers."""
        return self if self.exact else Postings([_integers(x) for x in self.vectors])


@dataclass
class Split:
    """A query's terms by rising bound; the first ``minor`` of them are non-essential, ``limits[j]`` bounds what the first j give together."""

    query: np.ndarray
    order: np.ndarray
    limits: np.ndarray
    minor: int
    least: int | None


def split(postings: Postings, query: np.ndarray, least) -> Split:
    """Terms bound a score by their extreme weights, and together by the lengths of the vectors (with room for rounding)."""
    bounds = np.maximum(query * postings.high[: len(query)], query * postings.low[: len(query)])
    order = np.argsort(bounds, kind="stable")
    limits = np.concatenate((np.full(1, 0, dtype=bounds.dtype), np.cumsum(bounds[order])))
    if not postings.exact:
        lengths = np.concatenate(([0], np.sqrt(np.cumsum(query[order] ** 2))))
        limits = np.minimum(limits, lengths * postings.longest * (1 + 1e-9))
    minor = 0 if least is None or least <= 0 else int(np.searchsorted(limits, least)) - 1
    return Split(query, order, limits, minor, least)


def maxscore(postings: Postings, queries: list[np.ndarray], leasts: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (documents, scores) of all documents of the block that score ``least`` or more (all, if None).

    A document that scores in non-essential terms alone can't reach ``least``. The lists
    of the essential terms are traversed, for all queries together; the others are only
    looked up for documents that are still able to reach it, from the largest bound down.
    """
    out: list = [None] * len(queries)
    cut = [q[: postings.width] for q in queries]
    fine = []
    for i, q in enumerate(cut):
        if postings.exact or q.dtype == object or float(np.abs(q) @ np.maximum(postings.high, -postings.low)[: len(q)]) >= _EXACT:
            out[i] = _searched(postings.whole, [split(postings.whole, _integers(q), leasts[i])])[0]
        else:
            fine.append(i)
    for i, found in zip(fine, _searched(postings, [split(postings, cut[i], leasts[i]) for i in fine])):
        out[i] = found
    return out


def _traversed(postings: Postings, splits: list[Split], terms: list[slice]) -> np.ndarray:
    """What the queries score in these of their terms, for all documents and all queries together."""
    weights = np.full((len(splits), postings.width), 0, dtype=postings.matrix.dtype)
    for i, (s, some) in enumerate(zip(splits, terms)):
        own = s.order[some]
        weights[i, own] = s.query[own]
    scores = weights[:, postings.dense] @ postings.matrix
    for t, term in postings.lists.items():
        for i in np.flatnonzero(weights[:, t]):
            scores[i, term.docs] += weights[i, t] * term.weights
    return scores


def _searched(postings: Postings, splits: list[Split]) -> list[tuple[np.ndarray, np.ndarray]]:
    scores = _traversed(postings, splits, [slice(s.minor, None) for s in splits])
    many = [i for i, s in enumerate(splits) if s.minor and np.count_nonzero(scores[i] + s.limits[s.minor] >= s.least) > _MANY * postings.n]
    if many:
        scores[many] += _traversed(postings, [splits[i] for i in many], [slice(0, splits[i].minor) for i in many])
        splits = [replace(s, minor=0) if i in set(many) else s for i, s in enumerate(splits)]
    return [_probed(postings, s, score) for s, score in zip(splits, scores)]


def _probed(postings: Postings, s: Split, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if s.least is None:
        return np.arange(postings.n), score
    live = np.flatnonzero((score + s.limits[s.minor] >= s.least).astype(bool))
    score = score[live]
    for j in range(s.minor, 0, -_PROBED):
        if not len(live):
            break
        left = max(0, j - _PROBED)
        terms = s.order[left:j]
        dense = terms[postings.row[terms] >= 0]
        score = score + s.query[dense] @ postings.matrix[np.ix_(postings.row[dense], live)]
        for t in terms[postings.row[terms] < 0]:
            if s.query[t]:
                score = score + postings.lists[int(t)].at(live) * s.query[t]
        able = (score + s.limits[left] >= s.least).astype(bool)
        live, score = live[able], score[able]
    return live, score


def _whole(values: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers; beyond their range the nearest."""
    if values.dtype == object:
        return np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in values], dtype=np.int64)
    return values.astype(np.int64)


def searched(k: int, scale: int):
    """The best documents of one block for one block of queries."""

    def run(docs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        rows, ids, named = (docs[c].to_numpy() for c in ("row", "vec", "named"))
        postings = Postings([quantised(x, scale) for x in docs["embedding"]])
        parts = []
        columns = ("row", "free", "least", "least_id")
        vectors = [quantised(x, scale) for x in queries["embedding"]]
        leasts = [None if free else int(least) for free, least in zip(queries["free"], queries["least"])]
        met = chain.from_iterable(maxscore(postings, vectors[k : k + _TOGETHER], leasts[k : k + _TOGETHER]) for k in range(0, len(vectors), _TOGETHER))
        for (found, scores), own, free, least, least_id in zip(met, *(queries[c] for c in columns)):
            scores = _whole(scores)
            # at the threshold itself only smaller ids come in
            fit = rows[found] != own
            if not free:
                fit &= (scores > least) | (ids[found] < least_id)
            found, scores = found[fit], scores[fit]
            if len(found) > k:
                top = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                found, scores = found[top], scores[top]
            best = np.lexsort((rows[found], ids[found], ~scores))[:k]  # ~ turns the order without overflow
            parts.append((found[best], scores[best]))
        # one frame for all queries: a frame for each costs more than its search
        if not parts:
            return pd.DataFrame(columns=["query", "query_id", "row", "vec", "score"])
        found, scores = (np.concatenate(x) for x in zip(*parts))
        query, query_id, known = (np.repeat(queries[c].to_numpy(), [len(x) for x, _ in parts]) for c in ("row", "vec", "named"))
        whole = pd.arrays.IntegerArray
        return pd.DataFrame({"query": query, "query_id": whole(query_id, ~known), "row": rows[found], "vec": whole(ids[found], ~named[found]), "score": scores})

    return run


def top_products(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, cells: int = 1 << 18) -> DataFrame:
    """(query_id, rank, <id>, score): for every row where ``is_query`` holds, the ``k`` other rows with the largest inner products.

    Components count as floor(scale * x), so scores are integers and exact; ties go to
    the smaller id. Rows are dealt by hash into blocks of about ``cells`` components.
    Each block of rows meets each block of queries in a task, which builds inverted
    lists and runs MaxScore. Blocks are taken in rounds of growing size: what a query
    has found so far is its threshold in the next round, so that later blocks hand over
    few rows, and a query's merge grows with the logarithm of the number of blocks.

    Vectors that are null or hold null or non-finite components take no part. A shorter
    vector counts as filled up with zeros. Rows that repeat an id are rows of their
    own, and each is a query if one is; a row is no partner of itself. Null ids are no
    queries if ``is_query`` is null for them, and stand behind all ids in ties. Scores
    beyond 64 bits count as the nearest that fits. Other columns are ignored; an
    empty table gives an empty result.
    """
    last_id = F.lit(2**63 - 1)  # stands for null where pandas would turn ids into doubles
    vec = F.col(id_col).cast("long")
    own = vectors.select(F.coalesce(vec, last_id).alias("vec"), vec.isNotNull().alias("named"), F.col(vector_col).alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    own = saved(own.where(F.col("embedding").isNotNull() & F.forall("embedding", fine)).withColumn("row", F.monotonically_increasing_id()))
    rows, asking, width = own.agg(F.count("*"), F.count_if("asks"), F.max(F.size("embedding"))).first()
    per_block = max(1, cells // max(1, width or 0))
    blocks, query_blocks = max(1, math.ceil(rows / per_block)), max(1, math.ceil(asking / per_block))
    own = own.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    part = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(query_blocks)).cast("int")
    queries = own.where("asks").select("row", "vec", "named", "embedding", part).toDF("row", "vec", "named", "embedding", "part")

    best, low, high = None, 0, 1
    order = "row_number() OVER (PARTITION BY query ORDER BY score DESC, vec NULLS LAST, row)"
    while low < blocks:
        asked = queries.withColumns({"free": F.lit(True), "least": F.lit(0).cast("long"), "least_id": last_id})
        if best is not None:
            last = best.where(F.col("rank") == k).select(F.col("query").alias("row"), "score", F.col("vec").alias("top"))
            asked = queries.join(last, "row", "left").withColumns({"free": F.col("score").isNull(), "least": F.coalesce("score", F.lit(0)), "least_id": F.coalesce("top", last_id)}).drop("score", "top")
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
        shard = own.where((F.col("block") >= low) & (F.col("block") < high)).select("row", "vec", "named", "embedding", "block")
        shard = shard.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
        found = shard.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(searched(k, scale), "query long, query_id long, row long, vec long, score long")
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = saved(found.withColumn("rank", F.expr(order)).where(F.col("rank") <= k))
        low, high = high, min(blocks, high * _WIDEN)
    return best.select("query_id", "rank", F.col("vec").alias(id_col), "score")
