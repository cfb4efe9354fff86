"""Embedding near-duplicates by a pivot-permutation index with exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, saved


def unit(values) -> np.ndarray | None:
    """The vector over its length in double precision; None if it is null, empty, zero or has a null or non-finite part."""
    if values is None or not len(values):
        return None
    x = np.array([np.nan if v is None else v for v in values], dtype=np.float64)
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    return None if top == 0 else (x := x / top) / math.sqrt(float(x @ x))


def choose_pivots(vectors: DataFrame, n_pivots: int, threshold: float) -> np.ndarray:
    """Up to ``n_pivots`` spread-out valid vectors of those with the smallest hashes of their contents.

    Any two are more than three times the angle of the threshold apart. So a dense group,
    however large, gets few of them, and its members are described alike by the others.
    """
    own = vectors.select("embedding").where("embedding IS NOT NULL").select("embedding", F.xxhash64("embedding").alias("h")).distinct()
    rows = [unit(r["embedding"]) for r in own.orderBy("h").limit(2 * n_pivots).collect()]
    rows = [x for x in rows if x is not None]
    if not rows:
        return np.empty((0, 0))
    width = max(map(len, rows), key=[len(x) for x in rows].count)
    apart = math.cos(min(3 * math.acos(max(-1.0, min(1.0, threshold))), math.pi / 2))
    pivots, n = np.empty((n_pivots, width)), 0
    for x in rows:
        if n < n_pivots and len(x) == width and (pivots[:n] @ x <= apart).all():
            pivots[n], n = x, n + 1
    return pivots[:n]


def describe(pivots: np.ndarray, nearest: int):
    """Describes each vector by its ``nearest`` pivots in order; vectors that can't link get no pivots."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            vectors = [unit(x) for x in part["embedding"]]
            # vectors of another width than the pivots share one list
            lists: list = [None if x is None else [-len(x)] for x in vectors]
            some = [k for k, x in enumerate(vectors) if x is not None and pivots.size and len(x) == pivots.shape[1]]
            if some:
                near = np.argsort(-(np.array([vectors[k] for k in some]) @ pivots.T), axis=1, kind="stable")[:, :nearest]
                for k, own in zip(some, near):
                    lists[k] = own
            packed = [None if x is None else x.tobytes() for x in vectors]
            yield pd.DataFrame({"row": part["row"], "label": part["label"], "unit": packed, "pivots": lists})

    return run


def linked(threshold: float, least_shared: int):
    """Links inside a pair of blocks of one pivot's list.

    A pair is judged in the list of its first shared pivot only, if it shares at least
    ``least_shared`` pivots; its cosine decides. Returns, for every vector with links,
    how many it has here, and a spanning forest of the links.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        row, pivot = part["row"].to_numpy(), int(part["pivot"].iloc[0])
        x = np.array([np.frombuffer(u, dtype=np.float64) for u in part["unit"]])
        close = x @ x.T >= threshold
        if pivot >= 0:
            lists = np.stack(part["pivots"].to_list())
            met, column = np.unique(lists, return_inverse=True)  # only the pivots of this block have a column
            own = np.zeros((len(part), len(met)), dtype=np.float32)
            own[np.arange(len(part))[:, None], column.reshape(lists.shape)] = 1
            before = own[:, met < pivot]
            close &= (own @ own.T >= min(least_shared, lists.shape[1])) & (before @ before.T == 0)
        np.fill_diagonal(close, False)
        if part["i"].iloc[0] != part["j"].iloc[0]:
            side = part["side"].to_numpy()
            close &= side[:, None] != side[None, :]
        counts = close.sum(axis=1)
        parent = np.full(len(part), -1)
        for k in range(len(part)):  # breadth first from each vector not yet reached
            if parent[k] < 0 and counts[k]:
                parent[k], front = k, [k]
                while front:
                    at = front.pop()
                    new = np.flatnonzero(close[at] & (parent < 0))
                    parent[new] = at
                    front.extend(new)
        hit = np.flatnonzero(counts)
        return pd.DataFrame({"row": row[hit], "n": counts[hit], "to": row[parent[hit]]}, dtype="int64")

    return run


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    n_pivots: int | None = None,
    nearest: int = 8,
    least_shared: int = 3,
    block: int = 512,
) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Vectors of one non-null label are linked when their cosine in double precision is
    at least ``threshold``. Each vector is described by its ``nearest`` reference
    points in order; reference points are a bounded sample of the vectors themselves,
    without those near another (up to ``n_pivots``, by default twice the square root of
    the row count between 64 and 65,536, which a billion rows have). Vectors meet in the inverted list of every reference point near them and
    are compared if they share at least ``least_shared``; every vector is indexed and
    no list is cut: a long one is dealt into blocks of about ``block`` vectors, and
    each pair of blocks is one task's work, which returns counts and a spanning forest
    and never the pairs.

    n_links counts the other vectors linked directly, component_id is the smallest id
    reachable and ``kept`` marks it. Null labels, and vectors that are null, empty,
    zero or with null or non-finite parts, link with nothing. Vectors of different
    width never link. Rows that repeat an id are vectors of their own; with a null id
    a row links too, but represents no group unless no member has an id. Other columns
    are ignored; an empty table gives an empty result.
    """
    own = vectors.select(F.col(id_col).cast("long").alias("vec"), F.col(vector_col).alias("embedding"), F.col(label_col).cast("string").alias("label"))
    own = saved(own.withColumn("row", F.monotonically_increasing_id()))
    if n_pivots is None:
        n_pivots = min(65_536, max(64, round(2 * math.sqrt(own.count()))))
    pivots = choose_pivots(own, n_pivots, threshold)
    index = own.where("label IS NOT NULL").mapInPandas(describe(pivots, nearest), "row long, label string, unit binary, pivots array<int>")
    index = saved(index.where("pivots IS NOT NULL"))

    lists = index.select("row", "label", F.explode("pivots").alias("pivot"))
    sizes = lists.groupBy("label", "pivot").agg(F.count("*").alias("members")).where("members > 1")
    lists = lists.join(sizes, ["label", "pivot"]).withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    lists = lists.withColumn("home", F.pmod(F.xxhash64("row", "pivot"), F.col("blocks")).cast("int"))
    lists = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lists = lists.select("row", "pivot", F.least("home", "other").alias("i"), F.greatest("home", "other").alias("j"), (F.col("home") < F.col("other")).alias("side"))
    met = lists.join(index, "row")
    found = saved(met.groupBy("label", "pivot", "i", "j").applyInPandas(linked(threshold, least_shared), "row long, n long, to long"))

    groups = components(found.select(F.col("row").alias("a"), F.col("to").alias("b")))
    n_links = found.groupBy("row").agg(F.sum("n").alias("n_links"))
    out = own.select("row", "vec").join(n_links, "row", "left").join(groups.withColumnRenamed("id", "row"), "row", "left")
    least = out.where("component IS NOT NULL").groupBy("component").agg(F.min("vec").alias("least"))
    out = out.join(least, "component", "left")
    component = F.when(F.col("component").isNull(), F.col("vec")).otherwise(F.col("least"))
    return out.select(
        F.col("vec").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec") == component, component.isNull()).alias("kept")
    )
