"""Near-duplicate documents: fast similarity sketches, banding, exact verification, connected groups."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, saved
from .shingles import band_keys, shingle_set, sketches

#: Coordinates of a sketch and rows of a band: at similarity 0.8 a pair shares none of the 32 bands with probability 5e-8.
SIZE, ROWS = 128, 4
#: Buckets up to this many classes are paired by a join; larger ones are compared block by block.
SMALL, BLOCK = 32, 1024
#: Shingles of a block (8 bytes each), beyond which a large bucket is dealt into more blocks.
BLOCK_ITEMS = 1_000_000


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    size: int = SIZE,
    rows: int = ROWS,
    small: int = SMALL,
    block: int = BLOCK,
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    A document's set holds the distinct ``width``-word shingles of its text, A-Z lower
    case; fewer words make one shingle. Documents are linked when 100 * intersection >=
    ``percent`` * union, confirmed on full sets; component_id is the smallest id
    reachable by links and ``kept`` marks it.

    1. Every whole text is sketched; equal sets form a class, so copies cost one row.
    2. The classes' band keys make buckets. Classes of a bucket of up to ``small``
       are paired by an equi-join, so none has more than ``small`` partners in it.
       Larger buckets are dealt into blocks of about ``block`` classes and a bounded size, and every
       pair of blocks is compared in its own group, which returns each class with the
       first one that it is joined with. So no pair that shares a bucket is left out, yet a large group
       yields rows in proportion to its blocks and not to its pairs.
    3. Pairs whose sketches rule out the similarity (below it by 6 standard deviations,
       which a pair at exactly that similarity meets with a probability of about 1e-8) are
       left out, the rest are confirmed on full sets.

    Null and wordless texts have an empty set, link with nothing and are kept. Rows
    that repeat an id are classed by their own text; a null id is never a
    representative: such a row is kept only if its whole group has no id. An empty
    table gives an empty result. Other columns are ignored, so their names may clash.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    features = saved(docs.mapInPandas(_sketched(width, size, rows), "doc long, n long, sig binary, bands array<long>, sketch binary"))
    members = features.where("n > 0").groupBy("sig").agg(
        F.min("doc").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("n").alias("n")
    )
    classes = saved(members.withColumn("c", F.xxhash64("sig")))
    # of sets that share the hash, one keeps it and the others take another
    shared = saved(classes.groupBy("c").agg(F.min("sig").alias("first"), F.count("*").alias("many")).where("many > 1").drop("many"))
    if not shared.isEmpty():
        classes = classes.join(shared, "c", "left").withColumn("c", F.when(F.col("sig") != F.col("first"), F.xxhash64(F.lit(1), "sig")).otherwise(F.col("c"))).drop("first")
    posts = classes.select("c", "n", F.explode("bands").alias("key"))
    full = posts.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("items")).where("members > 1")
    posts = saved(posts.drop("n").join(full, "key"))

    one = posts.where(F.col("members") <= small).select("key", "c")
    pairs = one.join(one.withColumnRenamed("c", "d"), "key").where("c < d").select("c", "d").distinct()
    light = classes.select("c", "sketch", "n")
    pairs = pairs.join(light, "c").join(light.toDF("d", "sketch2", "n2"), "d")
    pairs = pairs.where(F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent)
    pairs = saved(pairs.select("c", "d", "sketch", "sketch2").mapInPandas(_plausible(percent, size), "c long, d long"))

    large = posts.where(F.col("members") > small)
    ends = pairs.select("c").union(pairs.select("d")).union(large.select("c")).distinct()
    wanted = classes.where("rep is not null").join(ends, "c", "left_semi").select("c", "rep")
    anonymous = classes.where("rep is null").join(ends, "c", "left_semi").select("c", "sig")
    texts = docs.join(wanted.withColumnRenamed("rep", "doc"), "doc").select("c", "doc", "text")
    # an id may stand on several rows: the class's own text is the one with its signature
    sets = texts.mapInPandas(_sets(width), "c long, sig binary, items binary")
    nameless = docs.where("doc is null").mapInPandas(_sets(width), "c long, sig binary, items binary").drop("c")
    sets = sets.join(classes.select("c", "sig"), ["c", "sig"]).union(
        nameless.join(anonymous, "sig").select("c", "sig", "items")
    )
    sets = saved(sets.select("c", "items").dropDuplicates(["c"]))

    other = pairs.join(sets.toDF("d", "items"), "d").select("c", "d", "items")
    edges = sets.join(pairs.select("c").distinct(), "c", "left_semi").groupBy("c").cogroup(other.groupBy("c")).applyInPandas(
        _confirmed(percent), "a long, b long"
    )
    blocks = _blocks(large, block).join(sets, "c")
    edges = edges.union(blocks.groupBy("key", "i", "j").applyInPandas(_linked(percent), "a long, b long"))

    groups = components(edges)
    by_class = classes.select("c", "sig", "rep").join(groups.withColumnRenamed("id", "c"), "c", "left")
    by_class = by_class.withColumn("component", F.coalesce("component", "c"))
    least = by_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = by_class.join(least, "component").select("sig", "component_id", F.lit(True).alias("found"))
    out = features.select("doc", "n", "sig").join(by_class, "sig", "left")
    component = F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc"))
    return out.select(
        F.col("doc").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc") == component, component.isNull()).alias("kept"),
    )


def _sketched(width: int, size: int, rows: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 500):
                few = part.iloc[at : at + 500]
                sets = [shingle_set(x, width) for x in few["text"]]
                some = [k for k, s in enumerate(sets) if len(s)]
                sketch = sketches([sets[k] for k in some], size)
                keys, low = band_keys(sketch, rows), (sketch & np.uint64(255)).astype(np.uint8)
                bands: list = [None] * len(sets)
                bytes_: list = [None] * len(sets)
                for k, own, b in zip(some, keys, low):
                    bands[k], bytes_[k] = own, b.tobytes()
                yield pd.DataFrame(
                    {
                        "doc": few["doc"].astype("Int64").to_numpy(),
                        "n": [len(s) for s in sets],
                        "sig": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                        "bands": bands,
                        "sketch": bytes_,
                    }
                )

    return run


def _plausible(percent: int, size: int):
    p = percent / 100
    least = size * p - 6 * (size * p * (1 - p)) ** 0.5

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                a, b = (np.frombuffer(b"".join(part[c]), dtype=np.uint8).reshape(-1, size) for c in ("sketch", "sketch2"))
                yield part.loc[(a == b).sum(axis=1) >= least, ["c", "d"]]

    return run


def _sets(width: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sets = [shingle_set(x, width).tobytes() for x in part["text"]]
            sig = [hashlib.blake2b(s, digest_size=16).digest() if s else None for s in sets]
            yield pd.DataFrame({"c": part["c"] if "c" in part else None, "sig": sig, "items": sets}).astype({"c": "Int64"})

    return run


def _confirmed(percent: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        own = np.frombuffer(left["items"].iloc[0], dtype=np.uint64)
        keep = []
        for d, items in zip(right["d"], right["items"]):
            items = np.frombuffer(items, dtype=np.uint64)
            shared = len(np.intersect1d(own, items, assume_unique=True))
            if 100 * shared >= percent * (len(own) + len(items) - shared):
                keep.append(d)
        return pd.DataFrame({"a": [left["c"].iloc[0]] * len(keep), "b": keep}, dtype="int64")

    return run


def _blocks(posts: DataFrame, block: int) -> DataFrame:
    """Each class of a large bucket once for every pair of blocks that its own block is in: (key, i, j, side, c)."""
    n = F.ceil(F.greatest(F.col("members") / block, F.col("items") / BLOCK_ITEMS)).cast("int")
    posts = posts.withColumn("blocks", n).withColumn("own", F.pmod(F.xxhash64("c", "key"), n).cast("int"))
    posts = posts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return posts.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") < F.col("other")).alias("side"), "c")


def _linked(percent: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("c")  # so that the groups of many blocks name the same member
        c = part["c"].to_numpy()
        alone = part["i"].iloc[0] == part["j"].iloc[0]
        sets = [np.frombuffer(x, dtype=np.uint64) for x in part["items"]]
        first = grouped(sets, percent, None if alone else part["side"].to_numpy())
        edges = pd.DataFrame({"a": c[first], "b": c}, dtype="int64")
        return edges[edges["a"] != edges["b"]]

    return run


def grouped(sets: list[np.ndarray], percent: int, side: np.ndarray | None) -> list[int]:
    """For each set the first one that it is joined with by links among the sets, or by those between the two sides."""
    n, lens = len(sets), np.array([len(s) for s in sets])
    tokens, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owners = np.repeat(np.arange(n), lens)[np.argsort(inverse, kind="stable")]
    starts, ends = np.concatenate(([0], np.cumsum(counts)[:-1])), np.cumsum(lens)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k in range(n):
        own = inverse[ends[k] - lens[k] : ends[k]]
        size = counts[own]
        at = np.repeat(starts[own] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        shared = np.bincount(owners[at], minlength=n)
        linked = 100 * shared >= percent * (lens[k] + lens - shared)
        linked[: k + 1] = False
        if side is not None:
            linked &= side != side[k]
        for x in np.flatnonzero(linked):
            p, q = root(k), root(x)
            parent[max(p, q)] = min(p, q)
    return [root(k) for k in range(n)]
