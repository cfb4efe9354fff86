"""Packing documents into fixed-length sequences by cutting-stock column generation over the length histogram."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Tokens of a length class: lengths are rounded up to it in the linear program, never in the sequences.
UNIT = 8
#: White space other than the ASCII kinds; texts that hold any are tokenised in one piece.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Runs of printable ASCII and precomposed Latin letters are cut into words here, all others by the tokenizer.
_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_PLAIN = re.compile(f"[!-~{_LATIN}\u00d7\u00f7]+")
#: The vocabulary's own way to cut lower-case text into words.
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^a-z0-9{_LATIN}]+")
_MOST_CACHED = 400_000


class _Vocabulary:
    """A tokenizer with bounded caches: white-space-free runs, and their words, are tokenised once."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.runs: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}

    def word(self, word: str) -> bytes:
        if (found := self.words.get(word)) is None:
            spelt = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
            found = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(spelt)])
            if len(self.words) < _MOST_CACHED:
                self.words[word] = found
        return found

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def run(self, run: str) -> bytes:
        if _PLAIN.fullmatch(run) and "<|" not in run:
            found = b"".join([self.word(w) for w in _WORDS.findall(run.lower())])
        else:
            found = self.whole(run)
        if len(self.runs) < _MOST_CACHED:
            self.runs[run] = found
        return found

    def ids(self, text: str) -> bytes:
        """The text's ids as little-endian 32-bit numbers. The vocabulary never joins text across white space."""
        if _ODD_SPACE.search(text):
            return self.whole(text)
        known = self.runs.get
        return b"".join([known(r) or self.run(r) for r in text.split()])


@lru_cache(maxsize=2)
def vocabulary(path: str | None) -> _Vocabulary:
    """The vocabulary at the path, or the public one that the queries use; loaded once in each worker process."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return _Vocabulary(path)


def pieces(docs: DataFrame, capacity: int, end_id: int, with_ids: bool, tokenizer_path: str | None) -> DataFrame:
    """(doc, start, length, ids_crc32, doc_tokens, ids): each document cut into full pieces of ``capacity`` ids and a rest."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end = int(end_id).to_bytes(4, "little")
        words = vocabulary(tokenizer_path)
        for part in parts:
            rows = []
            for doc, text in zip(part["doc"].astype(object).where(part["doc"].notna(), None), part["text"]):
                ids = memoryview((words.ids(text) if text else b"") + end)
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    own = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc, start, len(own) // 4, zlib.crc32(own), total, bytes(own) if with_ids else None))
            out = pd.DataFrame(rows, columns=["doc", "start", "length", "ids_crc32", "doc_tokens", "ids"])
            yield out.astype({"doc": "Int64"})

    own = docs.select(F.col("doc"), F.col("text"))
    return own.mapInPandas(run, "doc long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def knapsack(values: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The best pattern for one sequence: classes 1..n with the given values, any number of each, total at most ``size``."""
    n = len(values)
    best, choice = np.zeros(size + 1), np.zeros(size + 1, dtype=int)
    reverse = values[::-1]  # best[w - c] for c = n..1 is a rising slice
    for w in range(1, size + 1):
        m = min(w, n)
        options = best[w - m : w] + reverse[n - m :]
        k = int(options.argmax())
        best[w], choice[w] = best[w - 1], 0
        if options[k] > best[w] + 1e-12:
            best[w], choice[w] = options[k], m - k
    pattern, w = np.zeros(n, dtype=int), size
    while w > 0:
        if c := choice[w]:
            pattern[c - 1] += 1
            w -= c
        else:
            w -= 1
    return float(best[size]), pattern


def column_generation(demand: np.ndarray, size: int, gap: float = 5e-4, max_rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, so that class c (1..n) gets exactly ``demand[c - 1]`` slots.

    Revised simplex on the cutting-stock linear program, one row per class in use;
    columns are priced by knapsack dynamic programming until none improves or the
    solution is within ``gap`` of the dual bound. Uses are rounded down, and the rest,
    at most a few slots per class, is filled largest first by subset sums.
    """
    used = np.flatnonzero(demand)
    n = len(used)
    columns = np.zeros((n, n), dtype=int)
    for k, c in enumerate(used):
        columns[k, k] = size // (c + 1)
    inverse = np.diag(1.0 / np.diag(columns)) if n else np.zeros((0, 0))
    x = inverse @ demand[used]
    for _ in range(max_rounds if n else 0):
        dual = inverse.sum(axis=0)
        values = np.zeros(len(demand))
        values[used] = np.maximum(dual, 0)
        worth, pattern = knapsack(values, size)
        if worth <= 1 + gap:
            break
        column = inverse @ pattern[used]
        ratio = np.where(column > 1e-9, x / np.where(column > 1e-9, column, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * column, 0)
        x[out] = step
        row = inverse[out] / column[out]
        inverse -= np.outer(column, row)
        inverse[out] = row
        columns[:, out] = pattern[used]
    plan, left = [], demand.astype(int).copy()
    for k in range(n):
        pattern = np.zeros(len(demand), dtype=int)
        pattern[used] = columns[:, k]
        most = min((left[c] // pattern[c] for c in np.flatnonzero(pattern)), default=0)
        if times := min(int(x[k] + 1e-9), int(most)):
            plan.append((pattern, times))
            left -= times * pattern
    while left.any():
        pattern = _fullest(left, size)
        times = int(min(left[c] // pattern[c] for c in np.flatnonzero(pattern)))
        plan.append((pattern, times))
        left -= times * pattern
    return plan


def _fullest(left: np.ndarray, size: int) -> np.ndarray:
    """The largest class left, and with it classes left that fill the sequence as far as can be."""
    first = int(np.flatnonzero(left)[-1])
    pattern, room = np.zeros(len(left), dtype=int), size - first - 1
    pattern[first] = 1
    bits, steps = 1, []
    every = (1 << (room + 1)) - 1
    for c in map(int, np.flatnonzero(left)[::-1]):
        for _ in range(min(int(left[c] - pattern[c]), room // (c + 1))):
            new = (bits | bits << (c + 1)) & every
            if new == bits:
                break
            steps.append((c, bits))
            bits = new
        if bits >> room & 1:
            break
    at = bits.bit_length() - 1
    for c, before in reversed(steps):
        if not before >> at & 1:
            pattern[c] += 1
            at -= c + 1
    return pattern


def pack(
    docs: DataFrame,
    capacity: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    with_ids: bool = False,
    tokenizer_path: str | None = None,
    shares: int | None = None,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if ``with_ids``).

    A document is the ids of its whole text and ``end_id``. It is cut only at multiples
    of ``capacity`` ids; full pieces are sequences of their own, and the rests are
    packed by patterns of length classes of 8 ids: the histogram (at most capacity / 8
    rows, whatever the input) goes to the driver, column generation finds the patterns,
    and the ranked pieces of each class take the slots. Ranks come from ``shares``
    hashed parts of every class (by default as many as a shuffle has partitions, between
    64 and 1024) with known offsets, so a class that holds a third of
    all pieces is still ranked in parallel.

    Null and empty texts are the end id alone. Rows that repeat an id are packed each;
    null ids are kept. Other columns are ignored; an empty table gives an empty result.
    """
    size = capacity // UNIT
    shares = shares or min(1024, max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    cut = pieces(own, capacity, end_id, with_ids, tokenizer_path)
    cut = cut.withColumn("class", F.ceil(F.col("length") / UNIT).cast("int"))
    cut = saved(cut.withColumn("share", F.pmod(F.xxhash64("doc", "start", "ids_crc32"), F.lit(shares)).cast("int")))

    counts = cut.groupBy("class", "share").agg(F.count("*").alias("n")).toPandas().sort_values(["class", "share"])
    counts["offset"] = counts.groupby("class")["n"].cumsum() - counts["n"]
    demand = np.zeros(size, dtype=int)
    for c, n in counts.groupby("class")["n"].sum().items():
        demand[c - 1] = n
    slots, taken, sequence = [], [0] * (size + 1), 0
    for pattern, times in column_generation(demand, size):
        place = 0
        for c in np.flatnonzero(pattern):
            each = int(pattern[c])
            slots.append((int(c) + 1, taken[c], taken[c] + each * times, sequence, each, place))
            taken[c] += each * times
            place += each
        sequence += times
    spark = docs.sparkSession
    offsets = spark.createDataFrame([tuple(map(int, r)) for r in counts[["class", "share", "offset"]].to_numpy()], "class int, share int, offset long")
    table = spark.createDataFrame(slots, "class int, low long, high long, sequence long, each int, place int")

    order = "row_number() OVER (PARTITION BY class, share ORDER BY doc, start, ids_crc32, doc_tokens) - 1"
    ranked = cut.withColumn("own", F.expr(order)).join(F.broadcast(offsets), ["class", "share"])
    ranked = ranked.withColumn("rank", F.col("own") + F.col("offset")).drop("offset", "own", "share")
    placed = ranked.join(F.broadcast(table), "class").where("rank >= low AND rank < high")
    placed = placed.withColumn("sequence_id", F.expr("sequence + (rank - low) DIV each")).withColumn("slot", F.expr("place + (rank - low) % each"))
    before = "coalesce(sum(length) OVER (PARTITION BY sequence_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    placed = placed.withColumn("offset", F.expr(before))
    columns = [F.col("doc").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return placed.select(*columns, *["ids"] * with_ids)
