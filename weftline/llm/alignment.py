"""Alignment of two tokenizers over a corpus: each distinct text is tokenised and aligned once."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Texts fall into chunks before a blank or a line's end that follows no white space.
_CHUNK = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
_MOST_CACHED = 200_000
_META = "▁"


class Chunk(NamedTuple):
    """Token counts, groups as text, and the token pairs that end together (two little-endian 32-bit ids each)."""

    n_a: int
    n_b: int
    n_groups: int
    groups: str
    pairs: bytes


def aligned(ids_a: list[list[int]], ids_b: list[list[int]], sizes_a: np.ndarray, sizes_b: np.ndarray, names_a: np.ndarray, names_b: np.ndarray) -> Iterator[Chunk]:
    """Chunks of the same bytes on both sides, cut into groups at the byte offsets at which tokens of both end; all chunks stand behind each other in one array.

    Sizes are the bytes of an id; names its number with what follows it inside a group and at its end.
    """
    n_a, n_b = ([len(x) for x in ids] for ids in (ids_a, ids_b))
    a, b = (np.fromiter(chain.from_iterable(ids), dtype=np.int64) for ids in (ids_a, ids_b))
    ends_a, ends_b = np.cumsum(sizes_a[a]), np.cumsum(sizes_b[b])
    _, last_a, last_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
    # in the text of the groups a group's tokens of one side stand behind those of the other
    group_a, group_b = (np.searchsorted(last, np.arange(len(x))) for last, x in ((last_a, a), (last_b, b)))
    parts = np.empty(len(a) + len(b), dtype=object)
    closes_a, closes_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
    closes_a[last_a] = closes_b[last_b] = 1
    parts[np.arange(len(a)) + np.concatenate(([0], last_b + 1))[group_a]] = names_a[closes_a, a]
    parts[np.arange(len(b)) + (last_a + 1)[group_b]] = names_b[closes_b, b]
    pairs = a[last_a] | b[last_b] << 32
    until_a, until_b = np.cumsum(n_a), np.cumsum(n_b)
    until = np.searchsorted(last_a, until_a - 1) + 1 if len(a) else until_a
    texts, start, first = parts.tolist(), 0, 0
    for x, y, end, stop in zip(n_a, n_b, (until_a + until_b).tolist(), until.tolist()):
        yield Chunk(x, y, stop - first, "".join(texts[start:end])[:-1], pairs[first:stop].tobytes())
        start, first = end, stop


class _Aligner:
    """Both tokenizers, and a bounded cache of aligned chunks: those asked for lately.

    Neither vocabulary joins text across a chunk's edge: the byte-level one breaks
    before white space, and the other has no piece with a blank or a line's end behind
    another character (else texts are taken as one chunk).
    """

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [x for x in range(256) if x not in printable]
        byte = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(others)}
        self.a_bytes = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_META, " ").encode() for i, p in enumerate(pieces)]
        sizes = {i: len(x) for i, x in self.a_bytes.items()}
        self.sizes_a = np.array([sizes.get(i, 0) for i in range(max(sizes) + 1)])
        self.sizes_b = np.array([len(x) for x in self.b_bytes])
        self.names_a, self.names_b = (np.array([[f"{i}{end}" for i in range(n)] for end in ends], dtype=object) for n, ends in ((len(self.sizes_a), ",|"), (len(pieces), ",;")))
        self.blank = self.b.piece_to_id(_META)
        self.cut = not any(re.search(rf"[^{_META}]{_META}|[ \n]", p) for p in pieces)
        self.recent: dict[str, Chunk | None] = {}
        self.older: dict[str, Chunk | None] = {}

    def chunks(self, text: str) -> list[str]:
        return _CHUNK.findall(" " + text) if self.cut else [" " + text]

    def learn(self, missing: list[str]) -> dict[str, Chunk | None]:
        """Aligns chunks that aren't known; None where the tokens' bytes aren't the chunk's."""
        ids_a = [e.ids for e in self.a.encode_batch_fast(missing, add_special_tokens=False)]
        # the second tokenizer puts a blank in front, which a chunk has already, or which is taken away
        ids_b = self.b.encode([c[1:] if c[0] == " " else c for c in missing], num_threads=1)
        for k, chunk in enumerate(missing):
            if chunk == " ":
                ids_b[k] = [self.blank]
            elif chunk[0] != " ":
                ids_b[k] = ids_b[k][1:]
        raw = [c.encode("utf-8", "surrogatepass") for c in missing]
        spelt = [[b"".join(map(table.__getitem__, ids)) for ids in own] for table, own in ((self.a_bytes, ids_a), (self.b_bytes, ids_b))]
        fits = [x == y == r for x, y, r in zip(*spelt, raw)]
        found: dict[str, Chunk | None] = dict.fromkeys(missing)
        at = [k for k, fit in enumerate(fits) if fit]
        found.update(zip((missing[k] for k in at), aligned([ids_a[k] for k in at], [ids_b[k] for k in at], self.sizes_a, self.sizes_b, self.names_a, self.names_b)))
        return found

    def batch(self, texts: list[str]) -> Iterator[tuple[int, int, int, str, np.ndarray, np.ndarray]]:
        cut = [self.chunks(t) for t in texts]
        recent, older = self.recent, self.older
        asked = set().union(*cut).difference(recent)
        new = []
        for chunk in asked:
            if chunk in older:
                recent[chunk] = older[chunk]
            else:
                new.append(chunk)
        if new:
            recent.update(self.learn(new))
        for chunks in cut:
            parts = [recent[c] for c in chunks]
            if None in parts:
                yield 0, 0, 0, "", np.empty(0, dtype="<i8"), np.empty(0, dtype=np.int64)
                continue
            n_a, n_b, n_groups, groups, pairs = zip(*parts)
            codes, times = np.unique(np.frombuffer(b"".join(pairs), dtype="<i8"), return_counts=True)
            yield sum(n_a), sum(n_b), sum(n_groups), ";".join(groups), codes, times
        if len(recent) > _MOST_CACHED // 2:  # what isn't asked for again until this fills up goes
            self.recent, self.older = {}, recent


@lru_cache(maxsize=2)
def aligner(a_path: str | None, b_path: str | None) -> _Aligner:
    """The tokenizers at the paths, or the public ones that the query uses; loaded once in each worker process."""
    if a_path is None or b_path is None:
        import public_tokenizers

        a_path = a_path or public_tokenizers.path("byte_bpe_50k.json")
        b_path = b_path or public_tokenizers.path("piece_bpe_32k.model")
    return _Aligner(a_path, b_path)


class Alignment(NamedTuple):
    """texts(text_id, digest, copies, n_a, n_b, n_groups, n_links, groups, a_ids, b_ids, times), pairs(a_id, b_id, n, best), documents(<id>, text_id, measures)."""

    texts: DataFrame
    pairs: DataFrame
    documents: DataFrame


def align_tokenizers(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, max_broadcast: int = 2_000_000, batch_chars: int = 1 << 20
) -> Alignment:
    """Aligns the tokens of two vocabularies over all documents.

    Rows are shuffled by their full text, and each distinct text is tokenised and
    aligned once: byte offsets where tokens of both end cut it into groups, and the two
    tokens that end there are linked. ``pairs`` counts links over the corpus, a text's
    weighted with its number of copies; ``best`` marks the pairs with their second id's
    highest count, ties included. ``documents`` has a row per row of ``docs`` with
    n_a, n_b, n_groups, n_links, n_best and count_sum (over links). The pairs join the
    texts by broadcast while they are no more than ``max_broadcast``, else by shuffle.

    Texts that are null or empty, or whose tokens don't spell " " + text, have no tokens
    and zeros everywhere; their text_id is null if null or empty. Rows that repeat an id
    or have none are rows of their own. Other columns are ignored; an empty table gives
    empty results.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = aligner(a_path, b_path)
        for part in parts:
            texts, start = part["text"].tolist(), 0
            while start < len(texts):
                end, held = start + 1, len(texts[start])
                while end < len(texts) and held + len(texts[end]) <= batch_chars:
                    held += len(texts[end])
                    end += 1
                out = pd.DataFrame(own.batch(texts[start:end]), columns=["n_a", "n_b", "n_groups", "groups", "codes", "times"])
                halves = [c.astype("<i8").view("<i4").reshape(-1, 2) for c in out["codes"]]
                out["a_ids"], out["b_ids"] = [h[:, 0] for h in halves], [h[:, 1] for h in halves]
                yield out.drop(columns="codes").assign(digest=part["digest"].iloc[start:end].to_numpy(), copies=part["copies"].iloc[start:end].to_numpy())
                start = end

    digest = F.unhex(F.sha2(F.col("text"), 256))
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    distinct = own.where("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    kind = "digest binary, copies long, n_a long, n_b long, n_groups long, groups string, a_ids array<int>, b_ids array<int>, times array<long>"
    made = distinct.select(digest.alias("digest"), "copies", "text").mapInPandas(run, kind)
    texts = saved(made.withColumn("text_id", F.monotonically_increasing_id()), compression="zstd").withColumn("n_links", F.col("n_groups"))
    texts = texts.select("text_id", "digest", "copies", "n_a", "n_b", "n_groups", "n_links", "groups", "a_ids", "b_ids", "times")

    links = texts.select("text_id", "copies", F.explode(F.arrays_zip("a_ids", "b_ids", "times")).alias("x")).select("text_id", "copies", "x.a_ids", "x.b_ids", "x.times")
    links = links.withColumnsRenamed({"a_ids": "a_id", "b_ids": "b_id"})
    counts = saved(links.groupBy("a_id", "b_id").agg(F.sum(F.col("copies") * F.col("times")).alias("n")))
    highest = counts.groupBy("b_id").agg(F.max("n").alias("highest"))
    pairs = saved(counts.join(highest, "b_id").select("a_id", "b_id", "n", (F.col("n") == F.col("highest")).alias("best")))
    small = pairs.count() <= max_broadcast
    met = links.join(F.broadcast(pairs) if small else pairs, ["a_id", "b_id"])
    sums = met.groupBy("text_id").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    measures = ["n_a", "n_b", "n_groups", "n_links"]
    measured = texts.select("text_id", "digest", *measures).join(sums, "text_id", "left")
    rows = own.select("doc", F.when(F.col("text") != "", digest).alias("digest"))
    documents = rows.join(measured, "digest", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return Alignment(texts, pairs, documents.select(F.col("doc").alias(id_col), "text_id", *[zero(c) for c in (*measures, "n_best", "count_sum")]))
