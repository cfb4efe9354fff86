"""Alignment of two tokenizers against a version that tokenises every document whole."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm.alignment import align_tokenizers, aligned, aligner
from weftline.llm.queries.texts import op13_tokenizer_alignment

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTER = {chr(b): b for b in BYTES} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in BYTES)}
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def tokens(text):
    """Ids and bytes of both sides; none where they don't spell the text."""
    if not text:
        return [], [], [], []
    a, b = A.encode(" " + text, add_special_tokens=False), B.encode(text)
    raw_a = [bytes(LETTER[c] for c in t) for t in a.tokens]
    pieces = [B.id_to_piece(i) for i in b]
    raw_b = [bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
    return (a.ids, raw_a, b, raw_b) if b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode() else ([], [], [], [])


def brute(texts):
    made, counts = [], Counter()
    for text in texts:
        a, raw_a, b, raw_b = tokens(text)
        ends = lambda raw: [sum(map(len, raw[: k + 1])) for k in range(len(raw))] if len(raw) < 500 else list(__import__("itertools").accumulate(map(len, raw)))
        end_a, end_b = ends(raw_a), ends(raw_b)
        at_a, at_b = {e: k for k, e in enumerate(end_a)}, {e: k for k, e in enumerate(end_b)}
        cuts = sorted(at_a.keys() & at_b.keys())
        links = [(a[at_a[c]], b[at_b[c]]) for c in cuts]
        groups, i, j = [], 0, 0
        for c in cuts:
            groups.append(",".join(map(str, a[i : at_a[c] + 1])) + "|" + ",".join(map(str, b[j : at_b[c] + 1])))
            i, j = at_a[c] + 1, at_b[c] + 1
        counts.update(links)
        made.append((len(a), len(b), groups, links))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for n_a, n_b, groups, links in made:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha))
    return out


def texts():
    rng = random.Random(9)
    odd = ["a", "The", " ", "  ", "\n", "\n\n", "\t", "'s", "don't", "123", "é", "日本語", "😀", "!", "...", "\x1c", "\x85", "\xa0", " ", "　", "​", "\x00", "\r\n", "<s>", "</s>", "<|endoftext|>", "<0x0A>", "ﬁ", "é", "word", "ing", " ", "\x0b"]
    out = [None, "", " ", "  ", "\n", " \n ", "a▁b", "▁", "the same text", "the same text", "the same text", "x" * 5000, "word " * 3000, "\n".join(["one line"] * 50)]
    return out + ["".join(rng.choice(odd) for _ in range(rng.randrange(25))) for _ in range(400)]


def test_chunks_tokenise_like_the_whole():
    own = aligner(None, None)
    assert own.cut
    for text, (n_a, n_b, n_groups, groups, _, times) in zip([t for t in texts() if t], own.batch([t for t in texts() if t])):
        a, _, b, _ = tokens(text)
        assert (n_a, n_b) == (len(a), len(b)), repr(text)
        assert times.sum() == n_groups
        halves = [g.split("|") for g in groups.split(";")] if groups else []
        assert [int(i) for h in halves for i in h[0].split(",")] == a and [int(i) for h in halves for i in h[1].split(",")] == b


def test_against_brute_force(spark):
    own = texts()
    rows = [(k, t, 1, "x") for k, t in enumerate(own)] + [(None, "no id here", 1, "x"), (4, "the same text", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a int, groups string")
    want = sorted(zip([str(r[0]) for r in rows], brute([r[1] for r in rows])))
    for limit in (2_000_000, 0):
        out = align_tokenizers(docs, max_broadcast=limit)
        joined = out.documents.join(out.texts.select("text_id", "groups"), "text_id", "left")
        sha = F.when(F.coalesce(F.col("groups"), F.lit("")) != "", F.sha2("groups", 256)).otherwise("")
        got = joined.select("doc_id", *MEASURES, sha).collect()
        assert sorted((str(r[0]), tuple(r)[1:]) for r in got) == want
    copies = {bytes(r["digest"]): r["copies"] for r in out.texts.collect()}
    assert copies[hashlib.sha256(b"the same text").digest()] == 4


def test_the_query_over_its_table(spark):
    table = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{table}/documents.parquet").collect()
    want = dict(zip([r["doc_id"] for r in docs], brute([r["text"] for r in docs])))
    got = op13_tokenizer_alignment(spark, table).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(docs)


def test_empty_tables(spark):
    out = align_tokenizers(spark.createDataFrame([], "doc_id long, text string"))
    assert out.documents.count() == out.texts.count() == out.pairs.count() == 0
    out = align_tokenizers(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))
    assert sorted(tuple(r) for r in out.documents.collect()) == [(1, None, *[0] * 6), (2, None, *[0] * 6)]


def test_chunks_aligned_together_like_one_by_one():
    rng = random.Random(3)
    sizes = np.array([0, 1, 2, 3, 4])
    cuts = lambda n: (lambda x: x if sum(x) == n else cuts(n))([rng.randint(1, 4) for _ in range(rng.randint(1, n))])
    chunks = [(cuts(n), cuts(n)) for n in (1, 2, 3, 5, 8, 9, 4, 1)]
    names = [np.array([[f"{i}{end}" for i in range(5)] for end in ends], dtype=object) for ends in (",|", ",;")]
    got = list(aligned([a for a, _ in chunks], [b for _, b in chunks], sizes, sizes, *names))
    for (a, b), chunk in zip(chunks, got, strict=True):
        ends = [[sum(x[: k + 1]) for k in range(len(x))] for x in (a, b)]
        shared = [e for e in ends[0] if e in ends[1]]
        groups = [[[t for t, e in zip(x, end) if low < e <= high] for x, end in zip((a, b), ends)] for low, high in zip([0, *shared], shared)]
        text = ";".join("|".join(",".join(map(str, x)) for x in g) for g in groups)
        pairs = np.array([(x[-1], y[-1]) for x, y in groups], dtype="<i4").tobytes()
        assert chunk == (len(a), len(b), len(groups), text, pairs)
    assert not list(aligned([], [], sizes, sizes, *names))
