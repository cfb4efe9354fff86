"""Fill-in-the-middle documents by displacement: every byte of a batch moves by a shift that changes at the cuts only."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKS = (b"<P>", b"<S>", b"<M>")
#: Bytes whose positions are worked out together.
CHUNK = 1 << 18
#: Bytes of texts that are joined into one batch; a longer text is a batch of its own.
BATCH = 1 << 21


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 from the SHA-256 of "seed:id"."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4))  # type: ignore[return-value]


def moved(source: np.ndarray, starts: np.ndarray, shifts: np.ndarray, size: int, back: bool = False) -> np.ndarray:
    """The source's bytes scattered to ``position + shift`` of an array of ``size`` bytes; ``back`` gathers them from there instead.

    ``starts`` are rising positions at which a new shift begins. Their differences,
    summed up, give every byte its shift; this goes on in chunks with the sum carried
    over, so indexes take memory for a chunk only.
    """
    out = np.empty(size, dtype=np.uint8)
    steps = np.diff(shifts, prepend=0)
    length, carry = size if back else len(source), 0
    for a in range(0, length, CHUNK):
        b = min(a + CHUNK, length)
        difference = np.zeros(b - a, dtype=np.int64)
        own = slice(*np.searchsorted(starts, (a, b)))
        np.add.at(difference, starts[own] - a, steps[own])
        shift = carry + np.cumsum(difference)
        carry = int(shift[-1])
        target = np.arange(a, b) + shift
        if back:
            out[a:b] = source[target]
        else:
            out[target] = source[a:b]
    return out


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in one array, and where each begins (with the end as the last)."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate(([0], np.cumsum(sizes)))


def _segments(starts: np.ndarray, shifts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only segments that hold bytes count, so starts rise strictly."""
    some = sizes.ravel() > 0
    return starts.ravel()[some], shifts.ravel()[some]


def scatter(texts: list[bytes], cuts: np.ndarray, spm: np.ndarray, plain: np.ndarray) -> list[bytes]:
    """The outputs of texts that are cut at two byte offsets each (``cuts``: one row per text)."""
    source, begin = _joined(texts)
    sizes = np.diff(begin)
    gap = len(MARKS[0])
    out_begin = np.concatenate(([0], np.cumsum(sizes + np.where(plain, 0, 3 * gap))))
    lengths = np.column_stack((cuts[:, 0], cuts[:, 1] - cuts[:, 0], sizes - cuts[:, 1]))
    lengths[plain] = np.column_stack((sizes, 0 * sizes, 0 * sizes))[plain]
    starts = begin[:-1, None] + np.column_stack((0 * sizes, lengths[:, 0], lengths[:, 0] + lengths[:, 1]))
    prefix, middle, suffix = lengths.T
    # where prefix, middle and suffix begin within an output
    psm = np.column_stack((0 * prefix + gap, prefix + suffix + 3 * gap, prefix + 2 * gap))
    spm_places = np.column_stack((suffix + 2 * gap, prefix + suffix + 3 * gap, 0 * prefix + gap))
    places = np.where(spm[:, None], spm_places, psm)
    places[plain] = 0
    shifts = out_begin[:-1, None] + places - starts
    out = moved(source, *_segments(starts, shifts, lengths), int(out_begin[-1]))
    for mark, column in zip(MARKS, (0, 2, 1)):
        at = (out_begin[:-1] + places[:, column] - gap)[~plain]
        for k, byte in enumerate(mark):
            out[at + k] = byte
    return [out[a:b].tobytes() for a, b in zip(out_begin[:-1], out_begin[1:])]


def gather(outputs: list[bytes], spm: np.ndarray, plain: np.ndarray) -> list[bytes]:
    """The texts, back from outputs and forms alone: marks are found, and every byte is fetched from its displaced place."""
    source, begin = _joined(outputs)
    sizes, gap = np.diff(begin), len(MARKS[0])
    at = np.array([[o.find(m) for m in MARKS] for o in outputs], dtype=np.int64).reshape(-1, 3)
    p, s, m = at.T
    prefix, middle, suffix = np.where(spm, m - p, s - p) - gap, sizes - m - gap, np.where(spm, p - s, m - s) - gap
    lengths = np.column_stack((prefix, middle, suffix))
    lengths[plain] = np.column_stack((sizes, 0 * sizes, 0 * sizes))[plain]
    text_begin = np.concatenate(([0], np.cumsum(lengths.sum(axis=1))))
    starts = text_begin[:-1, None] + np.column_stack((0 * sizes, lengths[:, 0], lengths[:, 0] + lengths[:, 1]))
    places = np.column_stack((p, m, s)) + gap
    places[plain] = 0
    shifts = begin[:-1, None] + places - starts
    texts = moved(source, *_segments(starts, shifts, lengths), int(text_begin[-1]), back=True)
    return [texts[a:b].tobytes() for a, b in zip(text_begin[:-1], text_begin[1:])]


def _batches(sizes: list[int]) -> Iterator[slice]:
    start, held = 0, 0
    for k, n in enumerate(sizes):
        if k > start and held + n > BATCH:
            yield slice(start, k)
            start, held = k, 0
        held += n
    if len(sizes) > start:
        yield slice(start, len(sizes))


def _scan(texts: list[bytes], ids: list, seed: int, rate: int, spm_rate: int):
    """Units, cuts in bytes and forms of a batch: line ends are found at once, a cut is the place after a line's end."""
    source, begin = _joined(texts)
    ends = np.flatnonzero(source == 10) + 1
    first = np.searchsorted(ends, begin, side="right")
    first[0] = 0
    cuts, units = np.zeros((len(texts), 2), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    plain, spm = np.zeros(len(texts), dtype=bool), np.zeros(len(texts), dtype=bool)
    for k, (text, doc) in enumerate(zip(texts, ids)):
        own = ends[first[k] : first[k + 1]]
        n = len(own) + bool(text and text[-1] != 10)
        h = draws(doc, seed)
        for side, unit in enumerate(sorted((h[0] % (n + 1), h[1] % (n + 1)))):
            cuts[k, side] = 0 if unit == 0 else len(text) if unit > len(own) else own[unit - 1] - begin[k]
        units[k], spm[k] = n, h[3] % 100 < spm_rate
        plain[k] = not text or h[2] % 100 >= rate or any(m in text for m in MARKS)
    return units, cuts, spm & ~plain, plain


def _chars(text: bytes) -> int:
    return int(np.count_nonzero(np.frombuffer(text, dtype=np.uint8) & 0xC0 != 0x80))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm_rate: int = 50, out_col: str = "infill") -> DataFrame:
    """Adds a struct of n, form, prefix_chars, middle_chars, output: the text cut at two line ends and put in another order.

    Units are lines with their ends. Two hashed draws from the id choose the cuts; of
    100 documents about ``rate`` are reordered, of these ``spm_rate`` in a hundred with
    the suffix first (spm), else with the prefix first (psm). A text that is empty or
    null, or holds a mark, stays plain, with null lengths; a null text counts as empty.
    Null ids draw as an empty one; rows that repeat an id are cut each. Other columns
    stay as they are; one named like ``out_col`` is replaced. An empty table gives an
    empty result.
    """
    kind = "struct<n long, form string, prefix_chars long, middle_chars long, output string>"

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output binary")
    def cut(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        every, rows = [t or b"" for t in texts], []
        numbers = [None if pd.isna(i) else int(i) for i in ids.tolist()]
        for own in _batches([len(t) for t in every]):
            units, cuts, spm, plain = _scan(every[own], numbers[own], seed, rate, spm_rate)
            for text, n, (a, b), s, p, output in zip(every[own], units, cuts, spm, plain, scatter(every[own], cuts, spm, plain)):
                rows.append((n, "plain" if p else "spm" if s else "psm", None if p else _chars(text[:a]), None if p else _chars(text[a:b]), output))
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    # as text, so that pandas doesn't turn large ids of a batch with nulls into doubles
    made = cut(F.col(id_col).cast("string"), F.col(text_col).cast("binary"))
    return docs.withColumn(out_col, made).withColumn(out_col, F.col(out_col).cast(kind))


def restore(output, form) -> F.Column:
    """The text behind an output and its form; a null output gives null."""

    @F.pandas_udf("binary")
    def back(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        every, texts = [o or b"" for o in outputs], []
        for own in _batches([len(o) for o in every]):
            kinds = forms.to_numpy()[own]
            texts += gather(every[own], kinds == "spm", (kinds != "spm") & (kinds != "psm"))
        return pd.Series([None if o is None else t for o, t in zip(outputs, texts)], dtype=object)

    return back(output.cast("binary"), form).cast("string")
