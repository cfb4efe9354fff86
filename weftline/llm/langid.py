"""Language identification by compression with per-language zstandard raw-content dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
#: Characters of normalised text that are compressed at once, so that every part of a long text meets the dictionary.
BLOCK = 1024
LEVEL = 6


def normalise(text: str | None) -> str:
    """Lower-case letters and their marks, with one space for every run of other characters; empty if there is no letter."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip() if text and _LETTER.search(text) else ""


def snippets(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int, chars: int) -> dict[str, list[str]]:
    """For each language up to about ``per_lang`` stretches of ``chars`` characters, from documents and places chosen by hash."""
    own = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    share = own.groupBy("lang").count().collect()  # one row for each language
    if not share:
        return {}
    shares = F.create_map(*[x for r in share for x in (F.lit(r["lang"]), F.lit(per_lang / r["count"]))])
    dice = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_003)) / 1_000_003
    start = F.pmod(F.xxhash64("id", F.lit("place")), F.greatest(F.length("text") - chars, F.lit(0)) + 1) + 1
    rows = own.where(dice < shares[F.col("lang")]).select("lang", "id", F.substring("text", start.cast("int"), F.lit(chars)).alias("part"))
    out: dict[str, list[str]] = {r["lang"]: [] for r in sorted(share, key=lambda r: (-r["count"], r["lang"]))}
    for r in sorted(rows.distinct().collect()):
        out[r["lang"]].append(r["part"])
    return out


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 400, chars: int = 1500, dictionary: int = 112_640) -> dict[str, bytes]:
    """A raw-content dictionary for each language value, from a bounded sample; the commonest language comes first.

    At most about ``per_lang`` stretches of ``chars`` characters are gathered for each
    language, and ``dictionary`` bytes are used. Null texts and languages teach nothing.
    """
    out = {}
    for lang, parts in snippets(docs, id_col, text_col, lang_col, per_lang, chars).items():
        clean = dict.fromkeys(filter(None, map(normalise, parts)))
        if content := "\n".join(clean).encode("utf-8", "replace")[-dictionary:]:
            out[lang] = content
    return out


def predict(text: Column, dictionaries: dict[str, bytes], least_margin: float = 0.02) -> Column:
    """A struct (lang, score, rejected) for each text.

    The normalised text is cut into blocks of 1024 characters, each is compressed with
    every dictionary, and the language with the smallest sum wins; of equal sums the
    commoner language wins. score is the relative gap to the runner-up (1 where there
    is only one language), rejected says that it is under ``least_margin``. A null text
    and one without a letter get ``und``, score 0, rejected.
    """

    @F.pandas_udf("lang string, score double, rejected boolean")
    def classify(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        packers = []
        for lang, content in dictionaries.items():
            own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=LEVEL)
            packers.append((lang, zstandard.ZstdCompressor(dict_data=own, level=LEVEL, write_content_size=False, write_dict_id=False)))
        for part in parts:
            rows = []
            for text in part:
                clean = normalise(text)
                if not clean or not packers:
                    rows.append(("und", 0.0, True))
                    continue
                blocks = [clean[k : k + BLOCK].encode("utf-8", "replace") for k in range(0, len(clean), BLOCK)]
                sizes = [sum(len(p.compress(b)) for b in blocks) for _, p in packers]
                best = min(range(len(sizes)), key=lambda k: (sizes[k], k))
                second = min((s for k, s in enumerate(sizes) if k != best), default=None)
                score = 1.0 if second is None else (second - sizes[best]) / max(second, 1)
                rows.append((packers[best][0], score, score < least_margin))
            yield pd.DataFrame(rows, columns=["lang", "score", "rejected"])

    return classify.asNondeterministic()(text)


def identify_languages(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score, rejected) for every row, learned from the rows that aren't held out.

    A null in ``held_out`` (a null id) counts as not held out, but such rows teach
    nothing as they have no id to be sampled by. Rows that repeat are predicted each;
    an empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    dictionaries = learn(docs.where("not held_out"), "id", "text", "lang")
    out = docs.select("id", "held_out", predict(F.col("text"), dictionaries).alias("p"))
    return out.select(F.col("id").alias(id_col), "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))
