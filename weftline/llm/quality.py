"""Quality rules: statistics of whole texts and a decision list learned by sequential covering."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import mix, word_hashes

#: Integer statistics of a text, in this order.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_digits", "n_lines")
STATS_TYPE = ", ".join(f"{c} long" for c in COUNTS)
#: Quantities that the rules compare with thresholds: name -> (numerator, denominator).
RATIOS = {
    "symbols_per_char": ("n_symbols", "word_chars"),
    "dup_lines_per_line": ("n_dup_lines", "n_lines"),
    "repeats_per_word": ("n_repeat_words", "n_words"),
    "upper_per_char": ("n_upper", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "digits_per_char": ("n_digits", "word_chars"),
    "chars_per_word": ("word_chars", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}
_SPACES, _SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
_UPPER, _DIGITS, _MARKS = bytes(range(65, 91)), b"0123456789", b"!?"


def text_counts(text: str | None) -> tuple[int, ...]:
    """The statistics of one whole text; null counts as empty.

    Words are runs of characters other than space and U+0009-U+000D. n_dup_lines counts
    lines with a word that equal an earlier line; n_repeat_words counts words inside
    three-word windows that occur at least twice in the text.
    """
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    size = len(raw)
    of = lambda chars: size - len(raw.translate(None, chars))
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACES)]
    words = word_hashes(text, lower=False)
    repeated = 0
    if len(words) > 3:
        windows = mix(mix(mix(words[:-2]) + words[1:-1]) + words[2:])
        order = np.argsort(windows, kind="stable")
        same = windows[order][1:] == windows[order][:-1]
        if same.any():
            twice = np.zeros(len(windows) + 2, dtype=bool)
            at = np.concatenate((order[1:][same], order[:-1][same]))
            for k in range(3):
                twice[at + k] = True
            repeated = int(twice.sum())
    return (len(words), len(text) - of(_SPACES), of(_SYMBOLS), len(lines) - len(set(lines)), repeated, of(_UPPER), of(_MARKS), of(_DIGITS), len(lines))


def text_stats(text: Column) -> Column:
    """The statistics as a struct column. Not deterministic to the optimiser, so that it is never evaluated twice."""

    @F.pandas_udf(STATS_TYPE)
    def stats(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([text_counts(x) for x in part], columns=list(COUNTS), dtype="int64")

    return stats.asNondeterministic()(text)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def ratio(name: str, stats: str) -> Column:
    top, bottom = RATIOS[name]
    return F.col(f"{stats}.{top}") / F.greatest(F.col(f"{stats}.{bottom}"), F.lit(1))


@dataclass(frozen=True)
class Test:
    """``feature >= threshold`` or ``feature < threshold``."""

    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold

    def column(self, stats: str) -> Column:
        value = ratio(self.feature, stats)
        return value >= self.threshold if self.above else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Test, ...]


def covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for test in rule:
        out &= test.holds(x)
    return out


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 20, least_precision: float = 0.9, least_cover: int = 4) -> list[Rule]:
    """Rules for the bad class by sequential covering.

    Two thirds of the rows grow a rule (the test with the largest information gain,
    until it covers no good row), one third prunes it (the prefix with the best
    (p - n) / (p + n)). A rule enters the list if it is precise on all the rows not
    covered so far; rows that it covers are taken out. Ends at the first rule that
    isn't precise.
    """
    rules: list[Rule] = []
    left = np.arange(len(bad))
    while len(rules) < max_rules and bad[left].sum() >= least_cover:
        part = np.arange(len(left)) % 3 == 2
        grow, prune = left[~part], left[part]
        rule = _pruned(_grown({k: v[grow] for k, v in x.items()}, bad[grow]), {k: v[prune] for k, v in x.items()}, bad[prune])
        hit = covers(rule, {k: v[left] for k, v in x.items()}, len(left))
        if not rule or hit.sum() < least_cover or bad[left][hit].mean() < least_precision:
            break
        rules.append(rule)
        left = left[~hit]
    return rules


def _grown(x: dict[str, np.ndarray], bad: np.ndarray, max_tests: int = 5) -> Rule:
    rule: Rule = ()
    hit = np.ones(len(bad), dtype=bool)
    while len(rule) < max_tests and (hit & ~bad).any() and (hit & bad).any():
        p0, n0 = (hit & bad).sum(), (hit & ~bad).sum()
        best: tuple[float, Test | None] = (1e-9, None)
        for name, values in x.items():
            own, own_bad = values[hit], bad[hit]
            cuts = np.unique(own)
            cuts = (cuts[1:] + cuts[:-1]) / 2
            if len(cuts) > 200:
                cuts = cuts[np.linspace(0, len(cuts) - 1, 200).astype(int)]
            sorted_bad, sorted_good = np.sort(own[own_bad]), np.sort(own[~own_bad])
            below = np.searchsorted(sorted_bad, cuts), np.searchsorted(sorted_good, cuts)
            for above in (True, False):
                p, n = (len(sorted_bad) - below[0], len(sorted_good) - below[1]) if above else below
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), 0)
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), Test(name, above, float(cuts[gain.argmax()])))
        if best[1] is None:
            break
        rule += (best[1],)
        hit &= best[1].holds(x)
    return rule


def _pruned(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    best: tuple[float, Rule] = (-2.0, rule)
    for k in range(len(rule), 0, -1):
        hit = covers(rule[:k], x, len(bad))
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        if p + n and (value := (p - n) / (p + n)) >= best[0]:
            best = (value, rule[:k])
    return best[1]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labels: int = 20_000) -> list[Rule]:
    """The decision list learned from at most ``max_labels`` labelled documents, chosen by a hash of their ids.

    Label 0 is bad. Null ids and labels are ignored; of several labels of an id the
    least counts. Without bad or good rows the list is empty. Documents that the base
    rules reject are left to these.
    """
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).dropna().groupBy("id").agg(F.min("label").alias("label"))
    own = own.orderBy(F.xxhash64("id"), "id").limit(max_labels)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(own), "id").select("id", "label", text_stats(F.col("text")).alias("s"))
    rows = rows.select("id", "label", *[ratio(r, "s").alias(r) for r in RATIOS], base_failed(F.col("s.n_words"), F.col("s.n_repeat_words")).alias("failed"))
    # documents that repeat an id teach once, so no more rows than labels come to the driver
    rows = rows.where("not failed").groupBy("id", "label").agg(F.min(F.struct(*RATIOS)).alias("r")).select("id", "label", "r.*")
    t = rows.toPandas().sort_values(["id", "label", *RATIOS])
    t = t.iloc[np.argsort(mix(np.arange(len(t), dtype=np.uint64)))]
    return learn_rules({r: t[r].to_numpy() for r in RATIOS}, (t["label"] == 0).to_numpy())


def verdict(rules: list[Rule], stats: str) -> tuple[Column, Column]:
    """The decision list as ordered conditional expressions over a struct of statistics: (keeps, text of the rule that rejects)."""
    keeps, why = F.lit(True), F.lit(None).cast("string")
    for rule in reversed(rules):
        hit = F.lit(True)
        for test in rule:
            hit = hit & test.column(stats)
        keeps = F.when(hit, F.lit(False)).otherwise(keeps)
        why = F.when(hit, F.lit(" and ".join(map(str, rule)))).otherwise(why)
    return keeps, why


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labels: int = 20_000) -> DataFrame:
    """The input with statistics, base_failed, kept and the deciding rule, as the struct column ``quality``.

    Null and empty texts have zero statistics and fail the base rules. Rows that repeat
    an id are judged each by its own text. All columns of the input stay; one that is
    called ``quality`` is replaced. An empty table stays empty.
    """
    rules = train(docs, labels, id_col, text_col, max_labels=max_labels)
    out = docs.withColumn("quality", text_stats(F.col(text_col)))
    failed = base_failed(F.col("quality.n_words"), F.col("quality.n_repeat_words"))
    keeps, why = verdict(rules, "quality")
    return out.withColumn(
        "quality", F.struct("quality.*", failed.alias("base_failed"), (~failed & keeps).alias("kept"), F.when(failed, "base").otherwise(why).alias("rule"))
    )
