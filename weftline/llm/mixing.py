"""Mixing to target weights: domain posteriors from a classifier, and nonnegative rates by projected gradient least squares."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, saved


def train_classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str, text_col: str, n_features: int = 4096, max_labels: int = 20_000):
    """Multinomial logistic regression on hashed words, or None where fewer than two of the domains have labelled documents.

    Learns from at most ``max_labels`` rows of ``labelled(id, domain)``, chosen by a hash
    of the id; nulls and other domains teach nothing, and of several domains of an id
    the first in order counts.
    """
    own = labelled.dropna().where(F.col("domain").isin(domains)).groupBy("id").agg(F.min("domain").alias("domain"))
    own = own.orderBy(F.xxhash64("id"), "id").limit(max_labels)
    number = F.coalesce(*[F.when(F.col("domain") == d, F.lit(float(k))) for k, d in enumerate(domains)])
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # documents that repeat an id teach once, by the text with the least hash
    rows = texts.join(F.broadcast(own), "id").groupBy("id").agg(F.min_by(F.struct("text", number.alias("label")), F.struct(F.xxhash64("text"), "text")).alias("r"))
    rows = saved(rows.select("r.text", "r.label"))
    if rows.select("label").distinct().count() < 2:
        return None
    words = RegexTokenizer(inputCol="text", outputCol="words", pattern=WORD, gaps=False)
    bag = HashingTF(inputCol="words", outputCol="features", numFeatures=n_features)
    return Pipeline(stages=[words, bag, LogisticRegression(maxIter=40, regParam=0.01, family="multinomial")]).fit(rows)


def posteriors(docs: DataFrame, model, n_domains: int, text: Column) -> DataFrame:
    """The frame with ``tokens`` (words of the text) and the array ``p`` of domain probabilities."""
    out = docs.withColumn("text", F.coalesce(text, F.lit("")))
    if model is None:
        even = F.array(*[F.lit(1.0 / n_domains)] * n_domains)
        return out.withColumn("tokens", F.regexp_count("text", F.lit(WORD)).cast("long")).withColumn("p", even).drop("text")
    out = model.transform(out)
    p = vector_to_array("probability")
    # a domain without a labelled document has no class of its own at the end of the vector
    p = F.concat(p, F.array_repeat(F.lit(0.0), F.greatest(F.lit(n_domains) - F.size(p), F.lit(0))))
    return out.select(*[c for c in docs.columns], F.size("words").cast("long").alias("tokens"), p.alias("p"))


#: A projected-gradient step: one number per domain, and the momentum of the point it starts from.
Step = tuple[np.ndarray, float]
#: Steps after which the rates so far are written down, so that a pass repeats no more than these.
_REPLAYED = 25


def rates(p: np.ndarray, steps: list[Step], most: float | None, rate: np.ndarray | None = None, old: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rate, the one before) after projected-gradient steps from rates of 1, or from the given ones.

    A step holds one number per domain, so a document's rate depends on its posteriors
    alone and can be recomputed anywhere from the history of steps.
    """
    if rate is None or old is None:
        rate = old = np.ones(len(p))
    for step, momentum in steps:
        point = rate + momentum * (rate - old)
        rate, old = np.clip(point - p @ step, 0.0, most), rate
    return rate, old


def _matrix(column: pd.Series, n: int) -> np.ndarray:
    return np.array(column.tolist(), dtype=float).reshape(len(column), n)


def fit(weighted: DataFrame, share: np.ndarray, total: float, most: float | None, shrink: bool, max_steps: int, tolerance: float) -> tuple[list[Step], float, bool]:
    """(steps, total, met): the steps for ``rates`` that bring the domain totals of ``weighted(tokens, p)`` to share * total.

    Minimises the squared difference of the domain totals sum(rate * tokens * p) and the
    targets over rates in [0, most] by projected gradient. Differences are measured, and
    rates moved, in the metric of the domains' Gram matrix sum(tokens * p p'), in which steps of
    length 1 always descend; momentum is dropped whenever it points uphill. A pass over
    the rows adds up what the driver needs for the next step: a few numbers per domain.
    It ends when the targets are met within the tolerance, or after ``max_steps``.

    With ``shrink`` a total out of reach is lowered: every step proves a bound, as no
    rates up to most add up to more in its direction. The total follows the least bound
    so far and then stays 1.5 % below it, or below that where this isn't met either.
    """
    n = len(share)
    base = weighted.select("tokens", "p", F.lit(1.0).alias("rate"), F.lit(1.0).alias("old"))

    def summed(rows: DataFrame, own: list[Step], step: np.ndarray) -> np.ndarray:
        """Domain totals (n), their Gram matrix (n * n), momentum's slope, and what rates of most reach against the step."""

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros(n + n * n + 2)
            for part in parts:
                p, t = _matrix(part["p"], n), part["tokens"].to_numpy(dtype=float)
                given = part["rate"].to_numpy(), part["old"].to_numpy()
                rate, old = rates(p, own[:-1], most, *given)
                if own:
                    point = rate + own[-1][1] * (rate - old)
                    new = rates(p, own[-1:], most, rate, old)[0]
                    out[-2] += ((point - new) * (new - rate)) @ t
                    rate = new
                out[:n] += (rate * t) @ p
                out[n:-2] += (p.T @ (p * t[:, None])).ravel()
                out[-1] += t @ np.maximum(-(p @ step), 0)
            yield pd.DataFrame({"k": np.arange(len(out)), "x": out})

        found = rows.mapInPandas(run, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(n + n * n + 2)
        for r in found:
            out[r["k"]] = r["x"]
        return out

    def moved(rows: DataFrame, own: list[Step]) -> DataFrame:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                rate, old = rates(_matrix(part["p"], n), own, most, part["rate"].to_numpy(), part["old"].to_numpy())
                yield part.assign(rate=rate, old=old)

        return saved(rows.mapInPandas(run, rows.schema))

    steps: list[Step] = []
    state = summed(base, [], np.zeros(n))
    reached = before = state[:n]
    gram = state[n:-2].reshape(n, n)
    scale = np.trace(gram)
    if scale <= 0:
        return steps, total, True
    inverse = np.linalg.inv(gram + 1e-9 * scale / n * np.eye(n))
    bound, below, momentum, speed, since, written = total, 1.0, 0.0, 1.0, 0, 0
    met = False
    for _ in range(max_steps):
        targets = share * total
        met = bool(np.abs(reached - targets).max() <= tolerance * targets.sum())
        if met:
            break
        step = inverse @ (reached + momentum * (reached - before) - targets)
        steps.append((step, momentum))
        if len(steps) - written > _REPLAYED:
            base, written = moved(base, steps[written:-1]), len(steps) - 1
        state = summed(base, steps[written:], step)
        before, reached = reached, state[:n]
        if state[-2] > 0:
            momentum, speed = 0.0, 1.0
        else:
            faster = (1 + (1 + 4 * speed * speed) ** 0.5) / 2
            momentum, speed = (speed - 1) / faster, faster
        since += 1
        if shrink and most is not None:
            if share @ step < 0:
                bound = min(bound, most * state[-1] / -(share @ step))
            falls = below * bound < total * (1 - tolerance / 10) and since >= 20
            if falls or since >= (60 if below == 1 else 300):
                below *= 1.0 if falls else 0.985
                total, since, momentum, speed = below * bound, 0, 0.0, 1.0
    return steps, total, met


def fit_steps(weighted: DataFrame, targets: np.ndarray, most: float | None, max_steps: int = 1000, tolerance: float = 1e-4) -> list[Step]:
    """The steps for ``rates`` that bring the expected domain totals of ``weighted(tokens, p)`` to the targets; warns if they can't."""
    steps, _, met = fit(weighted, np.asarray(targets, dtype=float), 1.0, most, False, max_steps, tolerance)
    if not met:
        warnings.warn("mixing targets can't be met by any rates; took the nearest", stacklevel=2)
    return steps


def mix(
    docs: DataFrame,
    labelled: DataFrame,
    weights: dict[str, float],
    id_col: str = "doc_id",
    text_col: str = "text",
    total: str | float = "natural",
    most: float | None = None,
) -> DataFrame:
    """One row per input row: id, tokens, p (a posterior per domain in the order of ``weights``), rate, copies.

    A classifier learned from ``labelled(id, domain)`` predicts how far each document
    belongs to each domain. Rates in [0, ``most``] make the expected tokens of domain j,
    sum(rate * tokens * p_j), its share of the total: all tokens of the input
    ("natural"), the largest total that needs no rate above 1 ("no repeats"; with
    ``most`` lowered until it is in reach, to 1.5 % below the proved bound or less), or a number. Where
    no rates meet the targets the nearest are taken, with a warning. ``copies`` rounds a rate to whole copies by a hash of the document.

    Null and empty texts have 0 tokens and don't bear on the totals. Rows that repeat
    an id have posteriors of their own text. Without two labelled domains all
    posteriors are even and one rate serves all. Null ids are kept; other columns are
    ignored; an empty table gives an empty result.
    """
    domains = list(weights)
    share = np.array([weights[d] for d in domains], dtype=float)
    share /= share.sum()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = train_classifier(own, labelled, domains, "id", "text")
    dice = (F.pmod(F.xxhash64("id", F.col("text")), F.lit(1_000_003)) / 1_000_003).alias("dice")
    known = posteriors(own.select("id", dice, "text").withColumnRenamed("text", "raw"), model, len(domains), F.col("raw")).select("id", "dice", "tokens", "p")
    known = saved(known)
    natural = known.agg(*[F.sum(F.col("tokens") * F.get("p", F.lit(k))).alias(str(k)) for k in range(len(domains))]).first()
    natural = np.array([x or 0.0 for x in natural])
    steps = None
    if total == "natural":
        total = natural.sum()
    elif total == "no repeats":
        total = min((n / s for n, s in zip(natural, share) if s > 0), default=0.0)
        if most is not None and total > 0:
            steps, reached, met = fit(known, share, float(total), most, True, 1000, 1e-4)
            # no total at all may be in reach; then the nearest totals are taken, with a warning
            total, steps = (reached, steps) if met and reached > 1e-3 * total else (total, None)
    if steps is None:
        steps = fit_steps(known, share * total, most, max_steps=300)

    def rated(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rate = rates(np.array(part["p"].tolist(), dtype=float).reshape(len(part), len(domains)), steps, most)[0]
            yield part.assign(rate=rate, copies=np.floor(rate + 1 - part["dice"].to_numpy()).astype("int64"))

    kind = known.schema["id"].dataType.simpleString()
    out = known.mapInPandas(rated, f"id {kind}, dice double, tokens long, p array<double>, rate double, copies long")
    return out.select(F.col("id").alias(id_col), "tokens", "p", "rate", "copies")


def label_domains(labels: DataFrame, low: str | None = "low") -> DataFrame:
    """(id, domain) of the table of labels: toxic, else low (if wanted) for quality 0, else clean."""
    domain = F.when(F.col("toxic") == 1, "toxic")
    if low:
        domain = domain.when(F.col("quality") == 0, low)
    known = F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull())
    return labels.where(known).select(F.col("doc_id").alias("id"), domain.otherwise("clean").alias("domain"))
