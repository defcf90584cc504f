"""Quality scores by positive-unlabelled learning.

Trusted positives and unlabelled text train a logistic model on figures of the text's form, bent at one deviation to either side.
The risk is the non-negative unbiased one: with class prior pi, pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)). With logistic loss
and a model linear in its weights it is the larger of two convex functions: pi * R_p(+), and that plus the negatives' part. So it
has one minimum, often on the edge at which the two are equal; steps solve the larger of the two quadratic models.

The prior is estimated from the same rows: a classifier fitted on each half of them tells positives from unlabelled text in the
other half. There the share of unlabelled rows above a threshold is at least pi times that of positives; the threshold with the
smallest upper confidence bound of their ratio gives an estimate. The mean of both, less its standard error, is taken: a prior
above the truth calls all rows positive, one somewhat below it costs little.

All rows take part: whole texts are measured once, and each step is a Spark job that sums gradient and curvature over the measures.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import is_held_out, map_batches, materialize, slices

_SYMBOL = re.compile(r"[#*$%&|<>=_~^{}\[\]\\/@+]")
_SENTENCE = re.compile(r"[.!?]+(?:\s|$)")
FEATURES = ("log_words", "word_chars", "symbols", "digits", "upper", "exclaims", "pipes", "distinct_words", "repeated_threes", "repeated_lines", "compressed", "letters", "sentence_words", "capital_starts", "newlines", "commas", "top_word", "long_words", "empty")


@dataclass(frozen=True)
class PuParams:
    """rounds: most steps. penalty: of squared weights, halved. tolerance: of the risk, by which the last step's model would still lower it. confidence: that a ratio of shares is below its bound."""

    rounds: int = 40
    penalty: float = 0.01
    tolerance: float = 1e-7
    confidence: float = 0.9


def features(text: str | None) -> list[float]:
    """Figures of the form of a whole text; all zero but the last for a null text or one without a word."""
    words = text.split() if text else []
    if not words:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    n, chars = len(words), len(text)
    counts = Counter(words)
    threes = list(zip(words, words[1:], words[2:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    raw = text.encode("utf-8", "surrogatepass")
    letters = sum(map(str.isalpha, text))
    return [
        np.log1p(n), chars / n / 10, len(_SYMBOL.findall(text)) / n, sum(map(str.isdigit, text)) / chars, sum(map(str.isupper, text)) / max(1, letters), text.count("!") / n, text.count("|") / n,
        len(counts) / n, 1 - len(set(threes)) / len(threes) if threes else 0.0, 1 - len(set(lines)) / len(lines), len(zlib.compress(raw, 1)) / len(raw), letters / chars, n / max(1, len(_SENTENCE.findall(text))) / 20,
        sum(w[0].isupper() for w in words) / n, len(lines) / n, text.count(",") / n, counts.most_common(1)[0][1] / n, sum(len(w) > 20 for w in words) / n, 0.0,
    ]


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and x, the features of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "x": pa.array(x, pa.list_(pa.float64()))})

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, x array<double>")


def bent(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """A one, each standardised figure, and how far it is above and below one deviation."""
    z = np.clip((x - mean) / scale, -8, 8)
    return np.concatenate([np.ones((len(z), 1)), z, np.maximum(0, z - 1), np.maximum(0, -z - 1)], axis=1)


@dataclass(frozen=True)
class PuModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of a positive."""
        return 1 / (1 + np.exp(-np.clip(bent(x, self.mean, self.scale) @ self.weights, -30, 30)))


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Features and whether trusted as positive, of each row."""
    return b.column("x").flatten().to_numpy().reshape(-1, len(FEATURES)), b.column("positive").to_numpy(zero_copy_only=False)


def total(rows: DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of part(features, positive) over all rows: an array of a fixed size, summed within tasks, then by Spark, entry by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            if b.num_rows:
                v = part(*_arrays(b))
                out = v if out is None else out + v
        if out is not None:
            yield pa.RecordBatch.from_pydict({"v": pa.array([out], pa.list_(pa.float64()))})

    sums = map_batches(rows.select("x", "positive"), run, "v array<double>").select(F.posexplode("v").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
    return np.array([r["v"] for r in sums.orderBy("k").collect()])  # as many numbers as the model has squared weights


def risk_terms(phi: np.ndarray, positive: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums over rows: how many are unlabelled and positive, losses of unlabelled rows as negatives, of positives as positives and as
    negatives, then the gradients of the first two losses, the sum of positive rows, and both curvatures.

    Every row is unlabelled; trusted ones are positives besides.
    """
    z = np.clip(phi @ w, -30, 30)
    g = 1 / (1 + np.exp(-z))
    minus, plus = np.logaddexp(0, z), np.logaddexp(0, -z)
    p = positive.astype(float)
    curve = g * (1 - g)
    parts = [len(z), p.sum(), minus.sum(), (p * plus).sum(), (p * minus).sum(), phi.T @ g, phi.T @ (p * (g - 1)), phi.T @ p, (phi.T * curve) @ phi, (phi.T * (curve * p)) @ phi]
    return np.concatenate([np.ravel(x) for x in parts])


def _pieces(s: np.ndarray, d: int, prior: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, gradients and curvatures of the convex functions of which the risk is the largest: that of positives, and that with
    the negatives' part. Without a prior there is one: of telling positives from unlabelled rows."""
    n_u, n_p, minus_u, plus_p, minus_p = s[:5]
    g_u, g_p, sum_p = s[5 : 5 + 3 * d].reshape(3, d)
    h_u, h_p = s[5 + 3 * d :].reshape(2, d, d)
    if prior is None:
        return np.array([minus_u / n_u + plus_p / n_p]), (g_u / n_u + g_p / n_p)[None], (h_u / n_u + h_p / n_p)[None]
    only = prior * plus_p / n_p
    # l(+) - l(-) of a positive is -z
    return np.array([only, only + minus_u / n_u - prior * minus_p / n_p]), np.array([prior * g_p / n_p, g_u / n_u - prior * sum_p / n_p]), np.array([prior * h_p / n_p, h_u / n_u])


def _step(value: np.ndarray, g: np.ndarray, h: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The step to the least of the larger linear model plus curvature, the shares of both pieces in it, and how far it lowers it.

    share: of the pieces in the curvature. Two linear pieces have a dual of one number, a parabola's top within 0 and 1.
    """
    for _ in range(2):  # once more with the curvature of the shares found
        curve = np.tensordot(share, h, 1)
        if len(value) == 2:
            apart = g[0] - g[1]
            solved = np.linalg.solve(curve, apart)
            bent = apart @ solved
            first = float(np.clip((value[0] - value[1] - solved @ g[1]) / bent, 0, 1)) if bent > 1e-300 else 0.0
            before, share = share, np.array([first, 1 - first])
    curve = np.tensordot(before, h, 1) if len(value) == 2 else curve
    step = np.linalg.solve(curve, share @ g)
    return step, share, float(value.max() - (value - g @ step).max() - step @ curve @ step / 2)


def descend(pieces: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], ridge: np.ndarray, p: PuParams) -> np.ndarray:
    """Weights of the least of the largest piece plus the penalty. A step that doesn't lower it as far as its model tells is halved."""

    def at(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        value, g, h = pieces(w)
        return value + (ridge * w * w).sum() / 2, g + ridge * w, h + np.diag(ridge)

    w = np.zeros(len(ridge))
    here = at(w)
    share = np.eye(len(here[0]))[-1]
    for _ in range(p.rounds):
        step, share, gain = _step(*here, share)
        value = here[0].max()
        if gain < p.tolerance * value:
            break
        part = 1.0
        while part > 1e-3 and (there := at(w - part * step))[0].max() > value - 1e-3 * part * gain:
            part /= 2
        if part <= 1e-3:
            break
        w, here = w - part * step, there
    return w


def minimise(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, prior: float | None, p: PuParams) -> np.ndarray:
    """Weights of the least risk of the rows; each trial of weights is a Spark job."""
    ridge = np.full(1 + 3 * len(FEATURES), p.penalty)
    ridge[0] = 1e-8
    return descend(lambda w: _pieces(total(rows, lambda x, y: risk_terms(bent(x, mean, scale), y, w)), len(ridge), prior), ridge, p)


#: Steps of a log odds, from -30 to 30, at which shares of rows are compared.
_STEPS = 1200


def estimate_prior(unlabelled: np.ndarray, positive: np.ndarray, confidence: float = 0.9) -> tuple[float, float]:
    """Share of positives in unlabelled rows and its standard error, from counts of both per step of the first classifier's score, lowest first.

    At a threshold that a share q of positives and a share u of unlabelled rows pass, the prior is at most u / q but for chance;
    the threshold is that of the least bound (u + e) / q, where e is how far shares of so many rows stray. Without any rows: a half.
    """
    n_u, n_p = max(1, unlabelled.sum()), max(1, positive.sum())
    up, pp = np.cumsum(unlabelled[::-1]) / n_u, np.cumsum(positive[::-1]) / n_p
    e = sum(math.sqrt(math.log(4 / (1 - confidence)) / (2 * n)) for n in (n_u, n_p))
    some = pp > 0
    if not some.any() or not up[some].any():
        return 0.5, 0.0
    at = np.flatnonzero(some)[np.argmin((up[some] + e) / pp[some])]
    u, q = up[at], pp[at]
    return float(u / q), float(u / q * math.sqrt(max(0.0, (1 - u) / max(u, 1 / n_u) / n_u + (1 - q) / q / n_p)))


def fit(rows: DataFrame, params: PuParams = PuParams()) -> PuModel:
    """rows: x and positive, see `with_positives`. Without a positive or with fewer than two rows every score is even."""
    p, d = params, len(FEATURES)
    first = total(rows, lambda x, y: np.concatenate([[len(x), y.sum()], x.sum(axis=0), (x * x).sum(axis=0)]))
    if len(first) < 2 or first[0] < 2 or first[1] < 1:
        return PuModel(np.zeros(d), np.ones(d), np.zeros(1 + 3 * d), 0.5)
    mean = first[2 : 2 + d] / first[0]
    scale = np.sqrt(np.maximum(0, first[2 + d :] / first[0] - mean * mean)) + 1e-6
    half = F.pmod(F.xxhash64("x", F.lit("half")), F.lit(2)) == 0
    found = []
    for learned, judged in ((half, ~half), (~half, half)):
        if not rows.where(learned & F.col("positive")).isEmpty():
            weights = minimise(rows.where(learned), mean, scale, None, p)

            def counts(x: np.ndarray, positive: np.ndarray, weights: np.ndarray = weights) -> np.ndarray:
                z = np.clip(bent(x, mean, scale) @ weights, -30, 30)
                step = np.minimum(((z + 30) * (_STEPS / 60)).astype(np.int64), _STEPS - 1)
                return np.concatenate([np.bincount(step, minlength=_STEPS), np.bincount(step[positive], minlength=_STEPS)]).astype(float)

            seen = total(rows.where(judged), counts)
            if len(seen) and seen[_STEPS:].any():
                found.append(estimate_prior(seen[:_STEPS], seen[_STEPS:], p.confidence))
    prior = 0.5
    if found:
        share, error = np.array(found).T
        prior = float(np.clip(share.mean() - np.sqrt((error**2).sum()) / len(found), 0.01, 0.99))
    return PuModel(mean, scale, minimise(rows, mean, scale, prior, p), prior)


def with_positives(measured: DataFrame, positives: DataFrame) -> DataFrame:
    """measured (doc_id, x) with whether its doc_id is among the positives; only figures are shuffled, no texts."""
    known = positives.select("doc_id").distinct().withColumn("positive", F.lit(True))
    return measured.join(known, "doc_id", "left").withColumn("positive", F.coalesce("positive", F.lit(False)))


def score(measured: DataFrame, model: PuModel, threshold: float = 0.7) -> DataFrame:
    """Per row of measured (doc_id, x): doc_id, score, predicted (1 from the threshold on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "score": pa.array(model.score(x), pa.float64())})

    out = map_batches(measured.select("doc_id", "x"), run, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, params: PuParams = PuParams()) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from rows that aren't held out, positives being labels with quality 1.

    A null text counts as empty, and empty texts get a score like others. Equal texts have equal scores; other columns are
    ignored; an empty table gives an empty result. A row without doc_id is unlabelled text and not held out.
    """
    measured = materialize(measure(docs), "measures")
    positives = labels.where("quality = 1").where(~is_held_out())
    model = fit(materialize(with_positives(measured.where(~is_held_out()), positives), "pu-rows"), params)
    return score(measured, model).select("doc_id", is_held_out().alias("held_out"), "score", "predicted")
