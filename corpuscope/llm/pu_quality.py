"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good outside the held-out fold; unlabelled ones are a sample of the web text. No
label of a bad document is read. The non-negative risk estimator keeps the estimated risk on unlabelled negatives from going
below zero, which would reward overfitting. The class prior is estimated from the scores of a first
positive-against-unlabelled classifier, and the score EVEN stands for the logit above which that share of the unlabelled
documents lies.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscope.llm.common import bounded_sample, fold, slices

#: Bounds of the fit: positives and unlabelled documents.
FIT_POSITIVES, FIT_UNLABELLED = 15_000, 15_000
#: Where a score means "as likely good as not".
EVEN = 0.3
SYMBOLS = "#*$%&|<>"
N_FEATURES = 20


def features(text: str | None) -> list[float]:
    """Counts of a whole text as ratios; all zero for a text without words."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    counts = Counter(words)
    lengths = list(map(len, words))
    chars = sum(lengths)
    lines = [x for x in text.split("\n") if x.strip()]
    runs = sum(map(str.__eq__, words, words[1:]))
    pairs, triples = len(set(zip(words, words[1:], strict=False))), len(set(zip(words, words[1:], words[2:], strict=False)))
    upper, title = sum(map(str.isupper, words)), sum(map(str.istitle, words))
    alpha = sum(map(str.isalpha, words))
    top = counts.most_common(3)
    return [
        np.log1p(n),
        chars / n,
        max(lengths) / 10,
        len(counts) / n,
        len(counts) / n**0.7,
        runs / n,
        pairs / max(1, n - 1),
        triples / max(1, n - 2),
        upper / n,
        title / n,
        alpha / n,
        top[0][1] / n,
        sum(c for _, c in top) / n,
        sum(map(text.count, SYMBOLS)) / n,
        text.count("|") / n,
        text.count("!") / n,
        sum(map(text.count, ".,;:?")) / n,
        sum(map(text.count, "0123456789")) / chars,
        len(set(lines)) / max(1, len(lines)),
        len(lines) / n,
    ]


@dataclass
class QualityModel:
    """An additive model: each feature is cut into bins, each bin has a weight."""

    cuts: list[np.ndarray]
    weights: np.ndarray
    bias: float
    prior: float
    even: float = 0.0  # the logit at which good is as likely as not

    def design(self, x: np.ndarray) -> np.ndarray:
        """Row numbers of the weights that apply: one per feature."""
        out, base = np.zeros(x.shape, np.int64), 0
        for j, cut in enumerate(self.cuts):
            out[:, j] = base + np.searchsorted(cut, x[:, j], side="right")
            base += len(cut) + 1
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.weights[self.design(x)].sum(1) + self.bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; EVEN where good is as likely as not."""
        return 1 / (1 + np.exp(-np.clip(self.logits(x) - self.even + np.log(EVEN / (1 - EVEN)), -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def pu_risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float | None) -> tuple[float, float, np.ndarray]:
    """The logistic PU risk at weights ``w`` (bias last): its positive part, its negative part and the direction to descend in.

    ``p`` and ``u`` hold the numbers of the weights that apply to each positive and each unlabelled row. The negative part is
    the risk of unlabelled rows as negatives, less that of the positives among them; where it is below zero, the direction
    leads back out of overfitting. Without a prior: positives against unlabelled, plainly.
    """

    def gradient(rows: np.ndarray, d: np.ndarray) -> np.ndarray:
        g = np.bincount(rows.ravel(), np.repeat(d, rows.shape[1]), len(w))
        g[-1] = d.sum()
        return g / len(rows)

    zp, zu = w[p].sum(1) + w[-1], w[u].sum(1) + w[-1]
    positive, unlabelled = np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean()
    up, uu = gradient(p, -_sigmoid(-zp)), gradient(u, _sigmoid(zu))
    if prior is None:
        return positive, unlabelled, up + uu
    negative = unlabelled - prior * np.logaddexp(0, zp).mean()
    minus = uu - prior * gradient(p, _sigmoid(zp))
    return prior * positive, negative, prior * up + minus if negative >= 0 else -minus


def _descend(model: QualityModel, p: np.ndarray, u: np.ndarray, prior: float | None, rounds: int, decay: float = 1e-3, rate: float = 0.05) -> None:
    """Adam on the logistic non-negative PU risk; without a prior, on plain positive-against-unlabelled."""
    w = np.append(model.weights, model.bias)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        g = pu_risk(w, p, u, prior)[2]
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model.weights, model.bias = w[:-1], float(w[-1])


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives among unlabelled, from scores of either: the least ratio of the shares above a threshold, with its sampling error."""
    at = np.quantile(p, np.linspace(0.02, 0.9, 60))
    above_p, above_u = (p[:, None] >= at).mean(0), (u[:, None] >= at).mean(0)
    error = np.sqrt(above_u / len(u)) + np.sqrt(above_p / len(p))
    best = int(np.argmin((above_u + error) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.98))


def even_point(unlabelled: np.ndarray, prior: float) -> float:
    """The logit above which as many of the unlabelled documents lie as the prior says are good."""
    return float(np.quantile(unlabelled, 1 - prior))


def fit_quality(docs: DataFrame, labels: DataFrame, positives: int = FIT_POSITIVES, unlabelled: int = FIT_UNLABELLED, bins: int = 10) -> QualityModel | None:
    """Fit on whole texts of about so many documents at most, none of the held-out fold; None without a positive.

    A document is trusted if any of its labels is 1; other labels are not read. Null ids take no part.
    """
    known = docs.where("doc_id is not null").where(fold(F.col("doc_id")) != 0).select("doc_id", "text")
    good = labels.where("quality = 1").select("doc_id").distinct()

    def measured(df: DataFrame, most: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                yield pa.record_batch([pa.array([features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64()))], names=["x"])

        # bounded, should one id have very many rows: the first by a hash of what was measured
        rows = df.select("text").mapInArrow(run, "x array<double>").orderBy(F.xxhash64("x"), "x").limit(2 * most).toArrow()["x"]
        x = rows.combine_chunks().flatten().to_numpy().reshape(-1, N_FEATURES)
        return x[np.lexsort(x.T)]  # the same order whatever the partitioning

    chosen = bounded_sample(good.where(fold(F.col("doc_id")) != 0), "doc_id", positives, "positive")
    p = measured(known.join(F.broadcast(chosen), "doc_id", "left_semi"), positives)
    u = measured(bounded_sample(known, "doc_id", unlabelled, "unlabelled"), unlabelled)
    if not len(p) or not len(u):
        return None
    cuts = [np.unique(np.quantile(np.concatenate([p[:, j], u[:, j]]), [0.005, 0.02, *np.linspace(0, 1, bins + 1)[1:-1], 0.95, 0.98, 0.995])) for j in range(N_FEATURES)]
    model = QualityModel(cuts, np.zeros(sum(len(c) + 1 for c in cuts)), 0.0, 0.5)
    rows = model.design(p), model.design(u)
    half = [np.arange(len(x)) % 2 == 0 for x in (p, u)]  # fitted on one half, estimated on the other
    _descend(model, rows[0][half[0]], rows[1][half[1]], None, 150, decay=1e-2)
    model.prior = estimate_prior(model.logits(p[~half[0]]), model.logits(u[~half[1]])) if min(len(p), len(u)) > 1 else 0.5
    model.weights, model.bias = np.zeros_like(model.weights), 0.0
    _descend(model, *rows, model.prior, 400, decay=max(1e-3, 3 / len(p)))
    model.even = even_point(model.logits(u), model.prior)
    return model


def score_documents(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """``doc_id, held_out, score, predicted``: one row per row of ``docs`` (doc_id, text).

    The score sees the text alone. A null text is an empty one; both get the score of a text without words. Without a model
    (nothing was labelled good) every score is EVEN. Long texts are measured whole, in batches bounded in bytes. Repeated rows and null ids are scored like any other (held_out is null
    for the latter); an empty table gives an empty one. Other columns are not carried.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([features(t) for t in batch.column(2).to_pylist()], float).reshape(-1, N_FEATURES)
            score = shared.value.scores(x) if shared.value else np.full(len(x), EVEN)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= EVEN).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "text").mapInArrow(run, schema)
