"""Quality scores learned from preferences between documents (operator 5)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import fold, labelled_sample, matrix, with_statistics
from .storage import cut
from .textops import STAT_NAMES

#: Labelled rows that the scores are learned from, at most, and preference pairs drawn for each of them.
MAX_LABELLED, PAIRS_EACH = 20_000, 4


@dataclass(frozen=True)
class Ranking:
    """score = sigmoid(raw - cut + logit(accept)): it is at least ``accept`` from the raw score ``cut`` on."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    accept: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return expand((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.raw(x) - self.cut + np.log(self.accept / (1 - self.accept))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def expand(z: np.ndarray) -> np.ndarray:
    """Standardised features, clipped, with their absolute values: a quality may lie at the middle of a feature."""
    z = np.clip(z, -6, 6)
    return np.column_stack([z, np.abs(z)])


def fit_ranking(x: np.ndarray, y: np.ndarray, accept: float = 0.3, ridge: float = 1e-3, steps: int = 30, seed: int = 11) -> Ranking:
    """Bradley-Terry scores: P(a is preferred to b) = sigmoid(score(a) - score(b)).

    Each row is paired with ``PAIRS_EACH`` random rows of the other label, the one with label 1 being preferred;
    Newton steps minimise the logistic loss on the feature differences, which
    has no constant term. The cut is the quantile of the learned scores that
    leaves as large a part of the rows below as has label 0.
    Without both labels all weights are 0 and the score is ``accept`` for label 1 only or none, and below it for label 0 only.
    """
    width = x.shape[1]
    mean = x.mean(0) if len(x) else np.zeros(width)
    scale = np.where(x.std(0) > 1e-12, x.std(0), 1.0) if len(x) else np.ones(width)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    weights = np.zeros(2 * width)
    if not len(good) or not len(bad):
        return Ranking(mean, scale, weights, 1e-9 if len(bad) else 0.0, accept)
    z = expand((x - mean) / scale)
    rng = np.random.default_rng(seed)
    a = np.concatenate([np.repeat(good, PAIRS_EACH), rng.choice(good, PAIRS_EACH * len(bad))])
    b = np.concatenate([rng.choice(bad, PAIRS_EACH * len(good)), np.repeat(bad, PAIRS_EACH)])
    d = z[a] - z[b]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ weights, -500, 500)))
        slope = d.T @ (p - 1) / len(d) + ridge * weights
        curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(weights))
        step = np.linalg.solve(curve, slope)
        weights = weights - step / max(1.0, np.linalg.norm(step) / 5)
        if np.linalg.norm(step) < 1e-8:
            break
    raw = np.sort(z @ weights)
    k = len(bad)
    return Ranking(mean, scale, weights, float((raw[k - 1] + raw[k]) / 2), accept)


def rank_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", accept: float = 0.3, max_labelled: int = MAX_LABELLED,
    id_col: str = "doc_id", text_col: str = "text", keyed: bool = False,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document; ``keyed`` adds text_key, which with the id tells whose verdict it is.

    Scores depend on the text alone. They are learned from at most
    ``max_labelled`` labelled rows outside fold 0 (crc32 of the id as text, modulo 5), those with the smallest id
    hashes; ``predicted`` is 1 from a score of ``accept`` on, which stands at the score quantile chosen in ``fit_ranking``.

    Null or empty texts are scored as texts without words. A null id is never labelled. Repeated rows
    score alike. Without labels every score is the same. Other columns are not read.
    """
    stats = cut(with_statistics(docs, id_col, text_col, keyed))
    own = ["doc_id", *["text_key"] * keyed]
    sample = labelled_sample(stats, labels, label, max_labelled, "pairs")
    model = fit_ranking(matrix(sample), sample["label"].to_numpy(np.float64), accept)

    def judge(frames):
        for frame in frames:
            score = model.score(matrix(frame))
            yield frame[own].assign(score=score, predicted=(score >= accept).astype(np.int32))

    scored = stats.select(*own, *STAT_NAMES).mapInPandas(judge, ", ".join(f"{x} long" for x in own) + ", score double, predicted int")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted", *own[1:])


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return rank_quality(docs, labels)
