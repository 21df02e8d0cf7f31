"""Quality rules: boosted trees over document statistics, scored as flat numpy node arrays (operator 3)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import FEATURES, labelled_sample, matrix, with_statistics
from .storage import cut
from .textops import STAT_NAMES

#: Features in which a document's score may only fall: the more of them, the worse the text.
FALLING = ("symbol_rate", "shout_rate", "bar_rate", "dup_line_rate", "repeat_rate")
#: Labelled rows that the trees are fitted on, at most.
MAX_LABELLED = 20_000


@dataclass(frozen=True)
class Trees:
    """All nodes of all trees in flat arrays. A leaf has itself as both children."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit_trees(
    x: np.ndarray, y: np.ndarray, monotone: Sequence[int], rounds: int = 60, depth: int = 3, rate: float = 0.15,
    bins: int = 48, least: float = 1.0, ridge: float = 1.0,
) -> Trees:
    """Second-order boosting of histogram trees with logistic loss.

    ``monotone``: -1, 0 or 1 for each feature. A split on a constrained feature
    must order the values of its children, and the midpoint between them bounds
    everything below, so the sum of trees is monotone in that feature.
    With one class only, or without rows, the trees are empty and the score is constant.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(share / (1 - share)))
    nodes: dict[str, list] = {k: [] for k in ("feature", "cut", "left", "right", "value")}
    roots: list[int] = []
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        codes = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
        total = np.full(len(y), start)

        def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
            me = len(nodes["value"])
            own = float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high))
            for k, v in (("feature", 0), ("cut", np.inf), ("left", me), ("right", me), ("value", rate * own)):
                nodes[k].append(v)
            best = None
            if level < depth:
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gs = np.cumsum(np.bincount(codes[rows, j], g[rows], len(c) + 1))
                    hs = np.cumsum(np.bincount(codes[rows, j], h[rows], len(c) + 1))
                    gl, hl, gr, hr = gs[:-1], hs[:-1], gs[-1] - gs[:-1], hs[-1] - hs[:-1]
                    vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                    gain = -(gl * vl + (hl + ridge) * vl**2 / 2) - (gr * vr + (hr + ridge) * vr**2 / 2)
                    gain = np.where((hl < least) | (hr < least) | (monotone[j] * (vr - vl) < 0), -np.inf, gain)
                    b = int(np.argmax(gain))
                    if np.isfinite(gain[b]) and (best is None or gain[b] > best[0]):
                        best = (float(gain[b]), j, b, float(vl[b]), float(vr[b]))
            stay = -(g[rows].sum() * own + (h[rows].sum() + ridge) * own**2 / 2)
            if best is None or best[0] <= stay + 1e-9:
                total[rows] += rate * own
                return me
            _, j, b, vl, vr = best
            mid = (vl + vr) / 2
            bounds = ((low, high), (low, high)) if not monotone[j] else ((low, mid), (mid, high)) if monotone[j] > 0 else ((mid, high), (low, mid))
            inside = codes[rows, j] <= b
            nodes["feature"][me], nodes["cut"][me] = j, float(cuts[j][b])
            nodes["left"][me] = grow(rows[inside], g, h, level + 1, *bounds[0])
            nodes["right"][me] = grow(rows[~inside], g, h, level + 1, *bounds[1])
            return me

        for _ in range(rounds):
            p = 1 / (1 + np.exp(-total))
            roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
    kinds = {"feature": np.int64, "cut": np.float64, "left": np.int64, "right": np.int64, "value": np.float64}
    return Trees(np.array(roots, np.int64), *(np.array(nodes[k], kinds[k]) for k in kinds), depth, start)


def quality_rules(
    docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.5, max_labelled: int = MAX_LABELLED,
    min_words: int = 10, max_repeat: int = 20, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Statistics, base rules and the trees' verdict for each document.

    The base rules fail a document of fewer than ``min_words`` words or with more than
    ``max_repeat`` % of them in repeated 5-word windows. ``kept`` is false for those and otherwise whether the trees' ``score`` is
    at least ``threshold``. The trees are fitted on at most ``max_labelled`` labelled rows outside fold 0
    (the ones with the smallest id hashes); everything else covers all rows.

    Null or empty texts have no words and fail. Null ids are kept as null and
    never labelled. Without labels, or with one class of them, the score is a constant.
    Repeated rows are judged alike. Other columns are not read.
    """
    stats = cut(with_statistics(docs, id_col, text_col))
    sample = labelled_sample(stats, labels, label, max_labelled, "rules")
    falling = [-int(f in FALLING) for f in FEATURES]
    trees = fit_trees(matrix(sample), sample["label"].to_numpy(np.float64), falling)

    def judge(frames):
        for frame in frames:
            base = (frame["n_words"] < min_words) | (100 * frame["n_repeat_words"] > max_repeat * frame["n_words"])
            score = trees.score(matrix(frame))
            yield frame.assign(base_failed=base, score=score, kept=~base & (score >= threshold))

    schema = "doc_id long, " + ", ".join(f"{x} long" for x in STAT_NAMES) + ", base_failed boolean, score double, kept boolean"
    return stats.mapInPandas(judge, schema)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality_rules(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score")
    )


