"""Mergeable quantile sketches (KLL), stored as columns and merged over any window.

A sketch of ``k`` keeps a bounded number of values whatever it has seen. Its
rank error is at most ``rank_error(k)`` of the values it holds, with 99 %
confidence for any one rank; merging sketches of equal ``k`` keeps
that bound, so daily sketches answer for a week.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The size parameter of stored sketches (8 to 65535).
DEFAULT_K = 200


def rank_error(k: int) -> float:
    """The normalised rank error of a sketch of ``k``: the published fit of the KLL sketch for one rank, 99 % confidence (1.33 % at 200)."""
    return 2.296 / k**0.9723


def sketch_of(value: Column, k: int = DEFAULT_K) -> Column:
    """A sketch of the non-NULL values of a group; NULL for a group without one."""
    return F.kll_sketch_agg_bigint(value.cast("bigint"), F.lit(k))


def merged_sketch(sketch: Column, k: int = DEFAULT_K) -> Column:
    """One sketch of all that the sketches of a group have seen."""
    return F.kll_merge_agg_bigint(sketch, F.lit(k))


def sketch_quantiles(sketch: str, specs: Mapping[str, tuple[str, float]]) -> list[Column]:
    """The quantiles of ``specs`` from a sketch: double for ``cont``, bigint for ``exact``; both are values that were seen."""
    out = []
    for name, (kind, p) in specs.items():
        value = F.kll_sketch_get_quantile_bigint(F.col(sketch), F.lit(float(p)))
        out.append(value.cast("double" if kind == "cont" else "bigint").alias(name))
    return out
