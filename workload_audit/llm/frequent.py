"""The most frequent keys of a count table, as many as a bound allows, without sorting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def most_frequent(counts: DataFrame, column: str, least: int, most: int) -> DataFrame:
    """Rows of ``counts`` whose ``column`` is at least ``least``; if those are more than ``most``, at least the first power of two above which no more are.

    So at most ``most`` rows are left. The bound comes from a histogram of powers of two (64 rows).
    """
    often = counts.filter(F.col(column) >= least)
    by_power = {r["power"]: r["n"] for r in often.groupBy(F.floor(F.log2(column) + 1e-9).cast("int").alias("power")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, bound = 0, None
    for power in sorted(by_power, reverse=True):
        total += by_power[power]
        if total > most:
            break
        bound = power
    if total <= most:
        return often
    return often.filter(F.col(column) >= (2 ** bound if bound is not None else 2**62))
