"""Grouped aggregates shared by the checks.

The query-log checks rank patterns on numbers alone and look up words last:

* ``counted``: counts and sums per (pattern, user) in one hash aggregation -
  fixed-width buffers, combined map-side, so a pattern holding a third of
  all rows never reaches one task as raw rows;
* ``totals``: the same per pattern, from which the ``top_n`` leaders are taken;
* ``with_primary_user``: the leaders' most frequent user (ties -> smallest
  name) from the per-user counts;
* ``with_sample_text``: the leaders' smallest text by a second read that only
  lets their rows through; each task passes on one text per pattern.

``counted`` keeps its numbers in one array column. Steps that use different
ones of them then still read the same shuffle, which Spark reuses, so the log
is read once for the ranking and the users.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SYSTEM_USER_LABEL

#: (name, operation, expression): sum / max / min / count_if of a 64-bit number.
Measure = tuple[str, str, Column]

_FIRST = {"sum": F.sum, "max": F.max, "min": F.min, "count_if": F.count_if}
_MERGE = {"sum": F.sum, "max": F.max, "min": F.min, "count_if": F.sum}


def system_user(user: Column) -> Column:
    """``''`` -> ``<system>``."""
    return F.when(user == "", F.lit(SYSTEM_USER_LABEL)).otherwise(user)


def measure_names(measures: Sequence[Measure]) -> list[str]:
    return [n for n, _, _ in measures]


def counted(df: DataFrame, by: Sequence[str], measures: Sequence[Measure] = ()) -> DataFrame:
    """(by, _m): the row count and the measures of each group, as an array of 64-bit numbers."""
    numbers = [F.count(F.lit(1)), *[_FIRST[op](e).cast("bigint") for _, op, e in measures]]
    return df.groupBy(*by).agg(F.array(*numbers).alias("_m"))


def merged(measures: Sequence[Measure]) -> list[Column]:
    """The measures of several ``_m``, merged."""
    return [_MERGE[op](F.col("_m")[i]).alias(n) for i, (n, op, _) in enumerate(measures, 1)]


def same_keys(keys: Sequence[str], prefix: str = "_k_") -> Column:
    """Equality of ``keys`` with their prefixed namesakes, NULL equal to NULL."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return cond


def user_counts(df: DataFrame, keys: Sequence[str], measures: Sequence[Measure] = (), user: str = "user") -> DataFrame:
    """(keys, _user, _m) per pattern and user; a NULL user is the empty one."""
    given = df.select(*keys, F.coalesce(F.col(user), F.lit("")).alias("_user"), *[e.alias(f"_in_{n}") for n, _, e in measures])
    return counted(given, [*keys, "_user"], [(n, op, F.col(f"_in_{n}")) for n, op, _ in measures])


def totals(counts: DataFrame, keys: Sequence[str], measures: Sequence[Measure] = ()) -> DataFrame:
    """(keys, executions, measures) of ``counted`` rows."""
    return counts.groupBy(*keys).agg(F.sum(F.col("_m")[0]).alias("executions"), *merged(measures))


def with_primary_user(leaders: DataFrame, counts: DataFrame, keys: Sequence[str], user: str = "_user", weight: Column | None = None) -> DataFrame:
    """``leaders`` with the most frequent user of each: equal counts go to the smallest name. ``weight`` replaces the row count."""
    named = leaders.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    per = counts.groupBy(*keys, F.coalesce(F.col(user), F.lit("")).alias("_u")).agg(F.sum(F.col("_m")[0] if weight is None else weight).alias("_uses"))
    first = Window.partitionBy(*keys).orderBy(F.desc("_uses"), F.asc("_u"))
    one = per.join(named, same_keys(keys)).withColumn("_row", F.row_number().over(first)).where("_row = 1")
    return one.select(*keys, *[c for c in leaders.columns if c not in keys], system_user(F.col("_u")).alias("primary_user"))


def with_sample_text(leaders: DataFrame, rows: DataFrame, keys: Sequence[str], text: str = "query") -> DataFrame:
    """``leaders`` with the smallest text of each. Where the leaders are few enough, which their limit tells Spark, they are sent to
    the read; the row limit of the window is applied in each task of it before anything is shuffled."""
    named = leaders.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    found = rows.select(*keys, F.col(text).alias("query_text")).join(named, same_keys(keys))
    first = Window.partitionBy(*keys).orderBy(F.col("query_text").asc_nulls_last())
    one = found.withColumn("_row", F.row_number().over(first)).where("_row = 1")
    return one.select(*keys, *[c for c in leaders.columns if c not in keys], "query_text")


def pattern_stats(
    df: DataFrame,
    keys: Sequence[str],
    measures: Sequence[Measure] = (),
    *,
    user: str = "user",
    text: str | None = "query",
) -> DataFrame:
    """``executions``, ``primary_user``, ``query_text`` and measures of every group, in one read.

    For reports on all patterns: it carries a text for each (group, user), which a ranking of a few leaders does not need.
    """
    keys = list(keys)
    first = [F.count(F.lit(1)).alias("_n")]
    if text:
        first.append(F.min(text).alias("_text"))
    first += [_FIRST[op](expr).alias(name) for name, op, expr in measures]
    per_user = df.groupBy(*[F.col(k) for k in keys], F.coalesce(F.col(user), F.lit("")).alias("_user")).agg(*first)

    second = [
        F.sum("_n").alias("executions"),
        F.min_by("_user", F.struct((-F.col("_n")).alias("n"), F.col("_user").alias("u"))).alias("_pu"),
    ]
    if text:
        second.append(F.min("_text").alias("query_text"))
    second += [_MERGE[op](F.col(name)).alias(name) for name, op, _ in measures]
    out = per_user.groupBy(*keys).agg(*second)
    return out.withColumn("primary_user", system_user(F.col("_pu"))).drop("_pu")


def mean_interval_seconds(n: Column, first: Column, last: Column) -> Column:
    """Mean gap between ``n`` events spanning [first, last], NULL if n <= 1."""
    span = F.timestamp_diff("SECOND", first, last).cast("double")
    return F.when(n > 1, span / (n - 1).cast("double")).cast("double")
