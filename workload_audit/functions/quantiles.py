"""Exact grouped quantiles from one range exchange.

Spark's exact ``percentile`` keeps a value->count map per group and merges
it in one task; for a pattern holding a third of the log with ~unique
values (memory in bytes) that map is as large as the group. Here a wanted
rank is read from the one range of values that holds it:

1. ``value_counts``: rows per (group, value) - partial aggregation, the only
   read of the input;
2. these counts are range-partitioned by (group, value), and each partition
   is summed per group: its rows, its least and its greatest value;
3. a window over those sums - one row per partition and group - tells how
   many values lie before each range, so which range holds a wanted rank;
4. the counts of just these ranges are read again (from step 1's shuffle,
   which Spark reuses), run up in order, and the wanted values picked.

A range is a slice of a task's size, however large its group; a task of step
4 sees at most the few wanted ranges of a group. Ranges are told by
their values, not by partition numbers, so a recomputed partition or a second
sampling of the range bounds changes nothing.

Two rank rules are offered:

* ``("cont", p)`` - linear interpolation between ranks floor/ceil of
  ``p * (n - 1)``: ``lo + (hi - lo) * frac`` (same rule as SQL
  ``quantile_cont``);
* ``("exact", p)`` - the element at 0-based rank ``floor(p * n)`` (rank
  ``n - 1`` for p >= 1) of the sorted group.

``approx=True`` takes mergeable sketches instead (:mod:`.sketches`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import Measure, counted, measure_names, merged, same_keys
from .sketches import sketch_of, sketch_quantiles

Specs = Mapping[str, tuple[str, float]]


def value_counts(df: DataFrame, keys: Sequence[str], value: str | Column, measures: Sequence[Measure] = (), label: str | None = None) -> DataFrame:
    """Rows per (keys, value) and per ``label`` where one is given: (keys, [label], _x, _m), ``_m`` the row count and the measures.

    Rows without a value count in the measures, not in the ranks.
    """
    x = (F.col(value) if isinstance(value, str) else value).cast("bigint").alias("_x")
    inputs = [e.alias(f"_in_{n}") for n, _, e in measures]
    rows = df.select(*keys, *([label] if label else []), x, *inputs)
    return counted(rows, [*keys, *([label] if label else []), "_x"], [(n, op, F.col(f"_in_{n}")) for n, op, _ in measures])


def _ranks(specs: Specs) -> Column:
    """The wanted ranks of a group of ``_n`` values: (tag, rank, weight); ``weight`` is the interpolation weight of a ``#lo`` rank."""
    n, rows = F.col("_n"), []
    for name, (kind, p) in specs.items():
        if kind == "exact":
            r = F.least(F.floor(F.lit(float(p)) * n), n - 1) if p < 1 else n - 1
            rows.append((name, r, F.lit(0.0)))
        elif kind == "cont":
            pos = (n - 1).cast("double") * float(p)
            rows += [(name + "#lo", F.floor(pos), pos - F.floor(pos)), (name + "#hi", F.ceil(pos), F.lit(0.0))]
        else:
            raise ValueError(f"unknown quantile kind {kind!r}")
    return F.array(*[F.struct(F.lit(t).alias("tag"), r.cast("bigint").alias("r"), w.cast("double").alias("w")) for t, r, w in rows])


def quantiles_of(
    counts: DataFrame,
    keys: Sequence[str],
    specs: Specs,
    *,
    min_count: int = 1,
    measures: Sequence[Measure] = (),
    rows: str | None = None,
) -> DataFrame:
    """Quantiles of the groups of ``value_counts``: keys, one column per spec (double for ``cont``, bigint for ``exact``), the
    merged ``measures`` and, under the name ``rows``, the row count. Groups with fewer than ``min_count`` values, or none, are absent."""
    keys = list(keys)
    here = F.when(F.col("_x").isNull(), F.lit(0)).otherwise(F.col("_m")[0]).cast("bigint")
    ranged = counts.repartitionByRange(*keys, "_x").withColumn("_part", F.spark_partition_id())
    totals = ranged.groupBy(*keys, "_part").agg(
        F.sum(here).alias("_t"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.sum(F.col("_m")[0]).alias("_rows"), *merged(measures))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = {"_rows": F.sum("_rows").over(group)} | {n: _MERGE[op](n).over(group) for n, op, _ in measures}
    placed = totals.withColumns({"_before": F.coalesce(F.sum("_t").over(earlier), F.lit(0)), "_n": F.sum("_t").over(group)} | whole)
    placed = placed.where(F.col("_n") >= max(min_count, 1)).withColumn("_all", _ranks(specs))
    placed = placed.withColumn("_want", F.expr("filter(_all, a -> a.r >= _before AND a.r < _before + _t)")).where("size(_want) > 0")
    known = ["_rows", *measure_names(measures)]
    wanted = placed.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_lo", "_hi", "_before", "_want", *known)

    inside = F.coalesce((F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi")), F.lit(False))
    met = counts.join(wanted, same_keys(keys) & inside)
    met = met.select(*keys, "_x", "_lo", "_before", "_want", F.col("_m")[0].alias("_c"), *known).repartition(*keys)
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_lo").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hits = met.withColumn("_upto", F.col("_before") + upto).select(
        *keys, "_x", *known, F.inline(F.expr("filter(_want, a -> a.r >= _upto - _c AND a.r < _upto)")))
    tag, picked = F.col("tag"), []
    for name, (kind, _) in specs.items():
        if kind == "exact":
            picked.append(F.max(F.when(tag == name, F.col("_x"))).alias(name))
        else:
            picked += [F.max(F.when(tag == name + "#lo", F.col("_x"))).alias(name + "#lo"), F.max(F.when(tag == name + "#hi", F.col("_x"))).alias(name + "#hi"),
                       F.max(F.when(tag == name + "#lo", F.col("w"))).alias(name + "#frac")]
    wide = hits.groupBy(*keys).agg(*picked, *[F.max(k).alias(k) for k in known])
    out = [F.col(k) for k in keys]
    for name, (kind, _) in specs.items():
        lo, hi = F.col(f"`{name}#lo`").cast("double"), F.col(f"`{name}#hi`").cast("double")
        out.append(F.col(name) if kind == "exact" else (lo + (hi - lo) * F.col(f"`{name}#frac`")).alias(name))
    return wide.select(*out, *([F.col("_rows").alias(rows)] if rows else []), *measure_names(measures))


_MERGE = {"sum": F.sum, "max": F.max, "min": F.min, "count_if": F.sum}


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str | Column,
    specs: Specs,
    *,
    approx: bool = False,
    accuracy: int = 200,
    min_count: int = 1,
    measures: Sequence[Measure] = (),
    rows: str | None = None,
) -> DataFrame:
    """Quantiles of a 64-bit ``value`` per group, exact or from sketches, with ``measures`` and the row count of the same read.

    Groups with no non-NULL value, or with fewer than ``min_count`` of them, are absent. NULL keys are a group like any other.
    """
    keys = list(keys)
    if not approx:
        return quantiles_of(value_counts(df, keys, value, measures), keys, specs, min_count=min_count, measures=measures, rows=rows)
    x = (F.col(value) if isinstance(value, str) else value).cast("bigint").alias("_x")
    given = df.select(*keys, x, *[e.alias(f"_in_{n}") for n, _, e in measures])
    aggs = [_FIRST[op](F.col(f"_in_{n}")).alias(n) for n, op, _ in measures]
    per = given.groupBy(*keys).agg(sketch_of(F.col("_x"), accuracy).alias("_sketch"), F.count("_x").alias("_n"), F.count(F.lit(1)).alias("_rows"), *aggs)
    per = per.where(F.col("_n") >= max(min_count, 1))
    return per.select(*keys, *sketch_quantiles("_sketch", specs), *([F.col("_rows").alias(rows)] if rows else []), *measure_names(measures))


_FIRST = {"sum": F.sum, "max": F.max, "min": F.min, "count_if": F.count_if}
