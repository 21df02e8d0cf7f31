"""Global running totals without a global window.

Rows are range-partitioned by their order, each partition's totals are summed
(one row per partition and group), and a row's running total is its
partition's offset plus the running total inside the partition. No task sees
more than one range, whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut

RANGE, TIE = "_range", "_tie"


def running(
    df: DataFrame,
    order: Sequence[Column],
    values: dict[str, Column] | None = None,
    group: Sequence[str] = (),
    index: str = "row_index",
) -> DataFrame:
    """``df`` with ``index`` (rows before it in its group) and, for each ``name: value``
    of ``values``, the sum of the values of the rows before it in its group.

    ``order`` orders the rows within a group; rows that tie in it keep an
    arbitrary but fixed order. Null groups and null order keys are values like
    any other (nulls first); an empty frame stays empty.
    """
    values = values or {}
    keyed = df.withColumns({f"_v_{k}": F.coalesce(v, F.lit(0)) for k, v in values.items()})
    keyed = keyed.withColumns({f"_o_{i}": c for i, c in enumerate(order)} | {TIE: F.monotonically_increasing_id()})
    keys = [*group, *(f"_o_{i}" for i in range(len(order))), TIE]
    parts = cut(keyed.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys]).withColumn(RANGE, F.spark_partition_id()))

    sums = {"_n": F.count(F.lit(1))} | {f"_s_{k}": F.sum(f"_v_{k}") for k in values}
    totals = parts.groupBy(RANGE, *group).agg(*[c.alias(k) for k, c in sums.items()])
    before = Window.partitionBy(*group).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col(RANGE).alias("_r"), *[F.col(g).alias(f"_g_{g}") for g in group],
        *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_b{k}") for k in sums],
    )
    on = F.col(RANGE) == F.col("_r")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))

    inside = Window.partitionBy(RANGE, *group).orderBy(*[F.col(k).asc_nulls_first() for k in keys[len(group):]])
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = {"_l_n": F.row_number().over(inside) - 1} | {
        f"_l_{k}": F.coalesce(F.sum(f"_v_{k}").over(earlier), F.lit(0)) for k in values
    }
    out = parts.withColumns(local).join(offsets, on)
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns],
        (F.col("_b_n") + F.col("_l_n")).cast("long").alias(index),
        *[(F.col(f"_b_s_{k}") + F.col(f"_l_{k}")).alias(k) for k in values],
    )
