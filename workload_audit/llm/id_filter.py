"""A fixed-size filter of ids: which rows of a scan may be wanted, before anything of them is shuffled."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter (1 MB). More ids than bits only let more rows through; an exact join follows each use.
BITS = 1 << 23


def place(*ids: Column) -> Column:
    """An id's bit."""
    return F.pmod(F.xxhash64(*ids), F.lit(BITS))


def build(ids: DataFrame, column: str, hashed: bool = False) -> np.ndarray:
    """The filter as BITS / 64 words: bits of one word are joined by a grouped bit_or, so at most that many numbers reach the driver.

    ``hashed``: the ids are hashes already, and their remainders are their bits.
    """
    bit = F.pmod(F.col(column), F.lit(BITS)) if hashed else place(F.col(column))
    words = ids.select(F.shiftright(bit, 6).alias("word"), F.expr("1L").alias("one"), (bit % 64).cast("int").alias("k"))
    words = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, k)")).alias("bits")).toPandas()
    out = np.zeros(BITS // 64, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def holds(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether the filter may hold the ids at ``places``."""
    return (words[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1) == 1


def maybe(ids: DataFrame, *columns: Column) -> Column:
    """A condition on other rows: whether their place, told by ``columns``, is that of a row of ``ids`` (place). The filter is one array of
    BITS / 64 numbers, made by a grouped bit_or and read as a scalar subquery, so that rows stay in Spark."""
    spark = ids.sparkSession
    own = ids.select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    words = spark.range(BITS // 64).join(own, F.col("id") == F.col("word"), "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    dense = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"])).scalar()
    at = place(*columns)
    return F.get(dense, F.shiftright(at, 6)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))) != 0
