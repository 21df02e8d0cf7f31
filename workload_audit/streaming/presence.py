"""Presence index: on which days each pattern ran, as bitmaps.

A row per (pattern, user, block of 64 days) holds the days as the bits of one long. Batches add rows; reading merges them with a grouped
bit-or, so a replayed batch changes nothing. "Ran in the three periods before" is a mask test on at most a few
blocks, in place of a read of the log of those days.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AuditConfig
from ..functions.predicates import finished, kind_is_not, not_self_query, user_allowed
from ..sources.logs import conform

HASH = "normalized_query_hash"
BLOCK_DAYS = 64
EPOCH = dt.date(1970, 1, 1)


def day_bits(query_log: DataFrame, cfg: AuditConfig) -> DataFrame:
    """(pattern, user, block, days) of the finished queries that C6 looks at, of any user."""
    return bits_of(query_log.where((F.col("is_initial_query") == 1) & not_self_query(cfg.extra_self_patterns)))


def bits_of(rows: DataFrame) -> DataFrame:
    """``day_bits`` of rows of the audited population: those of the log, or one for each day, pattern, user, kind and type."""
    kept = rows.where(finished() & kind_is_not("Insert") & F.col("event_date").isNotNull())
    days = kept.select(HASH, F.coalesce("user", F.lit("")).alias("user"), F.unix_date("event_date").alias("_day"))
    bit = F.expr(f"shiftleft(1L, cast(pmod(_day, {BLOCK_DAYS}) as int))")
    return days.groupBy(HASH, "user", F.expr(f"cast(floor(_day / {BLOCK_DAYS}) as bigint)").alias("block")).agg(F.bit_or(bit).alias("days"))


def put(df: DataFrame, batch_id: int, path: str, cfg: AuditConfig) -> None:
    """The bits of one batch of log rows, in that batch's own partition."""
    put_bits(day_bits(conform(df, "query_log"), cfg), batch_id, path)


def put_bits(bits: DataFrame, batch_id: int, path: str) -> None:
    kept = bits.withColumn("batch_id", F.lit(int(batch_id)).cast("bigint"))
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def read_presence(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(HASH, "user", "block", "days")


def masks(first: dt.date, until: dt.date) -> dict[int, int]:
    """{block: bits} of the days from ``first`` to the one before ``until``."""
    out: dict[int, int] = {}
    for day in range((first - EPOCH).days, (until - EPOCH).days):
        out[day // BLOCK_DAYS] = out.get(day // BLOCK_DAYS, 0) | 1 << day % BLOCK_DAYS
    return out


def ran_between(presence: DataFrame, cfg: AuditConfig, first: dt.date, until: dt.date) -> DataFrame:
    """(pattern) of those that an audited user ran on a day of ``[first, until)``."""
    wanted = masks(first, until)
    if not wanted:
        return presence.select(HASH).limit(0)
    signed = {b: m - (1 << 64) if m >> 63 else m for b, m in wanted.items()}
    own = F.lit(False)
    for block, mask in signed.items():
        own = own | ((F.col("block") == block) & (F.col("days").bitwiseAND(F.lit(mask)) != 0))
    allowed = user_allowed(cfg)
    return presence.where(own if allowed is None else own & allowed).select(HASH).distinct()
