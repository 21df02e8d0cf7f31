"""Cost per user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AuditConfig
from ..functions.aggregates import system_user
from ..functions.columns import readable_size, round_half_up
from ..functions.predicates import FAILED
from ..plans.registry import Bullet, check
from ..sources.logs import LogTables
from .common import subset_rows, with_closed_days


@check(
    "cost_attribution", "by_user",
    headline=("total_queries", "total_read", "total_hours", "error_rate_pct",),
    bullet=Bullet("{first.user} read the most in {cfg.lookback_days} days: {first.total_read}"),
    advice="Bytes and hours give each account's part of the load; a high error rate is load that returned nothing.",
)
def by_user(tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """Bytes read, hours and error rate per user, INSERTs included.

    The user filter applies to the logged name; the empty name is mapped to
    ``<system>`` before grouping, so it forms one row. Sums and counts are
    partially aggregated map-side, so a dominant user costs no more than any
    other.
    """
    per_user = account_counts(tables, cfg).groupBy(system_user(F.col("_user")).alias("user")).agg(
        F.sum("_n").alias("total_queries"),
        F.sum("_bytes").alias("_read"),
        F.sum("_duration").alias("_ms"),
        F.sum(F.when(F.col("type") == FAILED, F.col("_n")).otherwise(0)).alias("errors"),
    )
    return per_user.orderBy(F.desc("_read"), F.asc("user")).select(
        "user",
        "total_queries",
        readable_size("_read").alias("total_read"),
        round_half_up("_ms / 1000 / 3600", 2).alias("total_hours"),
        "errors",
        round_half_up("errors / total_queries * 100", 2).alias("error_rate_pct"),
    )


def account_counts(tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """(_user, type, _n, _bytes, _duration) of the audited queries, from the rollup for the days that it closes."""
    sums = lambda rows, n, read, ms: rows.groupBy(F.coalesce("user", F.lit("")).alias("_user"), "type").agg(n.alias("_n"), F.sum(read).alias("_bytes"), F.sum(ms).alias("_duration"))
    fresh = lambda since=None: sums(subset_rows(tables, cfg, "finished_or_failed", since=since), F.count(F.lit(1)), "read_bytes", "query_duration_ms")
    if tables.rollup is None:
        return fresh()
    closed = sums(tables.rollup.rows(cfg, "finished_or_failed"), F.sum("every.n"), "every.sum_read_bytes", "every.sum_query_duration_ms")
    return with_closed_days(closed, tables.rollup, fresh)
