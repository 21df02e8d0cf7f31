"""Stand-alone queries for the building blocks the checks share, each run
over the whole input tables (not just one check's window), so every
primitive is exercised and verified on its own:

J2 anti join, P12/P15 insert targets, A5/A6 quantiles, A9 primary user, A8 mean interval, A12 part
dedup, W1/W2 share of total and bar scale, F1/F2/F3 formatters, T4 status
rank, R7 query summary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AuditConfig
from ..functions.aggregates import mean_interval_seconds, pattern_stats
from ..functions.columns import bar, readable_delta, readable_size, round_half_up
from ..functions.predicates import MERGE_PARTS, NEW_PART, day_range, finished, kind_is_not
from ..functions.quantiles import group_quantiles
from ..sources.logs import LogTables
from .cluster_health import PART_KEY, TABLE_KEY, insert_duration_by_engine, partition_status, status_rank, with_node_thresholds
from .common import HASH, query_rows

SHARE_BAR_WIDTH = 30


def op_anti_join(tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """Patterns run this period that never ran in the three periods
    before, with their executions this period."""
    n = cfg.lookback_days
    current = (
        query_rows(tables, cfg).where(finished() & kind_is_not("Insert")).groupBy(HASH).agg(F.count(F.lit(1)).alias("executions"))
    )
    baseline = query_rows(tables, cfg, 4 * n).where(day_range(cfg, 4 * n, n) & finished() & kind_is_not("Insert"))
    return current.join(baseline.select(HASH).distinct(), HASH, "left_anti")


def op_quantile_exact(tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """Exact-rank median and p90 of merge durations per table, whole log."""
    (part_log,) = tables.require("part_log")
    merges = part_log.where(F.col("event_type") == MERGE_PARTS)
    q = group_quantiles(
        merges, TABLE_KEY, "duration_ms", {"p50_ms": ("exact", 0.5), "p90_ms": ("exact", 0.9), "max_ms": ("exact", 1.0)}
    )
    counts = merges.groupBy(*TABLE_KEY).agg(F.count(F.lit(1)).alias("merges"))
    return counts.join(q, TABLE_KEY)


def op_quantile_cont(tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """A5: interpolated p50 / p95 / p99 of query latency per pattern, whole log."""
    (ql,) = tables.require("query_log")
    return group_quantiles(
        ql, [HASH], "query_duration_ms", {"p50": ("cont", 0.5), "p95": ("cont", 0.95), "p99": ("cont", 0.99)}
    )


def op_primary_user(tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """Most frequent user (ties -> smallest) and sample text per
    pattern, whole log."""
    (ql,) = tables.require("query_log")
    return pattern_stats(ql, [HASH]).select(HASH, "primary_user", "executions", "query_text")


def op_interval_mean(tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """Mean seconds between new parts per table (NULL for one part)."""
    (part_log,) = tables.require("part_log")
    per = (
        part_log.where(F.col("event_type") == NEW_PART)
        .groupBy(*TABLE_KEY)
        .agg(F.count(F.lit(1)).alias("parts"), F.min("event_time").alias("_a"), F.max("event_time").alias("_b"))
    )
    return per.select(
        *TABLE_KEY, "parts", mean_interval_seconds(F.col("parts"), F.col("_a"), F.col("_b")).alias("avg_interval_sec")
    )


def op_part_dedup(tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """One row per part key (first time, largest row count), summed per
    table."""
    (part_log,) = tables.require("part_log")
    dedup = (
        part_log.where(F.col("event_type") == NEW_PART)
        .groupBy(*PART_KEY)
        .agg(F.min("event_time").alias("event_time"), F.max("rows").alias("rows"), F.count(F.lit(1)).alias("copies"))
    )
    return dedup.groupBy(*TABLE_KEY).agg(
        F.count(F.lit(1)).alias("parts"),
        F.sum("copies").alias("logged"),
        F.sum("rows").alias("rows"),
        F.min("event_time").alias("first_part"),
    )


def op_share_of_total(tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """W1/W2 + F3: executions per query kind, share of all executions and a
    bar scaled to the largest kind. The windows run over the per-kind
    aggregate (a handful of rows)."""
    (ql,) = tables.require("query_log")
    per = ql.groupBy("query_kind").agg(F.count(F.lit(1)).alias("executions"))
    return per.select(
        "query_kind",
        "executions",
        round_half_up("100.0D * executions / nullif(CAST(sum(executions) OVER () AS DOUBLE), 0.0D)", 2).alias("pct"),
        bar("executions", "0", "max(executions) OVER ()", SHARE_BAR_WIDTH).alias("bar_chart"),
    )


def op_readable_size(tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """readable sizes of per-pattern byte totals, averages and peaks."""
    (ql,) = tables.require("query_log")
    per = ql.groupBy(HASH).agg(
        F.sum("read_bytes").alias("_s"), F.count(F.lit(1)).alias("_n"), F.max("memory_usage").alias("_m"),
        F.min("read_bytes").alias("_lo"),
    )
    return per.select(
        HASH,
        readable_size("_s").alias("total_read"),
        readable_size("_s / _n").alias("avg_read"),
        readable_size("_m").alias("peak_memory"),
        readable_size("_lo").alias("min_read"),
    )


def op_readable_delta(tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """readable longest merge and logged time span per table."""
    (part_log,) = tables.require("part_log")
    per = part_log.groupBy(*TABLE_KEY).agg(
        F.max("duration_ms").alias("_d"), F.min("event_time").alias("_a"), F.max("event_time").alias("_b")
    )
    return per.select(
        *TABLE_KEY,
        readable_delta("CAST(_d / 1000.0D AS BIGINT)").alias("longest_merge"),
        readable_delta("timestampdiff(SECOND, _a, _b)").alias("span"),
    )


def op_bar(tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """executions per user as a bar scaled to the busiest user. The
    number of users is not bounded, so the scale is a global aggregate used
    as a scalar subquery rather than an OVER () window that would gather
    every user into one task."""
    (ql,) = tables.require("query_log")
    per = ql.groupBy("user").agg(F.count(F.lit(1)).alias("executions"))
    top_count = per.agg(F.max("executions")).scalar()
    return per.withColumn("_mx", top_count).select(
        "user", "executions", bar("executions", "0", "_mx", 60).alias("bar_chart")
    )


def op_status_rank(tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """Status and report rank of every partition group (no limit)."""
    parts, merges = tables.require("parts", "merges")
    ps = parts.where(F.col("active")).groupBy("database", "table", "partition").agg(
        F.count(F.lit(1)).alias("active_parts"), F.sum("bytes_on_disk").alias("_b")
    )
    gb = "_b / 1024 / 1024 / 1024"
    ps = ps.select(
        "database",
        "table",
        "partition",
        round_half_up(gb, 2).alias("size_gb"),
        round_half_up("_b / active_parts / 1024 / 1024", 2).alias("avg_part_size_mb"),
        round_half_up(f"active_parts / nullif({gb}, 0.0D)", 0).alias("parts_per_gb"),
    )
    activity = merges.groupBy(*TABLE_KEY).agg(F.count(F.lit(1)).alias("_m"))
    j = with_node_thresholds(
        ps.join(activity, TABLE_KEY, "left").withColumn("active_merges", F.coalesce(F.col("_m"), F.lit(0).cast("bigint"))),
        tables,
    ).withColumn("partition_status", partition_status(cfg))
    return j.select(
        "database", "table", "partition", "partition_status", status_rank("partition_status").alias("status_rank")
    )


def op_insert_targets(tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """The insert histogram of a log in which some inserts name no table and some an inner one, which it leaves out."""
    (ql,) = tables.require("query_log")
    inner = F.array(F.concat("current_database", F.when(F.col("query_id") % 2 == 0, F.lit(".`.inner.t1`")).otherwise(F.lit(".`.tmp.inner.t1`"))))
    named = F.when(F.col("query_id") % 5 == 0, F.array().cast("array<string>")).when(F.col("query_id") % 7 == 0, inner).otherwise(F.col("tables"))
    return insert_duration_by_engine(tables.with_(query_log=ql.withColumn("tables", named)), cfg)


OPERATORS = {
    "op_insert_targets": op_insert_targets,
    "op_anti_join": op_anti_join,
    "op_quantile_exact": op_quantile_exact,
    "op_quantile_cont": op_quantile_cont,
    "op_primary_user": op_primary_user,
    "op_interval_mean": op_interval_mean,
    "op_part_dedup": op_part_dedup,
    "op_share_of_total": op_share_of_total,
    "op_readable_size": op_readable_size,
    "op_readable_delta": op_readable_delta,
    "op_bar": op_bar,
    "op_status_rank": op_status_rank,
}
