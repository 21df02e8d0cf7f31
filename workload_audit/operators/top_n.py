"""Top-N query patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AuditConfig
from ..functions.columns import avg_sql, readable_size, trunc_long
from ..plans.registry import check
from ..sources.logs import LogTables
from .common import HASH, described, pattern_leaders, pattern_quantiles, pattern_texts, reaching, top


@check(
    "top_n", "by_memory",
    headline=("executions", "peak_memory", "p95_memory",),
    advice="Compare the peak with the p95 of the same pattern: far apart means rare outliers, close together means every run needs this much.",
)
def by_memory(tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """Patterns with the highest peak memory."""
    stats, counts = pattern_quantiles(tables, cfg, "selects", "memory_usage", {"p95": ("cont", 0.95)}, [("max_mem", "max", "memory_usage")])
    order = [F.desc("max_mem"), F.asc(HASH)]
    leaders = top(stats, order, cfg.top_n)
    return top(described(leaders, counts, pattern_texts(tables, cfg, "selects")), order, cfg.top_n).select(
        "primary_user",
        "executions",
        readable_size("max_mem").alias("peak_memory"),
        readable_size("p95").alias("p95_memory"),
        "query_text",
    )


@check(
    "top_n", "by_read_bytes",
    headline=("executions", "total_read", "avg_read",),
    advice="Divide the total by the runs: a high average points at the statement, a high count at its schedule.",
)
def by_read_bytes(tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """Patterns reading the most bytes in total."""
    found = pattern_leaders(tables, cfg, "selects", [("sum_read", "sum", "read_bytes")], [F.desc("sum_read")])
    return found.select(
        "primary_user",
        "executions",
        readable_size("sum_read").alias("total_read"),
        readable_size(avg_sql("sum_read", "executions")).alias("avg_read"),
        "query_text",
    )


@check(
    "top_n", "by_duration",
    headline=("executions", "p50_ms", "p95_ms", "max_ms",),
    advice="Set p50 beside p95: a wide gap is contention or skewed parameters, a narrow one is the statement itself.",
)
def by_duration(tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """Patterns with the highest p95 latency."""
    specs = {"p50": ("cont", 0.5), "p95": ("cont", 0.95)}
    # With a rollup the bounds cost next to nothing, so that only patterns that can be among the leaders are looked at.
    bounded = not cfg.approx_quantiles and tables.rollup is not None and tables.rollup.values is not None
    among = reaching(tables, cfg, "selects", "query_duration_ms", "p95", specs) if bounded else None
    stats, counts = pattern_quantiles(tables, cfg, "selects", "query_duration_ms", specs, [("max_ms", "max", "query_duration_ms")], among=among)
    stats = stats.select(HASH, "executions", trunc_long("p50").alias("p50_ms"), trunc_long("p95").alias("p95_ms"), "max_ms")
    order = [F.desc("p95_ms"), F.asc(HASH)]
    leaders = top(stats, order, cfg.top_n)
    return top(described(leaders, counts, pattern_texts(tables, cfg, "selects")), order, cfg.top_n).select(
        "primary_user", "executions", "p50_ms", "p95_ms", "max_ms", "query_text"
    )


@check(
    "top_n", "by_weighted_cost",
    headline=("executions", "avg_read", "weighted_cost",),
    advice="Ranked by runs times bytes per run, so either factor can be the one to lower; start with the larger.",
)
def by_weighted_cost(tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """Patterns by executions x average bytes read (INSERTs excluded)."""
    found = pattern_leaders(
        tables, cfg, "not_inserts", [("sum_read", "sum", "read_bytes")], [F.desc("_cost")],
        lambda stats: stats.withColumn("_avg", F.expr(avg_sql("sum_read", "executions"))).withColumn(
            "_cost", F.col("executions").cast("double") * F.col("_avg")),
    )
    return found.select(
        "primary_user",
        "executions",
        readable_size("_avg").alias("avg_read"),
        readable_size("_cost").alias("weighted_cost"),
        "query_text",
    )
