"""Query anti-patterns (C8-C13). All rank patterns on sums and counts, with an
optional filter on those, and look up users and texts of the leaders only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AuditConfig
from ..functions.columns import avg_sql, readable_size, round_half_up, trunc_long
from ..plans.registry import Bullet, check
from ..sources.logs import LogTables
from .common import pattern_leaders


def _avg(total: str) -> str:
    return avg_sql(total, "executions")


@check(
    "anti_patterns", "full_scans",
    headline=("executions", "avg_read_rows", "avg_result_rows", "scan_ratio",),
    bullet=Bullet("over {cfg.scan_ratio_threshold} rows read for each one returned: {rows} patterns"),
    advice="The ratio says how many rows are read for one returned; the highest ratios gain most from a narrower filter.",
)
def full_scans(tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """Patterns reading far more rows than they return."""
    found = pattern_leaders(
        tables,
        cfg,
        "returning",
        [
            ("s_rr", "sum", "read_rows"),
            ("s_res", "sum", "result_rows"),
            ("s_rb", "sum", "read_bytes"),
        ],
        [F.expr(f"CAST(executions AS DOUBLE) * {_avg('s_rr')}").desc()],
        lambda stats: stats.withColumn("scan_ratio", round_half_up(f"{_avg('s_rr')} / {_avg('s_res')}", 2)).where(
            F.col("scan_ratio") > float(cfg.scan_ratio_threshold)),
    )
    return found.select(
        "primary_user",
        "executions",
        trunc_long(_avg("s_rr")).alias("avg_read_rows"),
        trunc_long(_avg("s_res")).alias("avg_result_rows"),
        "scan_ratio",
        readable_size(_avg("s_rb")).alias("avg_read"),
        "query_text",
    )


@check(
    "anti_patterns", "select_star_wide_tables",
    headline=("executions", "avg_read",),
    bullet=Bullet("SELECT * without a column list: {rows} patterns"),
    advice="Multiply average read by runs to see what an explicit column list could save at most.",
)
def select_star_wide_tables(tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """Patterns using ``SELECT *``."""
    found = pattern_leaders(tables, cfg, "select_star", [("s_rb", "sum", "read_bytes")], [F.desc("executions")])
    return found.select(
        "primary_user", "executions", readable_size(_avg("s_rb")).alias("avg_read"), "query_text"
    )


@check(
    "anti_patterns", "missing_partition_filter",
    headline=("executions", "avg_selected_parts", "avg_read",),
    bullet=Bullet("over {cfg.min_parts_threshold} parts read by a run: {rows} patterns"),
    advice="Parts selected per run should follow the time span asked for; these exceed the limit set for the audit.",
)
def missing_partition_filter(tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """Patterns selecting more parts than ``min_parts_threshold``."""
    found = pattern_leaders(
        tables,
        cfg,
        "many_parts",
        [
            ("s_sp", "sum", "selected_parts"),
            ("s_rr", "sum", "read_rows"),
            ("s_rb", "sum", "read_bytes"),
        ],
        [(F.col("avg_selected_parts") * F.col("executions")).desc()],
        lambda stats: stats.withColumn("avg_selected_parts", trunc_long(_avg("s_sp"))),
    )
    return found.select(
        "primary_user",
        "executions",
        "avg_selected_parts",
        trunc_long(_avg("s_rr")).alias("avg_read_rows"),
        readable_size(_avg("s_rb")).alias("avg_read"),
        "query_text",
    )


@check(
    "anti_patterns", "unbounded_results",
    headline=("executions", "avg_result_rows",),
    bullet=Bullet("over {cfg.max_result_rows} rows returned without a limit: {rows} patterns"),
    advice="Ask the reader of these results how many rows are looked at; the rest is transfer and memory for nothing.",
)
def unbounded_results(tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """Patterns returning more than ``max_result_rows`` rows without LIMIT."""
    found = pattern_leaders(
        tables,
        cfg,
        "unbounded",
        [
            ("s_res", "sum", "result_rows"),
            ("max_result_rows", "max", "result_rows"),
            ("s_rb", "sum", "read_bytes"),
        ],
        [F.desc("avg_result_rows")],
        lambda stats: stats.withColumn("avg_result_rows", trunc_long(_avg("s_res"))),
    )
    return found.select(
        "primary_user",
        "executions",
        "avg_result_rows",
        "max_result_rows",
        readable_size(_avg("s_rb")).alias("avg_read"),
        "query_text",
    )


@check(
    "anti_patterns", "repeated_identical",
    headline=("total_executions", "avg_per_hour", "avg_read",),
    bullet=Bullet("over {cfg.repeat_threshold} runs an hour: {rows} patterns"),
    advice="Runs per hour times bytes per run is what one shared result would save; writes are left out of the count.",
)
def repeated_identical(tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """Patterns running more than ``repeat_threshold`` times per hour.

    The rate divides by ``lookback_days * 24`` hours although the window
    also holds today's partial day, as the source check does."""
    found = pattern_leaders(
        tables, cfg, "not_insert_text", [("s_rb", "sum", "read_bytes")], [F.desc("executions")],
        lambda stats: stats.withColumn("avg_per_hour", round_half_up(f"executions / {cfg.lookback_days} / 24", 2)).where(
            F.col("avg_per_hour") > float(cfg.repeat_threshold)),
    )
    return found.select(
        "primary_user",
        F.col("executions").alias("total_executions"),
        "avg_per_hour",
        readable_size(_avg("s_rb")).alias("avg_read"),
        "query_text",
    )


@check(
    "anti_patterns", "small_insert_batches",
    headline=("executions", "avg_written_rows",),
    bullet=Bullet("under {cfg.min_batch_size} rows written by an insert: {rows} patterns"),
    advice="Collect rows on the client until a statement carries at least the audit's minimum.",
)
def small_insert_batches(tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """INSERT patterns writing fewer than ``min_batch_size`` rows per run."""
    found = pattern_leaders(tables, cfg, "small_inserts", [("total_written_rows", "sum", "written_rows")], [F.desc("executions")])
    return found.select(
        "primary_user",
        "executions",
        trunc_long(_avg("total_written_rows")).alias("avg_written_rows"),
        "total_written_rows",
        "query_text",
    )
