"""Week-over-week anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AuditConfig
from ..functions.aggregates import same_keys, totals
from ..functions.columns import avg_sql, readable_size, round_half_up, trunc_long
from ..functions.predicates import day_range, days_before, finished, kind_is_not
from ..plans.registry import Bullet, check
from ..sources.logs import LogTables
from ..streaming.presence import ran_between
from .common import HASH, PERIOD, described, pattern_counts, pattern_quantiles, pattern_texts, query_rows, top

CURRENT, PREVIOUS = "current", "previous"


@check(
    "anomalies", "wow_duration_regressions",
    headline=("prev_p95_ms", "curr_p95_ms", "duration_change_pct", "bytes_change_pct",),
    bullet=Bullet("p95 up by over {cfg.regression_threshold_pct} % on the period before: {rows} patterns", quiet="p95 steady against the period before"),
    advice="If bytes rose together with p95 the data grew; if only p95 rose, look at load and at what was deployed between the two periods.",
)
def wow_duration_regressions(tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """Patterns whose p95 latency grew beyond the threshold since last period.

    One read of the two periods gives p95, runs and bytes per (pattern, period); the two periods of a pattern are then put side
    by side by one aggregate over at most two rows each (J1 without a join).
    """
    n = cfg.lookback_days
    period = F.when(F.col("event_date") >= F.lit(days_before(cfg, n)), CURRENT).otherwise(PREVIOUS)
    stats, counts = pattern_quantiles(
        tables, cfg, "not_inserts", "query_duration_ms", {"p95": ("cont", 0.95)}, [("sum_read", "sum", "read_bytes")],
        period=period, min_count=cfg.min_executions, days=2 * n)
    stats = stats.select(HASH, PERIOD, trunc_long("p95").alias("p95_ms"), trunc_long(avg_sql("sum_read", "executions")).alias("avg_bytes"))
    side = lambda period, c, name: F.max(F.when(F.col(PERIOD) == period, F.col(c))).alias(name)
    both = stats.groupBy(HASH).agg(
        side(CURRENT, "p95_ms", "curr"), side(PREVIOUS, "p95_ms", "prev"), side(CURRENT, "avg_bytes", "curr_bytes"), side(PREVIOUS, "avg_bytes", "prev_bytes"))
    factor = 1 + cfg.regression_threshold_pct / 100.0
    grown = both.where(F.col("curr") > F.col("prev") * F.lit(factor))  # a period without enough runs is NULL and drops out

    def change(curr: str, prev: str):
        return round_half_up(f"try_divide({curr} - {prev}, {prev}) * 100", 2)

    grown = grown.withColumns({"duration_change_pct": change("curr", "prev"), "bytes_change_pct": change("curr_bytes", "prev_bytes")})
    # A zero previous p95 gives no ratio (NULL); it ranks first, like +inf.
    order = [F.desc_nulls_first("duration_change_pct"), F.asc(HASH)]
    leaders = top(grown, order, cfg.top_n)
    now = F.when(F.col(PERIOD) == CURRENT, F.col("_m")[0])
    found = described(leaders, counts, pattern_texts(tables, cfg, "not_inserts"), now)
    return top(found, order, cfg.top_n).select(
        "primary_user",
        F.col("prev").alias("prev_p95_ms"),
        F.col("curr").alias("curr_p95_ms"),
        "duration_change_pct",
        readable_size("prev_bytes").alias("prev_avg_read"),
        readable_size("curr_bytes").alias("curr_avg_read"),
        "bytes_change_pct",
        "query_text",
    )


# Expensive = average bytes read or average duration over these (fixed values).
NEW_PATTERN_MIN_AVG_READ_BYTES = 100_000_000
NEW_PATTERN_MIN_AVG_DURATION_MS = 10_000


@check(
    "anomalies", "new_expensive_patterns",
    headline=("executions", "avg_duration_ms", "avg_read",),
    bullet=Bullet("expensive and not seen in the three periods before: {rows} patterns"),
    advice="None of these hashes ran in the three periods before; find the release that brought them while it is recent.",
)
def new_expensive_patterns(tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """Expensive patterns of this period absent from the 3 periods before."""
    measures = [("sum_read", "sum", "read_bytes"), ("sum_dur", "sum", "query_duration_ms")]
    avg_read = avg_sql("sum_read", "executions")
    counts = pattern_counts(tables, cfg, "not_inserts", measures)
    stats = totals(counts, [HASH], measures).select(
        HASH,
        "executions",
        trunc_long(avg_sql("sum_dur", "executions")).alias("avg_duration_ms"),
        trunc_long(avg_read).alias("avg_read_bytes"),
        F.expr(avg_read).alias("_avg_read"),
    ).where(
        (F.col("avg_read_bytes") > NEW_PATTERN_MIN_AVG_READ_BYTES)
        | (F.col("avg_duration_ms") > NEW_PATTERN_MIN_AVG_DURATION_MS)
    )
    order = [F.desc("avg_read_bytes"), F.asc(HASH)]
    leaders = top(without_known(stats, tables, cfg), order, cfg.top_n)
    return top(described(leaders, counts, pattern_texts(tables, cfg, "not_inserts"), user="_user"), order, cfg.top_n).select(
        "primary_user",
        "executions",
        "avg_duration_ms",
        readable_size("_avg_read").alias("avg_read"),
        "query_text",
    )


def without_known(stats: DataFrame, tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """``stats`` without the patterns that ran in the three periods before.

    With a presence index a pattern's days are a bitmap there, and the test is a mask on it; otherwise the log of those
    days is reduced to distinct hashes, map-side, before the left anti join.
    """
    n = cfg.lookback_days
    if tables.presence is not None:
        known = ran_between(tables.presence, cfg, days_before(cfg, 4 * n), days_before(cfg, n))
    else:
        known = query_rows(tables, cfg, 4 * n).where(day_range(cfg, 4 * n, n) & finished() & kind_is_not("Insert")).select(HASH).distinct()
    known = known.select(F.col(HASH).alias("_k_" + HASH))
    return stats.join(known, same_keys([HASH]), "left_anti")
