"""Population and ordering helpers shared by the checks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AuditConfig
from ..functions.aggregates import counted, same_keys, totals, user_counts, with_primary_user, with_sample_text
from ..functions.predicates import base_query_filter, selected_parts
from ..functions.quantiles import Specs, quantiles_of, value_counts
from ..functions.sketches import merged_sketch, sketch_of, sketch_quantiles
from ..sources.logs import LogTables
from ..streaming.rollup import HASH, PERIOD, Named, Rollup, in_subset

# Query-log columns read by the base population (everything any check needs).
QUERY_COLUMNS = (
    "event_date",
    "type",
    "query_kind",
    "user",
    HASH,
    "query",
    "query_duration_ms",
    "read_rows",
    "read_bytes",
    "result_rows",
    "written_rows",
    "memory_usage",
)


def ts_lit(ts: dt.datetime) -> Column:
    """A TIMESTAMP_NTZ literal (no time-zone shift)."""
    return F.lit(ts.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def query_rows(tables: LogTables, cfg: AuditConfig, days: int | None = None) -> DataFrame:
    """Rows of the base population B over ``days`` days (default: the lookback), finished and failed ones; checks add their own
    type filter. The day predicate prunes partitions; the projection prunes columns."""
    (ql,) = tables.require("query_log")
    return ql.where(base_query_filter(cfg, cfg.lookback_days if days is None else days)).select(*QUERY_COLUMNS, selected_parts().alias("selected_parts"))


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """``ORDER BY ... LIMIT n`` (planned as TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def subset_rows(tables: LogTables, cfg: AuditConfig, subset: str, days: int | None = None, since: dt.date | None = None) -> DataFrame:
    """The log's rows of a population of ``SUBSETS``, from day ``since`` on."""
    rows = query_rows(tables, cfg, days).where(in_subset(subset, cfg))
    return rows if since is None else rows.where(F.col("event_date") >= F.lit(since))


def with_closed_days(closed: DataFrame, rollup: Rollup, fresh: Callable[[dt.date], DataFrame]) -> DataFrame:
    """What the rollup has of its closed days, and the open days' own."""
    return closed if rollup.closed_before is None else closed.unionByName(fresh(rollup.closed_before))


def pattern_counts(tables: LogTables, cfg: AuditConfig, subset: str, measures: Sequence[Named], days: int | None = None) -> DataFrame:
    """(pattern, _user, _m) of a population: from the rollup for closed days, else from the log. ``measures``: (name, operation, column)."""
    fresh = lambda since=None: user_counts(subset_rows(tables, cfg, subset, days, since), [HASH], [(n, op, F.col(c)) for n, op, c in measures])
    if tables.rollup is None:
        return fresh()
    return with_closed_days(tables.rollup.counts(cfg, subset, measures, cfg.lookback_days if days is None else days), tables.rollup, fresh)


def pattern_texts(tables: LogTables, cfg: AuditConfig, subset: str, days: int | None = None) -> DataFrame:
    """(pattern, query) of a population: every row of the log, or the smallest text of each rollup row."""
    fresh = lambda since=None: subset_rows(tables, cfg, subset, days, since).select(HASH, "query")
    if tables.rollup is None:
        return fresh()
    return with_closed_days(tables.rollup.texts(cfg, subset, cfg.lookback_days if days is None else days), tables.rollup, fresh)


def described(leaders: DataFrame, counts: DataFrame, texts: DataFrame, weight: Column | None = None, user: str = "user") -> DataFrame:
    """The leaders with their primary user, from the counts, and their sample text, from a read that only lets their rows through."""
    return with_sample_text(with_primary_user(leaders, counts, [HASH], user, weight), texts, [HASH])


def pattern_leaders(
    tables: LogTables,
    cfg: AuditConfig,
    subset: str,
    measures: Sequence[Named],
    order: Sequence[Column],
    derive: Callable[[DataFrame], DataFrame] = lambda stats: stats,
) -> DataFrame:
    """The ``top_n`` patterns of a population by ``order``, then hash, with their measures, primary user and sample text.

    ``derive`` adds columns to the patterns' totals and filters them. Patterns are ranked on numbers alone; users come from the same
    counts and texts from a second read that only lets the leaders' rows through.
    """
    counts = pattern_counts(tables, cfg, subset, measures)
    keyed = [*order, F.asc(HASH)]
    leaders = top(derive(totals(counts, [HASH], [(n, op, None) for n, op, _ in measures])), keyed, cfg.top_n)
    return top(described(leaders, counts, pattern_texts(tables, cfg, subset), user="_user"), keyed, cfg.top_n)


def pattern_quantiles(
    tables: LogTables,
    cfg: AuditConfig,
    subset: str,
    value: str,
    specs: Specs,
    measures: Sequence[Named],
    *,
    period: Column | None = None,
    min_count: int = 1,
    days: int | None = None,
    among: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(patterns with quantiles, measures and ``executions``; the counts that tell their primary users), from one read.

    With ``period`` (an expression on ``event_date``) the groups are (pattern, period). With ``among`` only its patterns are looked at.
    """
    keys = [HASH, *([PERIOD] if period is not None else [])]
    days = cfg.lookback_days if days is None else days
    given = [(n, op, F.col(c)) for n, op, c in measures]
    rollup = tables.rollup if tables.rollup is not None and tables.rollup.values is not None else None

    def rows(since=None):
        own = subset_rows(tables, cfg, subset, days, since)
        return own if period is None else own.withColumn(PERIOD, period)

    if not cfg.approx_quantiles:
        fresh = lambda since=None: value_counts(rows(since), keys, value, given, label="user")
        counts = fresh() if rollup is None else with_closed_days(rollup.value_counts(cfg, subset, value, measures, days, period), rollup, fresh)
        if among is not None:
            counts = counts.join(among.select(F.col(HASH).alias(f"_k_{HASH}")), same_keys([HASH]), "left_semi")
        return quantiles_of(counts, keys, specs, min_count=min_count, measures=given, rows="executions"), counts
    k, numbers = cfg.approx_accuracy, [_OPS[op](c).alias(n) for n, op, c in measures]
    sketched = lambda since=None: rows(since).groupBy(*keys).agg(sketch_of(F.col(value), k).alias("_sketch"), F.count(F.lit(1)).alias("_rows"), *numbers)
    uses = lambda since=None: counted(rows(since), [*keys, "user"])
    if rollup is None:
        parts, counts = sketched(), uses()
    else:
        parts = with_closed_days(rollup.sketches_of(cfg, subset, value, measures, days, period), rollup, sketched)
        counts = with_closed_days(rollup.counts(cfg, subset, [], days, period, user="user"), rollup, uses)
    merges = [_OPS[op](n).alias(n) for n, op, _ in measures]
    per = parts.groupBy(*keys).agg(merged_sketch(F.col("_sketch"), k).alias("_sketch"), F.sum("_rows").alias("executions"), *merges)
    stats = per.where(F.coalesce(F.kll_sketch_get_n_bigint("_sketch"), F.lit(0)) >= max(min_count, 1))
    return stats.select(*keys, *sketch_quantiles("_sketch", specs), "executions", *[n for n, _, _ in measures]), counts


#: Patterns whose quantile is computed first, as a multiple of the wanted number.
FIRST_TRIES = 4


def reaching(tables: LogTables, cfg: AuditConfig, subset: str, value: str, quantile: str, specs: Specs) -> DataFrame:
    """Patterns that can be among the ``top_n`` by a quantile of ``value``: (pattern, executions, _bound).

    A pattern's greatest value bounds its quantiles from above, and is known without its distribution. In a first round the quantile of the
    patterns with the greatest bounds is computed; the ``top_n``-th best of these is a bar, and a pattern whose bound
    does not reach it can't be among the ``top_n``. With fewer patterns than that there is no bar.
    """
    bounds = totals(pattern_counts(tables, cfg, subset, [("_bound", "max", value)]), [HASH], [("_bound", "max", None)])
    first = top(bounds, [F.desc("_bound"), F.asc(HASH)], FIRST_TRIES * cfg.top_n)
    tried, _ = pattern_quantiles(tables, cfg, subset, value, {quantile: specs[quantile]}, [], among=first)
    best = top(tried.select(F.floor(quantile).alias("q")), [F.desc("q")], cfg.top_n)
    bar = best.agg(F.when(F.count(F.lit(1)) >= cfg.top_n, F.min("q"))).scalar()
    return bounds.where(F.coalesce(F.col("_bound") >= bar, F.lit(True)))


_OPS = {"sum": F.sum, "max": F.max, "min": F.min}
