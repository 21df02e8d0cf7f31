"""Row predicates shared by the checks.

Positive comparisons are left bare so Catalyst pushes them into the Parquet
scan; negated ones are made NULL-safe (a NULL string counts as ``''``, as in
the source system where log columns are never NULL).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import AuditConfig

# --- fixed values (patterns and literals of the source checks) -------------
SELF_QUERY_PATTERN = "%system.query_log%"
SELECT_STAR_REGEX = r"(?i)\bSELECT\s+\*\s+FROM\b"
LIMIT_REGEX = r"(?i)\bLIMIT\s+\d+"
INSERT_TEXT_PREFIX = "INSERT%"
INNER_TABLE_PATTERNS = (".inner.%", ".tmp.inner.%")
INNER_TABLE_REGEX = r"\.(inner|tmp\.inner)\."
FINISHED = "QueryFinish"
FAILED = "ExceptionWhileProcessing"
NEW_PART = "NewPart"
MERGE_PARTS = "MergeParts"
SYSTEM_DATABASE = "system"
SELECTED_PARTS_EVENT = "SelectedParts"
# --- end of fixed values ---------------------------------------------------


def _str(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(col, F.lit(""))


def days_before(cfg: AuditConfig, n: int) -> dt.date:
    return cfg.today - dt.timedelta(days=n)


def since_day(cfg: AuditConfig, n: int) -> Column:
    """``event_date >= today - n`` (P1): prunes ``event_date`` partitions."""
    return F.col("event_date") >= F.lit(days_before(cfg, n))


def day_range(cfg: AuditConfig, older: int, newer: int) -> Column:
    """``today - older <= event_date < today - newer``."""
    d = F.col("event_date")
    return (d >= F.lit(days_before(cfg, older))) & (d < F.lit(days_before(cfg, newer)))


def not_self_query(extra_patterns: tuple[str, ...] = ()) -> Column:
    """Skip the audit's own queries on the log (P6), plus any extra LIKE
    patterns (e.g. the name of an archive table being audited)."""
    cond = ~_str("query").like(SELF_QUERY_PATTERN)
    for pat in extra_patterns:
        cond = cond & ~_str("query").like(pat)
    return cond


def user_allowed(cfg: AuditConfig) -> Column | None:
    """``user NOT IN (excluded)`` (P7); None when nothing is excluded."""
    excluded = cfg.excluded_users
    if not excluded:
        return None
    return ~_str("user").isin(list(excluded))


def base_query_filter(cfg: AuditConfig, days: int | None = None) -> Column:
    """Base population B without the type filter: window, initial queries,
    no self queries, allowed users."""
    cond = since_day(cfg, cfg.lookback_days if days is None else days)
    cond = cond & (F.col("is_initial_query") == 1) & not_self_query(cfg.extra_self_patterns)
    allowed = user_allowed(cfg)
    return cond if allowed is None else cond & allowed


def finished() -> Column:
    return F.col("type") == FINISHED


def finished_or_failed() -> Column:
    return F.col("type").isin(FINISHED, FAILED)


def kind_is(kind: str) -> Column:
    return F.col("query_kind") == kind


def kind_is_not(kind: str) -> Column:
    return _str("query_kind") != kind


def select_star() -> Column:
    return F.col("query").rlike(SELECT_STAR_REGEX)


def has_limit() -> Column:
    return _str("query").rlike(LIMIT_REGEX)


def not_insert_text() -> Column:
    return ~_str("query").ilike(INSERT_TEXT_PREFIX)


def not_inner_table(col: str = "table") -> Column:
    c = _str(col)
    out = None
    for pat in INNER_TABLE_PATTERNS:
        out = ~c.like(pat) if out is None else out & ~c.like(pat)
    return out


def selected_parts() -> Column:
    """``ProfileEvents['SelectedParts']``, 0 when the key is absent."""
    return F.coalesce(F.col("ProfileEvents")[SELECTED_PARTS_EVENT], F.lit(0).cast("bigint"))
