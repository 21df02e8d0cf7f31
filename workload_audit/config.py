"""Audit parameters and excluded users."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

# --- fixed values (must equal the source tool's for the same results) -----
# Built-in internal service users excluded from query-level analysis unless
# ``include_internal`` is set.
INTERNAL_USERS = (
    "observability-internal",
    "monitoring-internal",
    "operator-internal",
    "prometheus-internal",
    "management-internal",
    "backups-internal",
)
# Console users excluded together with the internal ones.
CONSOLE_USERS = ("sql-console",)
# Name shown for queries logged with an empty user.
SYSTEM_USER_LABEL = "<system>"
# --- end of fixed values ---------------------------------------------------

CATEGORIES = ("anomalies", "anti_patterns", "cluster_health", "cost_attribution", "top_n")


@dataclass(frozen=True)
class AuditConfig:
    """Thresholds and filters of one audit run.

    ``as_of`` replaces the wall clock: ``today`` is ``as_of.date()`` and
    ``now`` is ``as_of`` itself, so a run is reproducible.
    """

    as_of: dt.datetime = field(default_factory=lambda: dt.datetime.now().replace(microsecond=0))
    lookback_days: int = 7
    top_n: int = 10
    regression_threshold_pct: float = 50
    min_executions: int = 10
    scan_ratio_threshold: float = 1000
    max_result_rows: int = 100_000
    repeat_threshold: float = 100  # executions per hour
    min_batch_size: int = 1000
    min_parts_threshold: int = 20
    include_internal: bool = False
    exclude_users: tuple[str, ...] = ()
    only_categories: tuple[str, ...] | None = None
    # Exact quantiles by default; True switches to mergeable sketches of this
    # size (functions.sketches.rank_error tells what it means).
    approx_quantiles: bool = False
    approx_accuracy: int = 200
    # Match inserts to ``tables`` by the database written in the table name
    # instead of the session database.
    use_table_prefix: bool = False
    # Further LIKE patterns of the audit's own queries, e.g. the archive
    # table's name when auditing an archive.
    extra_self_patterns: tuple[str, ...] = ()

    @property
    def today(self) -> dt.date:
        return self.as_of.date()

    @property
    def now(self) -> dt.datetime:
        return self.as_of

    @property
    def excluded_users(self) -> tuple[str, ...]:
        extra = tuple(self.exclude_users or ())
        if self.include_internal:
            return extra
        return INTERNAL_USERS + CONSOLE_USERS + extra

    def with_(self, **changes) -> "AuditConfig":
        return replace(self, **changes)


# The anchor the fixture tables are generated around (FIXTURES.md).
FIXTURE_AS_OF = dt.datetime(2024, 1, 31, 0, 0, 0)


def fixture_config(**changes) -> AuditConfig:
    """Config used by the registered queries: fixture anchor, and a repeat
    threshold low enough that the repeated-pattern check has rows."""
    base = AuditConfig(as_of=FIXTURE_AS_OF, repeat_threshold=0.1)
    return base.with_(**changes) if changes else base
