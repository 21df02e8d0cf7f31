"""Run a selection of checks over one set of inputs.

When two or more selected checks rank query patterns, the days of the run are
rolled up once (:mod:`workload_audit.streaming.rollup`): the counts, sums and
texts that the checks ask for, per day, pattern and user, written to the shared
folder and deleted at the end. A report over one log then reads it once
for these, instead of once per check; exact quantiles still read its values.

Every check runs under its own tag and, if asked, within a time budget: the
jobs of one that overruns are interrupted. What became of each - done, failed or
timed out - is a row of the outcome table; the others are not touched.
"""

from __future__ import annotations

import logging
import threading
import time
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..config import AuditConfig
from ..session import checkpoint_dir
from ..sources.logs import LogTables
from ..streaming import files
from ..streaming.rollup import rollup_of, with_open_days
from .registry import CheckSpec, select_checks

log = logging.getLogger(__name__)

DONE, FAILED, TIMED_OUT = "done", "failed", "timed out"
#: Seconds between two interruptions of a check that has overrun (it may start further jobs).
INTERRUPT_EVERY = 0.5


@dataclass(frozen=True)
class CheckResult:
    category: str
    name: str
    columns: tuple[str, ...]
    rows: list[tuple]


@dataclass(frozen=True)
class Outcome:
    category: str
    name: str
    state: str
    rows: int
    seconds: float
    error: str | None = None
    result: CheckResult | None = None


def base_days(cfg: AuditConfig) -> int:
    """Days of a run's rollup: two periods, the window of the week-over-week check and (with the current period) of every other
    query-log check. The new-pattern baseline reaches four periods back but only needs pattern hashes."""
    return 2 * cfg.lookback_days


def with_shared_days(tables: LogTables, cfg: AuditConfig, specs: list[CheckSpec], keep: Callable[[DataFrame], DataFrame]) -> LogTables:
    """``tables`` with the days of a run rolled up: all, or the open ones of a rollup. Kept by ``keep``, once for all of its checks."""
    if tables.query_log is None or sum(s.uses_patterns for s in specs) < 2:
        return tables
    if tables.rollup is None:
        return tables.with_(rollup=rollup_of(tables.query_log, cfg, base_days(cfg), keep))
    if tables.rollup.closed_before is None:
        return tables
    return tables.with_(rollup=with_open_days(tables.rollup, tables.query_log, cfg, base_days(cfg), keep))


def checkpointed(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def build_checks(tables: LogTables, cfg: AuditConfig, *, share_base: bool = True) -> dict[tuple[str, str], DataFrame]:
    """The selected checks as DataFrames keyed by (category, name). A check whose plan cannot be built (e.g. a missing input) is
    skipped. With ``share_base`` the days are rolled up first, by a job, into checkpoints; the checks themselves start none."""
    specs = select_checks(cfg.only_categories)
    if share_base:
        tables = with_shared_days(tables, cfg, specs, checkpointed)
    out: dict[tuple[str, str], DataFrame] = {}
    for spec in specs:
        try:
            out[(spec.category, spec.name)] = spec.fn(tables, cfg)
        except Exception as exc:  # noqa: BLE001 - fault isolation is the point
            log.warning("check %s could not be planned: %s: %s", spec.key, type(exc).__name__, exc)
    return out


class _Deadline:
    """Interrupts the jobs of a tag from a moment on, again and again until it is stopped."""

    def __init__(self, spark: SparkSession, tag: str, seconds: float | None):
        self.spark, self.tag, self.seconds, self.stopped = spark, tag, seconds, threading.Event()

    def _watch(self) -> None:
        wait = self.seconds
        while not self.stopped.wait(wait):
            self.spark.sparkContext.cancelJobsWithTag(self.tag)
            wait = INTERRUPT_EVERY

    def __enter__(self) -> _Deadline:
        self.spark.sparkContext.addJobTag(self.tag)
        if self.seconds is not None:
            threading.Thread(target=self._watch, daemon=True).start()
        return self

    def __exit__(self, *_) -> None:
        self.stopped.set()
        self.spark.sparkContext.removeJobTag(self.tag)


def collected(spec: CheckSpec, df: DataFrame) -> tuple[int, CheckResult]:
    """A check's rows on the driver: top-N lists and summaries per engine or user."""
    rows = [tuple(r) for r in df.collect()]
    return len(rows), CheckResult(spec.category, spec.name, tuple(df.columns), rows)


def written_to(path: str) -> Callable[[CheckSpec, DataFrame], tuple[int, None]]:
    """Each check's rows as Parquet below ``path``, written by the executors; nothing but their number reaches the driver."""

    def write(spec: CheckSpec, df: DataFrame) -> tuple[int, None]:
        at = f"{path.rstrip('/')}/{spec.key}"
        df.write.mode("overwrite").parquet(at)
        return df.sparkSession.read.parquet(at).count(), None

    return write


def run_outcomes(
    tables: LogTables,
    cfg: AuditConfig,
    *,
    share_base: bool = True,
    parallelism: int = 4,
    seconds: float | None = None,
    budgets: Mapping[str, float] | None = None,
    take: Callable[[CheckSpec, DataFrame], tuple[int, CheckResult | None]] = collected,
) -> list[Outcome]:
    """Run every selected check and tell what became of it, in (category, name) order.

    ``seconds`` is each check's time budget, ``budgets`` has others by key (``category/name``). A check that ends
    after its budget counts as timed out, whatever it found. Spark is lazy, so the action is part of what is watched. Up to ``parallelism``
    checks run as concurrent Spark jobs.
    """
    specs = select_checks(cfg.only_categories)
    if not specs:
        log.warning("no checks selected (categories: %s)", cfg.only_categories)
        return []
    folder = None

    def keep(df: DataFrame) -> DataFrame:
        nonlocal folder
        folder = folder or f"{checkpoint_dir(df.sparkSession).rstrip('/')}/run-{uuid.uuid4().hex}"
        at = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(at)
        return df.sparkSession.read.parquet(at)

    if share_base:
        tables = with_shared_days(tables, cfg, specs, keep)

    def run_one(spec: CheckSpec) -> Outcome:
        budget = (budgets or {}).get(spec.key, seconds)
        session = next(x for x in vars(tables).values() if isinstance(x, DataFrame)).sparkSession
        start, rows, result, error = time.monotonic(), 0, None, None
        with _Deadline(session, f"audit-{uuid.uuid4().hex}", budget):
            try:
                rows, result = take(spec, spec.fn(tables, cfg))
            except Exception as exc:  # noqa: BLE001 - fault isolation is the point
                error = f"{type(exc).__name__}: {exc}"
        took = time.monotonic() - start
        late = budget is not None and took > budget
        state = TIMED_OUT if late else FAILED if error else DONE
        if state != DONE:
            log.warning("check %s %s: %s", spec.key, state, error or f"{took:.1f} s")
        return Outcome(spec.category, spec.name, state, rows if state == DONE else 0, took, error, result if state == DONE else None)

    try:
        with ThreadPoolExecutor(max_workers=max(parallelism, 1), thread_name_prefix="audit-check") as pool:
            return list(pool.map(run_one, specs))
    finally:
        if folder:
            files.delete(tables.query_log.sparkSession, folder)


def outcome_table(spark: SparkSession, outcomes: list[Outcome]) -> DataFrame:
    """(category, name, state, rows, seconds, error) of a run, one row per check."""
    rows = [(o.category, o.name, o.state, o.rows, o.seconds, o.error) for o in outcomes]
    return spark.createDataFrame(rows, "category string, name string, state string, rows long, seconds double, error string")


def run_checks(tables: LogTables, cfg: AuditConfig, *, share_base: bool = True, parallelism: int = 4) -> list[CheckResult]:
    """The rows of every selected check that could be done; the others are logged and left out."""
    return [o.result for o in run_outcomes(tables, cfg, share_base=share_base, parallelism=parallelism) if o.result is not None]
