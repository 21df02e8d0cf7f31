"""Incremental pattern rollup: what the query-log checks need of a closed day, kept small (ST1 with C1-C13).

Four tables below one folder, each partitioned by ``event_date`` and ``batch_id``, and the presence index beside them:

* ``numbers``: per (day, pattern, user, kind, type) the counts, sums and maxima of every population that a check ranks;
* ``texts``: per (day, pattern, user, kind, type) the smallest text of each population;
* ``values``: per (day, pattern, user, kind, type) how often each duration and memory value occurred, for exact quantiles;
* ``sketches``: per (day, pattern, user, kind, type) a mergeable sketch of durations and one of memory, for approximate ones.

All of it merges: sums of sums, maxima of maxima, sketches of sketches. ``put`` writes one batch of log rows into that batch's own
partitions, so a batch that is replayed replaces itself, and late rows of an old day simply add a batch to it.
Checks read the rollup for days before ``closed_before`` and the log for the open ones, which a run of several checks rolls up first.

Populations depend on some thresholds (how many parts are many, and so on). They are recorded beside the
tables; reading a rollup with other ones is refused.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AuditConfig
from ..functions import predicates as P
from ..functions.sketches import DEFAULT_K, sketch_of
from ..sources.logs import LogTables, conform
from . import files, presence

HASH, PERIOD = "normalized_query_hash", "_period"
#: (name, operation, column) of a measure.
Named = tuple[str, str, str]

BACKFILL_BATCH = -1
SPEC_FILE = "_rollup_spec.json"
TABLES = ("numbers", "texts", "values", "sketches")
ROLLED_KEYS = ("event_date", HASH, "user", "query_kind", "type")


#: Row conditions within a (kind, type), and the measures that checks take of such rows.
GROUPS: dict[str, tuple[Callable[[AuditConfig], Column] | None, tuple[tuple[str, str], ...]]] = {
    "every": (None, (("sum", "read_bytes"), ("sum", "query_duration_ms"), ("max", "query_duration_ms"), ("max", "memory_usage"))),
    "returning": (lambda cfg: F.col("result_rows") > 0, (("sum", "read_rows"), ("sum", "result_rows"), ("sum", "read_bytes"))),
    "select_star": (lambda cfg: P.select_star(), (("sum", "read_bytes"),)),
    "many_parts": (lambda cfg: F.col("selected_parts") > cfg.min_parts_threshold, (("sum", "selected_parts"), ("sum", "read_rows"), ("sum", "read_bytes"))),
    "unbounded": (lambda cfg: (F.col("result_rows") > cfg.max_result_rows) & ~P.has_limit(), (("sum", "result_rows"), ("max", "result_rows"), ("sum", "read_bytes"))),
    "not_insert_text": (lambda cfg: P.not_insert_text(), (("sum", "read_bytes"),)),
    "small_insert": (lambda cfg: F.col("written_rows") < cfg.min_batch_size, (("sum", "written_rows"),)),
}
#: The populations of the checks: a condition on kind and type, and a group of rows.
SUBSETS: dict[str, tuple[Callable[[], Column], str]] = {
    "selects": (lambda: P.finished() & P.kind_is("Select"), "every"),
    "not_inserts": (lambda: P.finished() & P.kind_is_not("Insert"), "every"),
    "finished_or_failed": (P.finished_or_failed, "every"),
    "returning": (lambda: P.finished() & P.kind_is("Select"), "returning"),
    "select_star": (lambda: P.finished() & P.kind_is("Select"), "select_star"),
    "many_parts": (lambda: P.finished() & P.kind_is("Select"), "many_parts"),
    "unbounded": (lambda: P.finished() & P.kind_is("Select"), "unbounded"),
    "not_insert_text": (P.finished, "not_insert_text"),
    "small_inserts": (lambda: P.finished() & P.kind_is("Insert"), "small_insert"),
}
#: Values whose distribution is kept, and the rows that have them there.
VALUES: dict[str, Callable[[], Column]] = {"query_duration_ms": lambda: P.kind_is_not("Insert"), "memory_usage": lambda: P.kind_is("Select")}


def in_subset(subset: str, cfg: AuditConfig) -> Column:
    keyed, group = SUBSETS[subset]
    rows, _ = GROUPS[group]
    return keyed() if rows is None else keyed() & rows(cfg)


def _population(rows: DataFrame, cfg: AuditConfig) -> DataFrame:
    """Initial queries but the audit's own, of any user; NULL names as the empty one, as the checks read them."""
    kept = rows.where((F.col("is_initial_query") == 1) & P.not_self_query(cfg.extra_self_patterns))
    return kept.withColumns({"selected_parts": P.selected_parts(), "user": F.coalesce("user", F.lit("")), "query_kind": F.coalesce("query_kind", F.lit(""))})


_OPS = {"sum": F.sum, "max": F.max, "min": F.min}


def _numbers() -> dict[str, Column]:
    """Aggregates of ``numbers``: one struct per group of ``GROUPS``, n and each measure as ``sum_read_bytes`` and so on."""
    out = {}
    for group, (_, measures) in GROUPS.items():
        own = F.col(f"_is_{group}")
        out[group] = F.struct(F.count_if(own).alias("n"), *[_OPS[op](F.when(own, F.col(c))).alias(f"{op}_{c}") for op, c in measures])
    return out


def _texts() -> dict[str, Column]:
    """Aggregates of ``texts``: a text per group."""
    return {group: F.min(F.when(F.col(f"_is_{group}"), F.col("query"))) for group in GROUPS}


def _sketches(k: int = DEFAULT_K) -> dict[str, Column]:
    """Aggregates of ``sketches``, per user too, so that excluded users can be left out when reading."""
    return {c: sketch_of(F.when(condition(), F.col(c)), k) for c, condition in VALUES.items()}


#: The aggregates of three of the tables; all of them are taken in one read of a batch.
AGGREGATES: dict[str, Callable[[], dict[str, Column]]] = {"numbers": _numbers, "texts": _texts, "sketches": _sketches}


def rolled(rows: DataFrame, cfg: AuditConfig, tables: Sequence[str]) -> DataFrame:
    """The aggregates of ``tables`` over log rows from one read: the keys, and a struct per table."""
    kept = _population(rows, cfg).withColumns({f"_is_{group}": condition(cfg) if condition else F.lit(True) for group, (condition, _) in GROUPS.items()})
    per = kept.groupBy(*ROLLED_KEYS).agg(*[a.alias(f"{name}_{c}") for name in tables for c, a in AGGREGATES[name]().items()])
    return per.select(*ROLLED_KEYS, *[F.struct(*[F.col(f"{name}_{c}").alias(c) for c in AGGREGATES[name]()]).alias(name) for name in tables])


def table_of(rows: DataFrame, name: str) -> DataFrame:
    """One of the tables of ``rolled`` rows. The sums of ``sketches`` are those that ``numbers`` has of every row."""
    sums = [F.col(f"numbers.every.{c}") for c in ("n", "sum_read_bytes", "max_query_duration_ms", "max_memory_usage")] if name == "sketches" else []
    return rows.select(*ROLLED_KEYS, f"{name}.*", *sums)


def values(rows: DataFrame, cfg: AuditConfig) -> DataFrame:
    """``values`` of log rows: (keys, what, x, n, read_bytes), one read for both kinds of value."""
    each = F.array(*[F.when(own(), F.struct(F.lit(c).alias("what"), F.col(c).cast("bigint").alias("x"))) for c, own in VALUES.items()])
    spread = _population(rows, cfg).select(*ROLLED_KEYS, "read_bytes", F.explode(each).alias("v")).where("v is not null")
    return spread.groupBy(*ROLLED_KEYS, F.col("v.what").alias("what"), F.col("v.x").alias("x")).agg(F.count(F.lit(1)).alias("n"), F.sum("read_bytes").alias("read_bytes"))


def spec(cfg: AuditConfig) -> dict:
    """The thresholds that the populations depend on."""
    return {"min_parts_threshold": cfg.min_parts_threshold, "max_result_rows": cfg.max_result_rows, "min_batch_size": cfg.min_batch_size, "self": sorted(cfg.extra_self_patterns)}


def _check_spec(spark: SparkSession, path: str, cfg: AuditConfig, write: bool) -> None:
    at = f"{path.rstrip('/')}/{SPEC_FILE}"
    if not files.exists(spark, at):
        if not write:
            raise ValueError(f"{path} is not a rollup: it has no {SPEC_FILE}")
        files.write_text(spark, at, json.dumps(spec(cfg)))
    elif (known := json.loads(files.read_text(spark, at))) != spec(cfg):
        raise ValueError(f"{path} was rolled up with {known}, not with {spec(cfg)}")


def put(df: DataFrame, batch_id: int, path: str, cfg: AuditConfig) -> None:
    """Roll up one batch of log rows into its own partitions of the tables below ``path``; a replay replaces them.

    The batch is read twice: for its values, and for all that is one row per key. Those rows, not the log's, are kept
    until the tables that are made from them are written.
    """
    spark = df.sparkSession
    _check_spec(spark, path, cfg, write=True)
    log = conform(df, "query_log")

    def write(name: str, rows: DataFrame) -> None:
        own = rows.withColumn("batch_id", F.lit(int(batch_id)).cast("bigint"))
        writer = own.hint("rebalance", F.col("event_date")).sortWithinPartitions("event_date", HASH).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy("event_date", "batch_id").parquet(f"{path.rstrip('/')}/{name}")

    per = rolled(log, cfg, tuple(AGGREGATES)).persist()
    try:
        for name in TABLES:
            write(name, values(log, cfg) if name == "values" else table_of(per, name))
        presence.put_bits(presence.bits_of(per), batch_id, f"{path.rstrip('/')}/presence")
    finally:
        per.unpersist()


@dataclass(frozen=True)
class Rollup:
    """Rolled-up days before ``closed_before`` (None: all days that a check may ask for); ``values`` and ``sketches`` may be absent."""

    numbers: DataFrame
    texts_table: DataFrame
    values: DataFrame | None = None
    sketches: DataFrame | None = None
    closed_before: dt.date | None = None

    def _days(self, frame: DataFrame, cfg: AuditConfig, days: int, subset: str) -> DataFrame:
        own = P.since_day(cfg, days) & SUBSETS[subset][0]()
        if self.closed_before is not None:
            own = own & (F.col("event_date") < F.lit(self.closed_before))
        allowed = P.user_allowed(cfg)
        return frame.where(own if allowed is None else own & allowed)

    def rows(self, cfg: AuditConfig, subset: str) -> DataFrame:
        """The rows of ``numbers`` of a population's kinds and types in the audited days."""
        return self._days(self.numbers, cfg, cfg.lookback_days, subset)

    def counts(self, cfg: AuditConfig, subset: str, measures: Sequence[Named], days: int, period: Column | None = None, user: str = "_user") -> DataFrame:
        """(pattern, [period], user, _m) as ``user_counts`` has them."""
        group = SUBSETS[subset][1]
        rows = self._days(self.numbers, cfg, days, subset).where(F.col(f"{group}.n") > 0)
        rows = rows if period is None else rows.withColumn(PERIOD, period)
        numbers_of = [F.sum(f"{group}.n"), *[_OPS[op](f"{group}.{op}_{c}").cast("bigint") for _, op, c in measures]]
        keys = [HASH, *([PERIOD] if period is not None else [])]
        return rows.groupBy(*keys, F.col("user").alias(user)).agg(F.array(*numbers_of).alias("_m"))

    def texts(self, cfg: AuditConfig, subset: str, days: int) -> DataFrame:
        """(pattern, query): the smallest texts of the days. Texts are kept per pattern and user, so excluded users are left out."""
        return self._days(self.texts_table, cfg, days, subset).select(HASH, F.col(SUBSETS[subset][1]).alias("query")).where("query is not null")

    def value_counts(self, cfg: AuditConfig, subset: str, value: str, measures: Sequence[Named], days: int, period: Column | None) -> DataFrame:
        """(pattern, [period], user, _x, _m) as the log's ``value_counts`` has them; a measure is the value's own, or summed read bytes."""
        rows = self._days(self.values, cfg, days, subset).where(F.col("what") == value)
        rows = rows if period is None else rows.withColumn(PERIOD, period)
        own = [F.col("x") if c == value else F.col(c) for _, _, c in measures]
        keys = [HASH, *([PERIOD] if period is not None else [])]
        return rows.select(*keys, "user", F.col("x").alias("_x"), F.array(F.col("n"), *own).alias("_m"))

    def sketches_of(self, cfg: AuditConfig, subset: str, value: str, measures: Sequence[Named], days: int, period: Column | None) -> DataFrame:
        """(pattern, [period], _sketch, _rows, measures) of the days."""
        rows = self._days(self.sketches, cfg, days, subset)
        rows = rows if period is None else rows.withColumn(PERIOD, period)
        keys = [HASH, *([PERIOD] if period is not None else [])]
        return rows.select(*keys, F.col(value).alias("_sketch"), F.col("n").alias("_rows"), *[F.col(f"{op}_{c}").alias(n) for n, op, c in measures])


def read_rollup(spark: SparkSession, path: str, cfg: AuditConfig, closed_before: dt.date | None = None) -> Rollup:
    """The rollup below ``path``. ``closed_before`` defaults to the audit's own day, which is still being written."""
    _check_spec(spark, path, cfg, write=False)
    tables = {name: spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in TABLES}
    return Rollup(tables["numbers"], tables["texts"], tables["values"], tables["sketches"], closed_before or cfg.today)


def rolled_tables(spark: SparkSession, tables: LogTables, path: str, cfg: AuditConfig, closed_before: dt.date | None = None) -> LogTables:
    """``tables`` with the rollup and presence index below ``path``, for the checks to read."""
    return tables.with_(rollup=read_rollup(spark, path, cfg, closed_before), presence=presence.read_presence(spark, f"{path.rstrip('/')}/presence"))


def rollup_of(query_log: DataFrame, cfg: AuditConfig, days: int, keep: Callable[[DataFrame], DataFrame]) -> Rollup:
    """A rollup of the last ``days`` days for one run: numbers and texts, from one read and kept by ``keep``; quantiles still come from the log."""
    per = keep(rolled(query_log.where(P.since_day(cfg, days)), cfg, ("numbers", "texts")))
    return Rollup(table_of(per, "numbers"), table_of(per, "texts"))


def with_open_days(closed: Rollup, query_log: DataFrame, cfg: AuditConfig, days: int, keep: Callable[[DataFrame], DataFrame]) -> Rollup:
    """``closed`` with the open ones of the last ``days`` days, rolled up for one run and kept by ``keep``: instead of once or more by
    each check, the log of these days is read twice, for the values and for the rest."""
    rows = query_log.where(P.since_day(cfg, days) & (F.col("event_date") >= F.lit(closed.closed_before)))
    own = ["numbers", "texts", *(["sketches"] if closed.sketches is not None and cfg.approx_quantiles else [])]
    per = keep(rolled(rows, cfg, own))
    # The checks of a run take quantiles from values or from sketches, never from both.
    fresh = {name: table_of(per, name) for name in own} | ({"values": keep(values(rows, cfg))} if closed.values is not None and not cfg.approx_quantiles else {})
    both = lambda name, old: old.where(F.col("event_date") < F.lit(closed.closed_before)).select(fresh[name].columns).unionByName(fresh[name])
    told = {name: both(name, old) if name in fresh else old for name, old in (("values", closed.values), ("sketches", closed.sketches))}
    return Rollup(both("numbers", closed.numbers), both("texts", closed.texts_table), **told)
