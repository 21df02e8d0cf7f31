"""Registered report and archive queries: each builds the checks over the
given tables and derives a report table (R1-R9), or runs the archive jobs
(ST1-ST4) over the given query log."""

from __future__ import annotations

import datetime as dt
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AuditConfig
from ..session import checkpoint_dir
from ..streaming import archive as A
from ..sources.logs import LogTables, conform, read_log_tables
from ..streaming import compaction, presence, rollup
from . import report as R
from . import sinks
from .registry import select_checks
from .runner import build_checks, checkpointed, outcome_table, run_outcomes, with_shared_days


def _checks(tables: LogTables, cfg: AuditConfig):
    """All checks, run once over one rollup of the log; the report tables are made from their rows. What is kept in
    the shared folder are rolled-up counts and texts and the checks' results, no rows of the log."""
    return R.settled(build_checks(tables, cfg))


def report_findings(spark: SparkSession, tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """R1, value by value."""
    return R.values(_checks(tables, cfg))


def report_counts(spark: SparkSession, tables: LogTables, cfg: AuditConfig) -> DataFrame:
    checks = _checks(tables, cfg)
    return R.result_counts(spark, checks, R.findings(checks))


def report_severity(spark: SparkSession, tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """The severity of every class value."""
    return R.severity(R.values(_checks(tables, cfg)))


def report_preview(spark: SparkSession, tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """R4, value by value: the first rows of each check and how many more there are."""
    told = R.values(_checks(tables, cfg))
    more = told.groupBy("category", "name").agg(F.greatest(F.max("rank") - R.PREVIEW_ROWS, F.lit(0)).cast("bigint").alias("more"))
    return told.where(F.col("rank") <= R.PREVIEW_ROWS).join(more, ["category", "name"])


def report_health_score(spark: SparkSession, tables: LogTables, cfg: AuditConfig) -> DataFrame:
    checks = _checks(tables, cfg)
    return R.health_score(R.check_stats(spark, checks, R.values(checks)))


def report_key_findings(spark: SparkSession, tables: LogTables, cfg: AuditConfig) -> DataFrame:
    return R.key_findings(_checks(tables, cfg), cfg)


def report_query_summary(spark: SparkSession, tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """R7 over the whole log: the summary of each pattern's sample text."""
    (ql,) = tables.require("query_log")
    per = ql.groupBy("normalized_query_hash").agg(F.min("query").alias("query_text"))
    return per.select("normalized_query_hash", R.query_summary(F.col("query_text")).alias("summary"))


def report_metric_lines(spark: SparkSession, tables: LogTables, cfg: AuditConfig) -> DataFrame:
    return R.metric_lines(_checks(tables, cfg))


def report_recommendations(spark: SparkSession, tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """R9, with the related checks as one comma-separated text column."""
    checks = _checks(tables, cfg)
    rec = R.recommendations(spark, R.result_counts(spark, checks, R.findings(checks)))
    return rec.withColumn("related", F.array_join("related", ", "))


def sink_json(spark: SparkSession, tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """S6 round trip: the findings written as JSON lines by the executors,
    read back with the checks' types and compared value by value."""
    checks = _checks(tables, cfg)
    path = os.path.join(checkpoint_dir(spark), f"sink-json-{uuid.uuid4().hex}")
    sinks.write_json(checks, path, cfg)
    return R.values(sinks.read_json(checks, spark, path))


def sink_csv(spark: SparkSession, tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """S7 round trip: one CSV dataset (with header) per check, read back with
    its types and compared value by value."""
    checks = _checks(tables, cfg)
    paths = sinks.write_csv(checks, os.path.join(checkpoint_dir(spark), f"sink-csv-{uuid.uuid4().hex}"))
    back = {}
    for (category, name), df in checks.items():
        kinds = ", ".join(["rank int", *(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(R.own_columns(df)).schema.fields)])
        back[(category, name)] = (
            spark.read.option("header", True).option("nullValue", sinks.CSV_NULL).option("emptyValue", "").schema(kinds).csv(paths[f"{category}/{name}"])
        )
    return R.values(back)


REPORT_QUERIES = {
    "report_findings": report_findings,
    "report_counts": report_counts,
    "report_severity": report_severity,
    "report_preview": report_preview,
    "report_health_score": report_health_score,
    "report_key_findings": report_key_findings,
    "report_query_summary": report_query_summary,
    "report_metric_lines": report_metric_lines,
    "report_recommendations": report_recommendations,
    "sink_json": sink_json,
    "sink_csv": sink_csv,
}


# --- archive ------------------------------------------------------------------

# The registered archive runs use a cutoff inside the fixture log's span so
# both the backfill and the stream carry rows, and a retention short enough
# to remove some of its 30 days.
ARCHIVE_CUTOFF = dt.datetime(2024, 1, 20, 0, 0, 0)
ARCHIVE_RETENTION_DAYS = 14


def _work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def archive_summary(df: DataFrame) -> DataFrame:
    """Per day: rows, summed ids and hashes, first and last event."""
    return df.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("query_id").alias("sum_query_id"),
        F.sum("normalized_query_hash").alias("sum_hash"),
        F.min("event_time").alias("first_event"),
        F.max("event_time").alias("last_event"),
    )


def build_archive(spark: SparkSession, query_log: DataFrame, *, stream: bool = True) -> str:
    """Backfill before ARCHIVE_CUTOFF, then (optionally) stream the log's
    files from a landing folder; returns the archive path."""
    root = _work_dir(spark, "archive")
    landing, archive, ckpt = (os.path.join(root, p) for p in ("landing", "data", "checkpoint"))
    A.backfill(spark, query_log, archive, ARCHIVE_CUTOFF)
    if stream:
        # The landing folder receives the log as its own tasks write it.
        query_log.write.parquet(landing)
        q = A.start_stream(spark, landing, archive, ckpt)
        q.awaitTermination()
    return archive


def archive_backfill(spark: SparkSession, tables: LogTables, cfg: AuditConfig) -> DataFrame:
    (ql,) = tables.require("query_log")
    return archive_summary(A.read_archive(spark, build_archive(spark, ql, stream=False)))


def archive_stream(spark: SparkSession, tables: LogTables, cfg: AuditConfig) -> DataFrame:
    (ql,) = tables.require("query_log")
    return archive_summary(A.read_archive(spark, build_archive(spark, ql)))


def archive_retention(spark: SparkSession, tables: LogTables, cfg: AuditConfig) -> DataFrame:
    (ql,) = tables.require("query_log")
    path = build_archive(spark, ql)
    A.apply_retention(spark, path, cfg.today, ARCHIVE_RETENTION_DAYS)
    return archive_summary(A.read_archive(spark, path, cfg.today, ARCHIVE_RETENTION_DAYS))


def archive_rerun(spark: SparkSession, tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """ST5: backfill and stream a second time, which adds nothing."""
    (ql,) = tables.require("query_log")
    path = build_archive(spark, ql)
    root = os.path.dirname(path)
    if A.backfill(spark, ql, path, ARCHIVE_CUTOFF):
        raise RuntimeError("the archive was filled twice")
    A.start_stream(spark, os.path.join(root, "landing"), path, os.path.join(root, "checkpoint")).awaitTermination()
    return archive_summary(A.read_archive(spark, path))


def archive_compact(spark: SparkSession, tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """ST3: the closed days of the archive folded, up to the stream's last committed batch."""
    (ql,) = tables.require("query_log")
    path = build_archive(spark, ql)
    upto = compaction.committed_batch(spark, os.path.join(os.path.dirname(path), "checkpoint"))
    closed = [cfg.today - dt.timedelta(days=d) for d in range(3, 40)]
    compaction.compact(spark, path, closed, upto)
    return archive_summary(A.read_archive(spark, path))


def _pattern_checks(tables: LogTables, cfg: AuditConfig, also: tuple[str, ...] = ()) -> DataFrame:
    """The checks that rank patterns (and those named), value by value."""
    specs = [s for s in select_checks() if s.uses_patterns or s.name in also]
    tables = with_shared_days(tables, cfg, specs, checkpointed)
    return R.values(R.settled({(s.category, s.name): s.fn(tables, cfg) for s in specs}))


def archive_checks(spark: SparkSession, tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """The query-log checks over the archive, half of its days compacted."""
    ql, _ = tables.require("query_log", "tables")
    path = build_archive(spark, ql)
    upto = compaction.committed_batch(spark, os.path.join(os.path.dirname(path), "checkpoint"))
    compaction.compact(spark, path, [cfg.today - dt.timedelta(days=d) for d in range(4, 40)], upto)
    kept = conform(A.read_archive(spark, path, cfg.today), "query_log")
    return _pattern_checks(tables.with_(query_log=kept), cfg, ("insert_duration_by_engine",))


#: Days from this one on are open in ``rollup_checks``: their rows are read from the log.
ROLLUP_OPEN_FROM = dt.date(2024, 1, 28)


def rollup_checks(spark: SparkSession, tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """The query-log checks over a rollup of the closed days and the log of the open ones; the second batch is put twice."""
    (ql,) = tables.require("query_log")
    path = _work_dir(spark, "rollup")
    early = F.col("event_time") < F.lit(ARCHIVE_CUTOFF.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    rollup.put(ql.where(early), rollup.BACKFILL_BATCH, path, cfg)
    for _ in range(2):
        rollup.put(ql.where(~early), 0, path, cfg)
    return _pattern_checks(rollup.rolled_tables(spark, tables, path, cfg, ROLLUP_OPEN_FROM), cfg)


def presence_new_patterns(spark: SparkSession, tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """C6 from the presence index and the log of the current period alone."""
    from ..operators.anomalies import new_expensive_patterns

    (ql,) = tables.require("query_log")
    path = _work_dir(spark, "presence")
    presence.put(ql, 0, path, cfg)
    current = ql.where(F.col("event_date") >= F.lit(cfg.today - dt.timedelta(days=cfg.lookback_days)))
    return new_expensive_patterns(tables.with_(query_log=current, presence=presence.read_presence(spark, path)), cfg)


def reader_checks(spark: SparkSession, tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """All checks through the readers, over tables written as they are kept: the log by date, its older days in narrower
    types and without a column that came later."""
    ql, *others = tables.require("query_log", "part_log", "parts", "merges", "tables", "asynchronous_metrics", "settings")
    root = _work_dir(spark, "tables")
    paths = {n: os.path.join(root, n) for n in ("query_log", "part_log", "parts", "merges", "tables", "asynchronous_metrics", "settings")}
    old = F.col("event_date") < F.lit(ARCHIVE_CUTOFF.date())
    before = ql.where(old).drop("current_database").withColumn("normalized_query_hash", F.col("normalized_query_hash").cast("int"))
    before.write.partitionBy("event_date").parquet(paths["query_log"])
    ql.where(~old).write.mode("append").partitionBy("event_date").parquet(paths["query_log"])
    for name, df in zip(list(paths)[1:], others, strict=True):
        df.write.parquet(paths[name])
    return R.values(_checks(read_log_tables(spark, paths), cfg))


def selected_checks(spark: SparkSession, tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """The checks of two categories, value by value; the others are not planned."""
    return R.values(_checks(tables, cfg.with_(only_categories=SELECTED)))


#: The categories of ``selected_checks``.
SELECTED = ("anti_patterns", "cost_attribution")
#: The check that ``run_outcomes`` gives too little time, in seconds.
HURRIED, NO_TIME = "top_n/by_memory", 0.001


def run_outcomes_table(spark: SparkSession, tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """What becomes of each check where the part log is missing and one check gets no time."""
    done = run_outcomes(tables.with_(part_log=None), cfg, budgets={HURRIED: NO_TIME})
    return outcome_table(spark, done).select("category", "name", "state", "rows")


ARCHIVE_QUERIES = {
    "archive_backfill": archive_backfill,
    "archive_stream": archive_stream,
    "archive_retention": archive_retention,
    "archive_rerun": archive_rerun,
    "archive_compact": archive_compact,
    "archive_checks": archive_checks,
    "rollup_checks": rollup_checks,
    "presence_new_patterns": presence_new_patterns,
    "reader_checks": reader_checks,
    "selected_checks": selected_checks,
    "run_outcomes": run_outcomes_table,
}
