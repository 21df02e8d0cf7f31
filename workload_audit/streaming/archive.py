"""Retained archive of the query log (ST1-ST5).

Layout: one plain Parquet directory partitioned by ``event_month`` /
``event_date`` / ``batch_id``, rows sorted by (event_date, pattern hash)
inside each file, so both day predicates and pattern filters prune.

* ``backfill`` (ST2) copies every log row before a cutoff once, with
  ``batch_id = -1``, and records the cutoff. It does nothing when the archive
  already exists (ST5).
* ``start_stream`` (ST1) copies new log files from a landing folder with
  Structured Streaming. Each micro-batch is written by ``foreachBatch`` with
  dynamic partition overwrite into its own ``batch_id`` partitions, so a batch
  replayed after a failure replaces itself instead of adding duplicates. Only
  rows at or after the cutoff are taken, so backfill + stream is the source
  exactly once, with no gap between the two. The stream is stateless: late
  rows are archived too (no watermark).
* ``apply_retention`` (ST4) deletes day partitions older than the retention;
  ``read_archive`` applies the same predicate, so results are right even
  before files are physically removed.

The built-in Parquet streaming sink is deliberately not used: its metadata
log would hide the backfill's files from readers of the same folder.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.logs import conform
from ..sources.schemas import QUERY_LOG
from . import files
from .compaction import FOLDED, read_folded

#: What is done with a batch of log rows and its number.
Batch = Callable[[DataFrame, int], None]

BACKFILL_BATCH = -1
CUTOFF_MARKER = "_archive_cutoff.json"
DEFAULT_RETENTION_DAYS = 90
PARTITION_COLUMNS = ("event_month", "event_date", "batch_id")


#: The partition of rows without a date.
NO_DATE = "__HIVE_DEFAULT_PARTITION__"


def put(df: DataFrame, batch_id: int, archive: str) -> None:
    """Write one batch of log rows into its own archive partitions."""
    (
        conform(df, "query_log")
        .withColumn("event_month", F.date_format("event_date", "yyyyMM"))
        .withColumn("batch_id", F.lit(int(batch_id)).cast("bigint"))
        .hint("rebalance", F.col("event_date"))  # few files a day, and a large day still in several
        .sortWithinPartitions("event_date", "normalized_query_hash")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*PARTITION_COLUMNS)
        .parquet(archive)
    )


def archive_cutoff(spark: SparkSession, archive: str) -> dt.datetime | None:
    marker = f"{archive.rstrip('/')}/{CUTOFF_MARKER}"
    if not files.exists(spark, marker):
        return None
    return dt.datetime.fromisoformat(json.loads(files.read_text(spark, marker))["cutoff"])


def backfill(spark: SparkSession, source: DataFrame, archive: str, cutoff: dt.datetime, also: Batch | None = None) -> bool:
    """Copy rows with ``event_time < cutoff`` once. Returns False (and writes
    nothing) when the archive was already initialised. ``also`` gets the same
    rows, as batch ``BACKFILL_BATCH``."""
    if archive_cutoff(spark, archive) is not None:
        return False
    lit_cutoff = F.lit(cutoff.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
    rows = source.where(F.col("event_time") < lit_cutoff)
    put(rows, BACKFILL_BATCH, archive)
    if also:
        also(rows, BACKFILL_BATCH)
    files.write_text(spark, f"{archive.rstrip('/')}/{CUTOFF_MARKER}", json.dumps({"cutoff": cutoff.isoformat()}))
    return True


def start_stream(
    spark: SparkSession,
    landing: str,
    archive: str,
    checkpoint: str,
    *,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
    processing_time: str | None = None,
    also: Batch | None = None,
) -> StreamingQuery:
    """Stream new log files from ``landing`` into the archive (rows at or
    after the recorded cutoff). An archive without a cutoff is refused: its
    backfill would add the rows before it a second time. ``also`` gets each
    batch too (``rollup.put``, say) and must replace what it did for a batch
    of that number before."""
    cutoff = archive_cutoff(spark, archive)
    if cutoff is None:
        raise ValueError(f"{archive} has no recorded cutoff; run backfill first")
    reader = spark.readStream.schema(QUERY_LOG)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = reader.parquet(landing)
    rows = rows.where(F.col("event_time") >= F.lit(cutoff.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz"))

    def each(df: DataFrame, batch_id: int) -> None:
        put(df, batch_id, archive)
        if also:
            also(df, batch_id)

    writer = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def read_archive(
    spark: SparkSession, archive: str, as_of: dt.date | None = None, retention_days: int = DEFAULT_RETENTION_DAYS
) -> DataFrame:
    """Archive rows as a query log, without rows past the retention; compacted days are read from their folded files."""
    df = read_folded(spark, archive)
    if df is None:
        raise ValueError(f"{archive} has no rows yet")
    if as_of is not None:
        df = df.where(F.col("event_date").isNull() | (F.col("event_date") > F.lit(as_of - dt.timedelta(days=retention_days))))
    return df


def apply_retention(
    spark: SparkSession, archive: str, as_of: dt.date, retention_days: int = DEFAULT_RETENTION_DAYS
) -> list[str]:
    """Delete ``event_date`` partitions with ``event_date + retention <= as_of``.
    Lists only partition directories (one per day), never data."""
    removed = []
    limit = as_of - dt.timedelta(days=retention_days)
    top = archive.rstrip("/")
    for root in (top, *(f"{top}/{FOLDED}/{name}" for name, _ in files.children(spark, f"{top}/{FOLDED}"))):
        for month, is_folder in files.children(spark, root):
            if not (is_folder and month.startswith("event_month=")):
                continue
            days = [name for name, folder in files.children(spark, f"{root}/{month}") if folder and name.startswith("event_date=")]
            for day in days:
                day_of = day.split("=", 1)[1]
                # rows without a date have no age and stay
                if day_of != NO_DATE and dt.date.fromisoformat(day_of) <= limit:
                    files.delete(spark, f"{root}/{month}/{day}")
                    removed.append(f"{month}/{day}")
            if not files.children(spark, f"{root}/{month}"):
                files.delete(spark, f"{root}/{month}")
    return removed
