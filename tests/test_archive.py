"""Archive: backfill + stream = source exactly once; re-runs and replays
add nothing; late rows are kept; retention at the 90-day boundary."""

import datetime as dt
import os
import uuid

import pytest
from pyspark.sql import functions as F

from workload_audit.session import checkpoint_dir
from workload_audit.sources.schemas import QUERY_LOG
from workload_audit.streaming import archive as A


def _dir(spark, name):
    return os.path.join(checkpoint_dir(spark), f"test-{name}-{uuid.uuid4().hex}")


def _ids(df):
    return sorted(r[0] for r in df.select("query_id").collect())


def _log(spark, rows):
    base = []
    for qid, ts in rows:
        base.append((qid, ts, ts.date(), "QueryFinish", 1, "Select", "u", 1, "SELECT 1", 1, 1, 1, 1, 0, 1, {"SelectedParts": 1}, "db", ["db.t"]))
    return spark.createDataFrame(base, QUERY_LOG)


def test_backfill_plus_stream_equals_source(spark, tables_small):
    root = _dir(spark, "arch")
    landing, archive, ckpt = (os.path.join(root, p) for p in ("landing", "data", "ckpt"))
    src = tables_small.query_log
    cutoff = dt.datetime(2024, 1, 15, 12, 0, 0)
    assert A.backfill(spark, src, archive, cutoff) is True
    src.repartition(3, "event_date").write.parquet(landing)
    A.start_stream(spark, landing, archive, ckpt, max_files_per_trigger=1).awaitTermination()
    assert _ids(A.read_archive(spark, archive)) == _ids(src)

    # Re-running both steps adds nothing (ST5).
    assert A.backfill(spark, src, archive, cutoff) is False
    A.start_stream(spark, landing, archive, ckpt).awaitTermination()
    assert _ids(A.read_archive(spark, archive)) == _ids(src)


def test_replayed_batch_replaces_itself_and_late_rows_are_kept(spark):
    archive = _dir(spark, "replay")
    batch = _log(spark, [(1, dt.datetime(2024, 1, 10, 1)), (2, dt.datetime(2024, 1, 11, 1))])
    A.put(batch, 5, archive)
    A.put(batch, 5, archive)  # replay of batch 5
    late = _log(spark, [(3, dt.datetime(2024, 1, 2, 1))])  # arrives later, belongs to an older day
    A.put(late, 6, archive)
    assert _ids(A.read_archive(spark, archive)) == [1, 2, 3]


def test_stream_takes_rows_at_or_after_cutoff(spark):
    root = _dir(spark, "cut")
    landing, archive, ckpt = (os.path.join(root, p) for p in ("landing", "data", "ckpt"))
    cutoff = dt.datetime(2024, 1, 10, 0, 0, 0)
    rows = _log(spark, [(1, cutoff - dt.timedelta(seconds=1)), (2, cutoff), (3, cutoff + dt.timedelta(days=1))])
    A.backfill(spark, rows, archive, cutoff)
    rows.write.parquet(landing)
    A.start_stream(spark, landing, archive, ckpt).awaitTermination()
    got = A.read_archive(spark, archive)
    assert _ids(got) == [1, 2, 3]
    assert _ids(got.where(F.col("batch_id") == A.BACKFILL_BATCH)) == [1]


def test_retention_boundary(spark):
    archive = _dir(spark, "ret")
    as_of = dt.date(2024, 4, 30)
    old = dt.datetime.combine(as_of - dt.timedelta(days=90), dt.time(5))
    kept = dt.datetime.combine(as_of - dt.timedelta(days=89), dt.time(5))
    A.put(_log(spark, [(1, old), (2, kept)]), 0, archive)
    # The reader hides expired rows before they are deleted ...
    assert _ids(A.read_archive(spark, archive, as_of)) == [2]
    removed = A.apply_retention(spark, archive, as_of)
    assert len(removed) == 1 and removed[0].endswith(f"event_date={old.date().isoformat()}")
    # ... and after deletion the files are gone.
    assert _ids(A.read_archive(spark, archive)) == [2]


def test_stream_without_cutoff_is_refused(spark):
    root = _dir(spark, "nocut")
    with pytest.raises(ValueError, match="cutoff"):
        A.start_stream(spark, os.path.join(root, "landing"), os.path.join(root, "data"), os.path.join(root, "ckpt"))


def test_rows_without_a_date_stay(spark):
    archive = _dir(spark, "nodate")
    day = dt.datetime(2024, 1, 10, 1)
    rows = _log(spark, [(1, day), (2, day)]).withColumn("event_date", F.when(F.col("query_id") == 1, F.col("event_date")))
    A.put(rows, 0, archive)
    assert len(A.apply_retention(spark, archive, dt.date(2025, 1, 1))) == 1
    assert _ids(A.read_archive(spark, archive)) == [2]
