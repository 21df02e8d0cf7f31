"""Compaction: no row lost or doubled, whatever step a crash falls on, and late and replayed batches."""

import datetime as dt
import os

import pytest

from tests.test_archive import _dir, _ids, _log
from workload_audit.streaming import archive as A
from workload_audit.streaming import compaction, files

DAY = dt.datetime(2024, 1, 10, 3)


def _filled(spark):
    path = _dir(spark, "compact")
    for batch in range(4):
        A.put(_log(spark, [(10 * batch + k, DAY + dt.timedelta(days=k)) for k in range(3)]), batch, path)
    return path, [10 * b + k for b in range(4) for k in range(3)]


def _batches(path, day):
    at = os.path.join(path, "event_month=202401", f"event_date={day}")
    return sorted(os.listdir(at)) if os.path.isdir(at) else []


def test_folded_days_are_read_once_with_late_and_replayed_batches(spark):
    path, ids = _filled(spark)
    days = [DAY.date(), DAY.date() + dt.timedelta(days=1)]
    assert compaction.compact(spark, path, days, 2) == ["2024-01-10", "2024-01-11"]
    assert _ids(A.read_archive(spark, path)) == ids
    assert _batches(path, "2024-01-10") == ["batch_id=3"] and len(_batches(path, "2024-01-12")) == 4
    A.put(_log(spark, [(99, DAY)]), 4, path)  # late
    A.put(_log(spark, [(10, DAY)]), 1, path)  # a replay of a folded batch
    assert _ids(A.read_archive(spark, path)) == [*ids, 99]
    assert compaction.compact(spark, path, days, 4) == ["2024-01-10", "2024-01-11"]
    assert compaction.compact(spark, path, days, 4) == []
    assert _ids(A.read_archive(spark, path)) == [*ids, 99] and _batches(path, "2024-01-10") == []
    rows = A.read_archive(spark, path)
    assert rows.where("batch_id = 1").count() == 3 and rows.where("event_date = '2024-01-10'").count() == 5
    # the folder of the first compaction is gone, and retention reaches the folded days
    assert len(files.children(spark, f"{path}/{compaction.FOLDED}")) == 1
    A.apply_retention(spark, path, DAY.date() + dt.timedelta(days=90))
    assert _ids(A.read_archive(spark, path)) == [i for i in ids if i % 10 > 0]


@pytest.mark.parametrize("step", ["write_text", "rename", "delete"])
def test_a_crash_at_any_step_loses_nothing(spark, monkeypatch, step):
    path, ids = _filled(spark)
    real = getattr(files, step)

    def broken(spark, at, *rest):
        if "_manifest" in at or "batch_id=" in at:
            raise OSError("lost")
        return real(spark, at, *rest)

    monkeypatch.setattr(files, step, broken)
    with pytest.raises(OSError):
        compaction.compact(spark, path, [DAY.date()], 3)
    assert _ids(A.read_archive(spark, path)) == ids
    monkeypatch.undo()
    compaction.compact(spark, path, [DAY.date()], 3)
    assert _ids(A.read_archive(spark, path)) == ids and _batches(path, "2024-01-10") == []
    assert len(files.children(spark, f"{path}/{compaction.FOLDED}")) == 1


def test_only_one_of_two_compactions_switches(spark, monkeypatch):
    path, ids = _filled(spark)
    stale = compaction.manifest(spark, path)
    compaction.compact(spark, path, [DAY.date()], 3)
    current = compaction.manifest
    calls = iter([stale, stale])
    monkeypatch.setattr(compaction, "manifest", lambda s, a: next(calls, None) or current(s, a))
    with pytest.raises(RuntimeError, match="faster"):
        compaction.compact(spark, path, [DAY.date() + dt.timedelta(days=1)], 3)
    monkeypatch.undo()
    assert _ids(A.read_archive(spark, path)) == ids


def test_committed_batch(spark, tables_small):
    root = _dir(spark, "commits")
    landing, path, ckpt = (os.path.join(root, p) for p in ("landing", "data", "ckpt"))
    assert compaction.committed_batch(spark, ckpt) == -1
    A.backfill(spark, tables_small.query_log, path, dt.datetime(2024, 1, 20))
    tables_small.query_log.repartition(3).write.parquet(landing)
    A.start_stream(spark, landing, path, ckpt, max_files_per_trigger=1).awaitTermination()
    upto = compaction.committed_batch(spark, ckpt)
    assert upto == 2
    want = _ids(tables_small.query_log)
    compaction.compact(spark, path, [dt.date(2024, 1, d) for d in range(1, 31)], upto)
    assert _ids(A.read_archive(spark, path)) == want
