"""Readers: partitions whose files differ, NULLs with the source's defaults."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from workload_audit.operators import anti_patterns, top_n
from workload_audit.session import checkpoint_dir
from workload_audit.sources.logs import conform, read_log_tables, read_table
from workload_audit.sources.schemas import QUERY_LOG


def _dir(spark, name):
    return os.path.join(checkpoint_dir(spark), f"test-{name}-{uuid.uuid4().hex}")


def _rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_partitions_of_different_files_are_one_table(spark, tables_small, cfg):
    """Old days without two columns and with narrower types, new ones as declared."""
    path = _dir(spark, "kinds")
    log = tables_small.query_log
    days = [r[0] for r in log.select("event_date").distinct().orderBy("event_date").collect()]
    for i, day in enumerate(days):
        rows = log.where(F.col("event_date") == F.lit(day)).drop("event_date")
        if i < 10:
            rows = rows.drop("written_rows", "ProfileEvents").withColumns({c: F.col(c).cast("int") for c in ("normalized_query_hash", "query_duration_ms")})
        elif i < 20:
            rows = rows.withColumn("is_initial_query", F.col("is_initial_query").cast("smallint")).withColumn("extra", F.lit("x"))
        rows.coalesce(1).write.parquet(f"{path}/event_date={day}")
    got = read_table(spark, path, "query_log")
    assert got.schema.simpleString() == QUERY_LOG.simpleString()
    late = F.col("event_date") >= F.lit(days[10])
    assert _rows(got.where(late).drop("ProfileEvents")) == _rows(log.where(late).drop("ProfileEvents"))
    early = got.where(~late)
    assert early.count() == log.where(~late).count() and early.where("written_rows <> 0 or ProfileEvents is not null").count() == 0
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    plan = got.where(F.col("event_date") == F.lit(days[3]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    tables = read_log_tables(spark, {"query_log": path})
    assert _rows(top_n.by_read_bytes(tables, cfg)) == _rows(top_n.by_read_bytes(tables_small, cfg))


def test_a_null_pattern_counts_alike_in_every_check(spark, tables_small, cfg):
    own = cfg.with_(top_n=1000, scan_ratio_threshold=0)
    blank = F.when(F.col("normalized_query_hash") != 3003, F.col("normalized_query_hash"))
    raw = tables_small.query_log.withColumn("normalized_query_hash", blank)
    want = tables_small.with_(query_log=conform(raw, "query_log"))
    for check in (top_n.by_memory, top_n.by_read_bytes, top_n.by_duration, anti_patterns.full_scans):
        assert check(want, own).count() == check(tables_small, own).count(), check.__name__
        # the checks keep the pattern even where NULLs come past the adapter
        assert check(tables_small.with_(query_log=raw), own).count() == check(tables_small, own).count(), check.__name__


def test_a_table_without_its_essential_columns_is_refused(spark):
    with pytest.raises(ValueError, match="normalized_query_hash"):
        conform(spark.range(1).selectExpr("id", "current_date() as event_date"), "query_log")
