"""Partition status ladder (L9) branch by branch, the partition-age quirks,
the node-memory cascade (L8) and the status rank (T4)."""


import pytest

from workload_audit.config import fixture_config
from workload_audit.operators.cluster_health import (
    PARTITION_STATUS as S,
    node_thresholds,
    partition_status,
    status_rank,
)
from workload_audit.sources.fixtures import node_metrics, node_settings
from workload_audit.sources.logs import LogTables

COLS = "partition string, size_gb double, avg_part_size_mb double, parts_per_gb double, active_merges long, oversized_threshold_mb long"


def _status(spark, rows, cfg=None):
    df = spark.createDataFrame(rows, COLS)
    cfg = cfg or fixture_config()  # as_of 2024-01-31: months before 202311 and years before 2024 are old
    return [r[0] for r in df.select(partition_status(cfg)).collect()]


def test_each_branch(spark):
    rows = [
        ("202401", 0.05, 10.0, 500.0, 0, 2048),  # tiny
        ("202310", 5.0, 10.0, 120.0, 0, 2048),  # old month, fragmented
        ("202310", 5.0, 100.0, 10.0, 0, 2048),  # old month, frozen
        ("2023", 5.0, 100.0, 10.0, 1, 2048),  # old year, merging
        ("202401", 5.0, 10.0, 100.0, 0, 2048),  # small parts, no merges
        ("202401", 5.0, 10.0, 100.0, 2, 2048),  # small parts, merges active
        ("202401", 5.0, 40.0, 160.0, 1, 2048),  # moderate fragmentation with merges
        ("202401", 5.0, 20.0, 40.0, 0, 2048),  # healthy small
        ("202401", 5.0, 64.0, 40.0, 0, 2048),  # healthy batching
        ("202401", 5.0, 1000.0, 1.0, 0, 2048),  # 128 .. 0.8 thr
        ("202401", 5.0, 2000.0, 1.0, 0, 2048),  # 0.8 .. 1.5 thr
        ("202401", 5.0, 5000.0, 1.0, 0, 2048),  # 1.5 .. 3 thr
        ("202401", 5.0, 7000.0, 1.0, 0, 2048),  # > 3 thr
        ("202401", 5.0, 20.0, 80.0, 0, 2048),  # 16..32 MB but 50 < parts/GB <= 300 -> unclassified
    ]
    assert _status(spark, rows) == [
        S["small"],
        S["historical_busy"],
        S["archived"],
        S["historical_busy"],
        S["backlog"],
        S["catch_up_many"],
        S["catch_up_moderate"],
        S["healthy_small"],
        S["healthy_batching"],
        S["healthy_batching"],
        S["large_ok"],
        S["oversized"],
        S["extreme"],
        S["unclassified"],
    ]


@pytest.mark.parametrize(
    "partition,historical",
    [("202401", False), ("202311", False), ("202310", True), ("2023", True), ("2024", False),
     ("abcdef", True), ("abcd", True), ("all", False), ("20240115", False)],
)
def test_partition_age(spark, partition, historical):
    # Non-numeric 4/6-character partitions read as 0 and so count as old;
    # 8-digit daily partitions are never historical.
    got = _status(spark, [(partition, 5.0, 100.0, 10.0, 0, 2048)])[0]
    assert (got == S["archived"]) == historical


def test_memory_cascade(spark):
    def run(metric, setting):
        t = LogTables(asynchronous_metrics=node_metrics(spark, metric), settings=node_settings(spark, setting))
        r = node_thresholds(t).collect()[0]
        return r["node_ram_gb"], r["oversized_threshold_mb"]

    assert run(128e9, "64000000000") == (119.21, 2048)
    assert run(None, "200000000000") == (186.26, 4096)
    assert run(None, "auto") == (59.6, 1024)
    assert run(None, "") == (59.6, 1024)
    assert run(None, None) == (59.6, 1024)
    assert run(600e9, None) == (558.79, 8192)


def test_status_rank(spark):
    df = spark.createDataFrame([(v,) for v in S.values()], "s string")
    ranks = dict(df.select("s", status_rank("s").alias("r")).collect())
    assert ranks[S["backlog"]] == 1 and ranks[S["historical_busy"]] == 2 and ranks[S["oversized"]] == 3
    assert ranks[S["extreme"]] == 4 and ranks[S["healthy_small"]] == 5 and ranks[S["small"]] == 6
    assert ranks[S["archived"]] == 7 and ranks[S["unclassified"]] == 8
