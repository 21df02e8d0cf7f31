"""Physical plans over a real, date-partitioned query log: the day window
prunes partitions, predicates reach the Parquet reader, only the needed
columns are read, and no Python UDF appears anywhere."""

import os
import uuid

import pytest

from workload_audit.plans.registry import select_checks
from workload_audit.session import checkpoint_dir
from workload_audit.sources.logs import read_log_tables


@pytest.fixture(scope="module")
def real_tables(spark, tables_small):
    root = os.path.join(checkpoint_dir(spark), f"plans-{uuid.uuid4().hex}")
    tables_small.query_log.write.partitionBy("event_date").parquet(os.path.join(root, "query_log"))
    tables_small.part_log.write.parquet(os.path.join(root, "part_log"))
    tables_small.tables.write.parquet(os.path.join(root, "tables"))
    return read_log_tables(
        spark,
        {n: os.path.join(root, n) for n in ("query_log", "part_log", "tables")},
    )


def _plan(df) -> str:
    spark = df.sparkSession
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_query_log_checks_prune_and_push_down(real_tables, cfg):
    for spec in select_checks():
        if "query_log" not in spec.needs:
            continue
        plan = _plan(spec.fn(real_tables, cfg))
        assert "PartitionFilters: [isnotnull(event_date" in plan, spec.key
        assert "EqualTo(type,QueryFinish)" in plan or "In(type," in plan, spec.key
        assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_projection_is_pruned(real_tables, cfg):
    from workload_audit.operators.top_n import by_read_bytes

    schemas = [line for line in _plan(by_read_bytes(real_tables, cfg)).split("\n") if "ReadSchema: " in line]
    assert any("read_bytes" in s for s in schemas)
    assert not any("ProfileEvents" in s or "memory_usage" in s for s in schemas)


def test_insert_histogram_joins_after_aggregating(real_tables, cfg):
    from workload_audit.operators.cluster_health import insert_duration_by_engine

    plan = _plan(insert_duration_by_engine(real_tables, cfg))
    # The join with the tables snapshot sits above a pre-aggregation of the log.
    join_at = plan.index("Join")
    assert "HashAggregate" in plan[join_at:]


def _ran(df) -> str:
    """The plan as it ran, reused exchanges marked."""
    df.collect()
    plan = _plan(df)
    return plan[plan.index("Final Plan") : plan.index("Initial Plan")] if "Initial Plan" in plan else plan


def _reads(plan: str, table: str) -> int:
    return sum("FileScan" in line and table in line for line in plan.split("\n"))


def _exchanges(plan: str) -> int:
    return sum("Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line for line in plan.split("\n") if "Reused" not in line)


def test_quantiles_take_one_read_and_few_exchanges(real_tables, cfg):
    from workload_audit.functions.quantiles import group_quantiles
    from workload_audit.operators.cluster_health import merge_pressure

    plan = _ran(group_quantiles(real_tables.query_log, ["normalized_query_hash"], "query_duration_ms", {"p95": ("cont", 0.95)}))
    assert _reads(plan, "query_log") == 1 and _exchanges(plan) <= 5, plan
    plan = _ran(merge_pressure(real_tables, cfg))
    assert _reads(plan, "part_log") == 1 and _exchanges(plan) <= 5, plan


def test_ranking_does_not_sort_the_log(real_tables, cfg):
    """Patterns are ranked by hash aggregation; texts come from a second read that only lets the leaders' rows through."""
    from workload_audit.operators import anomalies, anti_patterns, top_n

    for check, reads in ((top_n.by_read_bytes, 2), (anti_patterns.full_scans, 2), (top_n.by_duration, 2), (top_n.by_memory, 2), (anomalies.wow_duration_regressions, 2), (anomalies.new_expensive_patterns, 3)):
        plan = _ran(check(real_tables, cfg.with_(regression_threshold_pct=-100, min_executions=1)))
        assert "SortAggregate" not in plan, check.__name__
        assert _reads(plan, "query_log") == reads, check.__name__
        assert "BroadcastHashJoin" in plan, check.__name__
