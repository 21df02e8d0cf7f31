"""Catalogue, category selection (S8) and fault isolation."""

import logging

from workload_audit.plans.registry import REGISTRY, catalogue, select_checks
from workload_audit.plans.runner import run_checks


def test_catalogue_has_all_checks():
    cat = catalogue()
    assert len(cat) == 17
    assert {(c, n) for c, n, _ in cat} == set(REGISTRY) and len(cat) == 17
    assert cat == sorted(cat)
    assert all(REGISTRY[(c, n)].fn for c, n, _ in cat)


def test_category_filter():
    assert [s.name for s in select_checks(("top_n",))] == ["by_duration", "by_memory", "by_read_bytes", "by_weighted_cost"]
    assert select_checks(("nope",)) == []


def test_unknown_category_runs_nothing(spark, tables_small, cfg, caplog):
    with caplog.at_level(logging.WARNING):
        assert run_checks(tables_small, cfg.with_(only_categories=("nope",))) == []
    assert "no checks selected" in caplog.text


def test_failing_check_is_skipped(spark, tables_small, cfg, caplog):
    broken = tables_small.with_(part_log=None)
    with caplog.at_level(logging.WARNING):
        res = run_checks(broken, cfg.with_(only_categories=("cluster_health",)))
    names = [r.name for r in res]
    assert "insert_part_fragmentation" not in names and "merge_pressure" not in names
    assert "partition_health" in names and "insert_duration_by_engine" in names
    assert "missing input table" in caplog.text


def test_parallel_and_serial_runs_agree(spark, tables_small, cfg):
    par = run_checks(tables_small, cfg, parallelism=4)
    ser = run_checks(tables_small, cfg, parallelism=1)
    assert [(r.category, r.name) for r in par] == [(r.category, r.name) for r in ser]
    assert [sorted(map(str, r.rows)) for r in par] == [sorted(map(str, r.rows)) for r in ser]


def test_extra_self_patterns_exclude_archive_queries(spark, tables_small, cfg):
    from workload_audit.operators.top_n import by_read_bytes

    base = {r["query_text"] for r in by_read_bytes(tables_small, cfg.with_(top_n=100)).collect()}
    star = {t for t in base if t.startswith("SELECT * FROM")}
    assert star
    filtered = {r["query_text"] for r in by_read_bytes(tables_small, cfg.with_(top_n=100, extra_self_patterns=("SELECT * FROM%",))).collect()}
    assert filtered == base - star


def test_outcomes_tell_failures_and_overruns(spark, tables_small, cfg, tmp_path_factory):
    """A check that has no input fails, one that gets no time is interrupted, the others are done; results may be written instead of collected."""
    import os
    import uuid

    from workload_audit.plans.runner import outcome_table, run_outcomes, written_to
    from workload_audit.session import checkpoint_dir

    own = cfg.with_(only_categories=("top_n", "cost_attribution", "cluster_health"))
    path = os.path.join(checkpoint_dir(spark), f"out-{uuid.uuid4().hex}")
    out = run_outcomes(tables_small.with_(part_log=None), own, budgets={"top_n/by_memory": 0.001}, take=written_to(path))
    state = {o.name: o.state for o in out}
    assert state["by_memory"] == "timed out" and state["merge_pressure"] == "failed" and state["insert_part_fragmentation"] == "failed"
    assert {state[n] for n in ("by_user", "by_duration", "by_read_bytes", "partition_health")} == {"done"}
    assert [(o.category, o.name) for o in out] == sorted((o.category, o.name) for o in out)
    table = {r["name"]: r for r in outcome_table(spark, out).collect()}
    assert "missing input" in table["merge_pressure"]["error"] and table["by_user"]["error"] is None and table["by_user"]["seconds"] > 0
    assert spark.read.parquet(f"{path}/cost_attribution/by_user").count() == table["by_user"]["rows"]
    assert not any(n.startswith("run-") for n in os.listdir(checkpoint_dir(spark).removeprefix("file:")))


def test_an_overrunning_job_is_stopped(spark, tables_small, cfg):
    """A job that would run for minutes ends soon after its budget."""
    import time

    from workload_audit.plans.runner import run_outcomes

    many = tables_small.query_log.selectExpr("*", "explode(sequence(1, 100000)) as i").selectExpr("*", "explode(sequence(1, 1000)) as j")
    start = time.monotonic()
    out = run_outcomes(tables_small.with_(query_log=many), cfg.with_(only_categories=("cost_attribution",)), seconds=2)
    assert [o.state for o in out] == ["timed out"] and time.monotonic() - start < 60
