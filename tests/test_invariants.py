"""Results do not depend on row order or partitioning, and the shared
base gives the same results as separate scans."""

from pyspark.sql import functions as F

from workload_audit.plans.registry import select_checks
from workload_audit.plans.runner import run_checks


def _rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_permutation_and_repartition(spark, tables_small, cfg):
    shuffled = tables_small.with_(
        query_log=tables_small.query_log.repartition(5).orderBy(F.rand(7)),
        part_log=tables_small.part_log.repartition(3).orderBy(F.rand(3)),
        parts=tables_small.parts.repartition(4),
    )
    for spec in select_checks():
        assert _rows(spec.fn(tables_small, cfg)) == _rows(spec.fn(shuffled, cfg)), spec.key


def test_shared_base_equals_separate_scans(spark, tables_small, cfg):
    shared = {(r.category, r.name): sorted(map(str, r.rows)) for r in run_checks(tables_small, cfg, share_base=True)}
    alone = {(r.category, r.name): sorted(map(str, r.rows)) for r in run_checks(tables_small, cfg, share_base=False)}
    assert shared == alone and len(shared) == 17


def test_thresholds_reach_the_plan(spark, tables_small, cfg):
    from workload_audit.operators.anti_patterns import small_insert_batches

    few = small_insert_batches(tables_small, cfg.with_(min_batch_size=1)).count()
    many = small_insert_batches(tables_small, cfg.with_(min_batch_size=10**9)).count()
    assert few == 0 and many > 0


def test_session_time_zone_does_not_change_results(spark, cfg):
    """Log timestamps are wall-clock (TIMESTAMP_NTZ) and every literal is
    built from text, so the session time zone must not matter."""
    from workload_audit.operators.cluster_health import insert_part_fragmentation, merge_pressure
    from workload_audit.operators.top_n import by_duration
    from workload_audit.sources.fixtures import _build_fixture_tables

    from .conftest import SF_SMALL

    def run():
        t = _build_fixture_tables(spark, SF_SMALL)
        return [_rows(f(t, cfg)) for f in (merge_pressure, insert_part_fragmentation, by_duration)]

    before = run()
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        shifted = run()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert before == shifted
