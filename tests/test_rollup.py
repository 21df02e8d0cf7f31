"""Checks over a rollup give what they give over the log; batches replace themselves; sketches and presence bits merge."""

import datetime as dt
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from workload_audit.functions.quantiles import group_quantiles
from workload_audit.functions.sketches import merged_sketch, rank_error, sketch_of, sketch_quantiles
from workload_audit.operators import common, top_n
from workload_audit.operators.anomalies import new_expensive_patterns
from workload_audit.plans.registry import select_checks
from workload_audit.plans.runner import checkpointed, with_shared_days
from workload_audit.session import checkpoint_dir
from workload_audit.streaming import archive, presence, rollup

HASH = "normalized_query_hash"


def _dir(spark, name):
    return os.path.join(checkpoint_dir(spark), f"test-{name}-{uuid.uuid4().hex}")


def _rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.fixture(scope="module")
def rolled(spark, tables_small, cfg):
    """The log rolled up in batches: an old one, one that is replayed, and a late one that adds to days already there."""
    path = _dir(spark, "rollup")
    log = tables_small.query_log
    late = F.col("query_id") % 7 == 0
    old = F.col("event_date") < F.lit(dt.date(2024, 1, 20))
    rollup.put(log.where(old & ~late), rollup.BACKFILL_BATCH, path, cfg)
    rollup.put(log.where(~old & ~late), 0, path, cfg)
    rollup.put(log.where(~old & ~late), 0, path, cfg)
    rollup.put(log.where(late), 1, path, cfg)
    return path


@pytest.mark.parametrize("closed, other", [(dt.date(2024, 1, 27), {}), (dt.date(2024, 2, 1), {"include_internal": True, "exclude_users": ("svc_3",), "min_executions": 2, "regression_threshold_pct": 1})])
def test_checks_over_a_rollup_equal_checks_over_the_log(spark, tables_small, cfg, rolled, closed, other):
    """Closed days from the rollup and open ones from the log, or all from the rollup: value by value."""
    both, cfg = rollup.rolled_tables(spark, tables_small, rolled, cfg, closed), cfg.with_(**other)
    if closed > cfg.today:  # the log is not needed at all
        both = both.with_(query_log=tables_small.query_log.where("event_date > '2024-01-31'"))
    for spec in select_checks():
        if spec.uses_patterns:
            assert _rows(spec.fn(both, cfg)) == _rows(spec.fn(tables_small, cfg)), spec.key


def _plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "100000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("other", [{}, {"include_internal": True, "exclude_users": ("svc_3",), "min_executions": 2, "regression_threshold_pct": 1}])
def test_open_days_are_rolled_up_once_for_all_checks(spark, tables_small, cfg, rolled, other):
    """No check reads the log itself, and each finds what it finds over the log."""
    cfg = cfg.with_(**other)
    both = with_shared_days(rollup.rolled_tables(spark, tables_small, rolled, cfg, dt.date(2024, 1, 27)), cfg, select_checks(), checkpointed)
    for spec in select_checks():
        if spec.uses_patterns:
            df = spec.fn(both, cfg)
            assert "events.parquet" not in _plan(df), spec.key
            assert _rows(df) == _rows(spec.fn(tables_small, cfg)), spec.key


def test_open_days_have_sketches_where_they_are_asked_for(spark, tables_small, cfg, rolled):
    own = cfg.with_(approx_quantiles=True, top_n=1000)
    both = with_shared_days(rollup.rolled_tables(spark, tables_small, rolled, own, dt.date(2024, 1, 27)), own, select_checks(), checkpointed)
    for spec in select_checks(("top_n",)):
        df = spec.fn(both, own)
        assert "events.parquet" not in _plan(df), spec.key
        assert {(r["query_text"], r["executions"]) for r in df.collect()} == {(r["query_text"], r["executions"]) for r in spec.fn(tables_small, own).collect()}


def _counted_reads(spark, log):
    """``log``, and how many of its rows have been read so far."""
    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    return log.mapInArrow(passed, log.schema), read


def test_a_batch_is_read_twice(spark, tables_small, cfg):
    """Once for its values, once for all else: numbers, texts, sketches and presence."""
    log, read = _counted_reads(spark, tables_small.query_log)
    rollup.put(log, 0, _dir(spark, "reads"), cfg)
    assert read.value == 2 * tables_small.query_log.count()


def test_the_rollup_of_a_run_is_one_read(spark, tables_small, cfg):
    log, read = _counted_reads(spark, tables_small.query_log)
    own = rollup.rollup_of(log, cfg, 40, checkpointed)
    assert own.numbers.count() == own.texts_table.count() > 0
    assert read.value == tables_small.query_log.count()


def test_merged_parts_are_named_without_a_lambda(spark, tables_small):
    """The part log's list of merged parts is the texts of 0 to the line's number, in generated code alone."""
    merges = tables_small.part_log.where("event_type = 'MergeParts'")
    assert "lambda" not in _plan(merges)
    for row in merges.select("part_name", "merged_from").limit(50).collect():
        assert row["merged_from"] == [str(i) for i in range(int(row["part_name"].rsplit("_", 1)[1]) + 1)]


def test_the_key_of_an_event_is_told_once(tables_small, cfg):
    """A filter on the text, which the fixture makes from the event's number, does not look for that number again."""
    assert _plan(rollup.rolled(tables_small.query_log, cfg, ("numbers", "texts"))).count("regexp_extract(") == 1


def test_a_rollup_of_other_thresholds_is_refused(spark, cfg, rolled):
    with pytest.raises(ValueError, match="rolled up with"):
        rollup.read_rollup(spark, rolled, cfg.with_(min_batch_size=5))
    with pytest.raises(ValueError, match="not a rollup"):
        rollup.read_rollup(spark, _dir(spark, "nothing"), cfg)


def test_stream_keeps_archive_and_rollup(spark, tables_small, cfg):
    root = _dir(spark, "stream")
    landing, kept, ckpt, path = (os.path.join(root, p) for p in ("landing", "data", "ckpt", "rollup"))
    cutoff = dt.datetime(2024, 1, 20)
    log = tables_small.query_log
    archive.backfill(spark, log, kept, cutoff, also=lambda df, batch: rollup.put(df, batch, path, cfg))
    log.repartition(3).write.parquet(landing)
    archive.start_stream(spark, landing, kept, ckpt, max_files_per_trigger=1, also=lambda df, batch: rollup.put(df, batch, path, cfg)).awaitTermination()
    everything = rollup.rolled_tables(spark, tables_small, path, cfg, dt.date(2024, 2, 1))
    per_day = lambda df, n: _rows(df.groupBy("event_date").agg(F.sum(n).alias("n")))
    initial = log.where("is_initial_query = 1 and query not like '%system.query_log%'")
    assert per_day(everything.rollup.numbers, "every.n") == per_day(initial, F.lit(1))


def test_sketches_keep_their_bound_when_merged(spark):
    rnd = random.Random(4)
    values = [int(rnd.paretovariate(1.1) * 1000) for _ in range(60_000)]
    frame = spark.createDataFrame([(i % 30, v) for i, v in enumerate(values)], "day long, x long").repartition(5)
    for k in (50, 200, 1000):
        daily = frame.groupBy("day").agg(sketch_of(F.col("x"), k).alias("s"))
        specs = {f"p{p}": ("exact", p / 100) for p in (5, 25, 50, 90, 95, 99)}
        got = daily.agg(merged_sketch(F.col("s"), k).alias("s")).select(*sketch_quantiles("s", specs)).first()
        ordered = sorted(values)
        for name, (_, p) in specs.items():
            low = sum(v < got[name] for v in ordered) / len(ordered)
            high = sum(v <= got[name] for v in ordered) / len(ordered)
            slack = 1.5 * rank_error(k)  # one rank in a hundred may lie beyond the bound itself
            assert low - slack <= p <= high + slack, (k, name)


def test_approximate_checks_read_the_sketches(spark, tables_small, cfg, rolled):
    """Within the bound, or equal where a pattern has few values; and the rollup's sketches alone do it."""
    own = cfg.with_(approx_quantiles=True, approx_accuracy=200, top_n=1000)
    both = rollup.rolled_tables(spark, tables_small, rolled, cfg, dt.date(2024, 2, 1)).with_(query_log=tables_small.query_log.limit(0))
    for spec in select_checks(("top_n",)):
        approx, exact = spec.fn(both, own).collect(), spec.fn(tables_small, own).collect()
        assert len(approx) == len(exact)
        assert {(r["query_text"], r["executions"]) for r in approx} == {(r["query_text"], r["executions"]) for r in exact}
    log = tables_small.query_log
    exact = {r[HASH]: r for r in group_quantiles(log, [HASH], "query_duration_ms", {"p95": ("exact", 0.95)}, rows="n").collect()}
    approx = {r[HASH]: r for r in group_quantiles(log, [HASH], "query_duration_ms", {"p95": ("exact", 0.95)}, approx=True, rows="n").collect()}
    assert exact.keys() == approx.keys() and all(exact[h]["n"] == approx[h]["n"] for h in exact)
    values = {h: [] for h in exact}
    for r in log.select(HASH, "query_duration_ms").collect():
        values[r[0]].append(r[1])
    for h, own_values in values.items():
        below = sum(v < approx[h]["p95"] for v in own_values) / len(own_values)
        upto = sum(v <= approx[h]["p95"] for v in own_values) / len(own_values)
        assert below - 1.5 * rank_error(200) <= 0.95 <= upto + 1.5 * rank_error(200)


def test_presence_masks(spark, cfg):
    base = dt.date(2024, 1, 1)
    rows = [(1, "a", 0), (1, "b", 70), (2, "a", 63), (2, "a", 64), (3, "sql-console", 5), (4, None, 200), (None, "a", 10)]
    log = spark.createDataFrame([(h, u, base + dt.timedelta(days=d)) for h, u, d in rows], f"{HASH} long, user string, event_date date")
    log = log.selectExpr("*", "1 as is_initial_query", "'QueryFinish' as type", "'Select' as query_kind", "'SELECT 1' as query")
    bits = presence.day_bits(log, cfg)
    twice = bits.unionByName(bits)  # a replayed batch
    for first, until in ((0, 1), (0, 64), (63, 64), (64, 65), (1, 63), (65, 300), (5, 6), (10, 11), (7, 7)):
        got = {r[0] for r in presence.ran_between(twice, cfg, base + dt.timedelta(days=first), base + dt.timedelta(days=until)).collect()}
        assert got == {h for h, u, d in rows if first <= d < until and u != "sql-console"}, (first, until)


def test_new_patterns_with_the_index_read_the_log_of_one_period(spark, tables_small, cfg):
    bits = presence.day_bits(tables_small.query_log, cfg)
    indexed = tables_small.with_(presence=bits)
    assert _rows(new_expensive_patterns(indexed, cfg)) == _rows(new_expensive_patterns(tables_small, cfg))
    path = _dir(spark, "presence")
    presence.put(tables_small.query_log, 3, path, cfg)
    presence.put(tables_small.query_log, 3, path, cfg)
    recent = tables_small.with_(presence=presence.read_presence(spark, path), query_log=tables_small.query_log.where("event_date >= '2024-01-24'"))
    assert _rows(new_expensive_patterns(recent, cfg)) == _rows(new_expensive_patterns(tables_small, cfg))


def test_patterns_below_the_bar_are_not_counted(spark, tables_small, cfg):
    """Few slow patterns among many fast ones: only those whose greatest value reaches the bar are looked at, and the rows are the same."""
    log = tables_small.query_log.where("query_kind = 'Select'")
    spread = log.withColumn(HASH, (F.col("query_id") % 97).cast("bigint")).withColumn("query_duration_ms", (F.col("query_duration_ms") % 50 + F.pow(F.col(HASH) % 97, 2)).cast("bigint"))
    path = _dir(spark, "bar")
    rollup.put(spread, 0, path, cfg)
    own = cfg.with_(top_n=5)
    both = rollup.rolled_tables(spark, tables_small.with_(query_log=spread), path, own, dt.date(2024, 2, 1))
    specs = {"p95": ("cont", 0.95)}
    kept, everything = common.reaching(both, own, "selects", "query_duration_ms", "p95", specs), common.pattern_counts(both, own, "selects", [])
    assert 5 <= kept.count() < everything.select(HASH).distinct().count() / 4
    assert _rows(top_n.by_duration(both, own)) == _rows(top_n.by_duration(tables_small.with_(query_log=spread), own))
    few = own.with_(top_n=500)
    assert common.reaching(both, few, "selects", "query_duration_ms", "p95", specs).count() == everything.select(HASH).distinct().count()
