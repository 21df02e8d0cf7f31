"""Exact quantiles by rank selection against a brute-force sort."""

import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from workload_audit.functions.quantiles import group_quantiles


def brute_exact(vals, p):
    s = sorted(vals)
    r = min(math.floor(p * len(s)), len(s) - 1) if p < 1 else len(s) - 1
    return s[r]


def brute_cont(vals, p):
    s = sorted(vals)
    pos = (len(s) - 1) * p
    lo, hi = s[math.floor(pos)], s[math.ceil(pos)]
    return float(lo) + (float(hi) - float(lo)) * (pos - math.floor(pos))


def run(spark, rows, specs):
    df = spark.createDataFrame(rows, "g string, x long")
    out = group_quantiles(df, ["g"], "x", specs).collect()
    return {r["g"]: r.asDict() for r in out}


def test_exact_rank_rule_on_one_to_ten(spark):
    got = run(spark, [("a", i) for i in range(1, 11)], {"p50": ("exact", 0.5), "p90": ("exact", 0.9), "mx": ("exact", 1.0)})
    # 0-based rank floor(p*n): p50 -> 6th value, p90 -> 10th value
    assert got["a"]["p50"] == 6 and got["a"]["p90"] == 10 and got["a"]["mx"] == 10


def test_single_value_group(spark):
    got = run(spark, [("a", 7)], {"e": ("exact", 0.5), "c": ("cont", 0.95)})
    assert got["a"]["e"] == 7 and got["a"]["c"] == 7.0


def test_values_across_all_bucket_levels(spark):
    rnd = random.Random(3)
    groups = {
        "wide": [rnd.randrange(-(2**62), 2**62) for _ in range(400)],
        "dense": [rnd.randrange(0, 50) for _ in range(300)],
        "mid": [rnd.randrange(2**20, 2**44) for _ in range(250)],
        "dups": [5] * 100 + [2**43] * 3,
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    rnd.shuffle(rows)
    specs = {"e50": ("exact", 0.5), "e90": ("exact", 0.9), "c95": ("cont", 0.95), "c50": ("cont", 0.5)}
    got = run(spark, rows, specs)
    for g, vs in groups.items():
        assert got[g]["e50"] == brute_exact(vs, 0.5), g
        assert got[g]["e90"] == brute_exact(vs, 0.9), g
        assert got[g]["c95"] == brute_cont(vs, 0.95), g
        assert got[g]["c50"] == brute_cont(vs, 0.5), g


def test_hot_group_is_exact(spark):
    """One group holding most rows gives the same answer as a sort."""
    rnd = random.Random(11)
    hot = [rnd.randrange(0, 10**9) for _ in range(20000)]
    rows = [("hot", v) for v in hot] + [(f"g{i}", i) for i in range(50)]
    got = run(spark, rows, {"e": ("exact", 0.9), "c": ("cont", 0.95)})
    assert got["hot"]["e"] == brute_exact(hot, 0.9)
    assert got["hot"]["c"] == brute_cont(hot, 0.95)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(min_value=-(2**40), max_value=2**40), min_size=1, max_size=60), st.sampled_from([0.1, 0.5, 0.9, 0.95, 0.99]))
def test_property_matches_sort(spark, vals, p):
    got = run(spark, [("g", v) for v in vals], {"e": ("exact", p), "c": ("cont", p)})
    assert got["g"]["e"] == brute_exact(vals, p)
    assert got["g"]["c"] == brute_cont(vals, p)


def test_approx_option_is_close(spark):
    rnd = random.Random(9)
    vals = [rnd.randrange(0, 10**6) for _ in range(5000)]
    df = spark.createDataFrame([("g", v) for v in vals], "g string, x long")
    got = group_quantiles(df, ["g"], "x", {"e": ("exact", 0.9), "c": ("cont", 0.5)}, approx=True, accuracy=10000).collect()[0]
    assert abs(got["e"] - brute_exact(vals, 0.9)) <= 10**6 * 0.01
    assert abs(got["c"] - brute_cont(vals, 0.5)) <= 10**6 * 0.01


def test_checks_run_with_approx_quantiles(spark, tables_small, cfg):
    from workload_audit.operators.cluster_health import merge_pressure
    from workload_audit.operators.top_n import by_duration

    assert by_duration(tables_small, cfg.with_(approx_quantiles=True)).count() == by_duration(tables_small, cfg).count()
    assert merge_pressure(tables_small, cfg.with_(approx_quantiles=True)).count() == merge_pressure(tables_small, cfg).count()
