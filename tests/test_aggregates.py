"""Two-phase pattern aggregate: primary user, ties, '' user, measures."""

from collections import Counter

from pyspark.sql import functions as F

from workload_audit.functions.aggregates import mean_interval_seconds, pattern_stats


def test_primary_user_ties_and_system(spark):
    rows = [
        (1, "b", "q2", 10), (1, "a", "q1", 20), (1, "b", "q3", 5), (1, "a", "q0", 1),  # tie a/b -> a
        (2, "", "x", 3), (2, "", "y", 3), (2, "z", "y", 3),  # '' wins -> <system>
        (3, "<system>", "s", 1),  # a literal <system> user stays
    ]
    df = spark.createDataFrame(rows, "h long, user string, query string, v long")
    out = {
        r["h"]: r
        for r in pattern_stats(df, ["h"], [("s", "sum", F.col("v")), ("m", "max", F.col("v"))]).collect()
    }
    assert out[1]["primary_user"] == "a" and out[1]["executions"] == 4
    assert out[1]["s"] == 36 and out[1]["m"] == 20 and out[1]["query_text"] == "q0"
    assert out[2]["primary_user"] == "<system>"
    assert out[3]["primary_user"] == "<system>"


def test_pattern_stats_matches_brute_force(spark):
    import random

    rnd = random.Random(5)
    rows = [(rnd.randrange(5), rnd.choice("abcd"), f"q{rnd.randrange(9)}", rnd.randrange(100)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "h long, user string, query string, v long").repartition(7)
    got = {r["h"]: r for r in pattern_stats(df, ["h"], [("s", "sum", F.col("v"))]).collect()}
    for h in range(5):
        mine = [r for r in rows if r[0] == h]
        c = Counter(r[1] for r in mine)
        best = min(c.items(), key=lambda kv: (-kv[1], kv[0]))[0]
        assert got[h]["primary_user"] == best
        assert got[h]["executions"] == len(mine)
        assert got[h]["s"] == sum(r[3] for r in mine)
        assert got[h]["query_text"] == min(r[2] for r in mine)


def test_mean_interval(spark):
    import datetime as dt

    rows = [(1, dt.datetime(2024, 1, 1, 0, 0, 0), dt.datetime(2024, 1, 1, 0, 0, 0)), (4, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 1, 0))]
    df = spark.createDataFrame(rows, "n long, a timestamp_ntz, b timestamp_ntz")
    got = [r[0] for r in df.select(mean_interval_seconds(F.col("n"), F.col("a"), F.col("b"))).collect()]
    assert got == [None, 20.0]
