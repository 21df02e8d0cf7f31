"""Column helpers: formatters, rounding, casts and every ladder boundary."""

import pytest
from workload_audit.functions import columns as C


def one(spark, expr, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr.alias("o")).collect()]


def test_readable_size(spark):
    vals = [0, 1, 1023, 1024, 1024**2 - 1, 1024**2, 4509715660, 1024**5, 1536]
    got = one(spark, C.readable_size("x"), [(v,) for v in vals], "x long")
    assert got == [
        "0.00 B", "1.00 B", "1023.00 B", "1.00 KiB", "1024.00 KiB", "1.00 MiB", "4.20 GiB", "1.00 PiB", "1.50 KiB",
    ]
    assert one(spark, C.readable_size("x"), [(None,)], "x long") == [None]


def test_readable_delta(spark):
    vals = [0, 1, 59, 60, 61, 3600, 86461, 100, 12345, 432546534]
    got = one(spark, C.readable_delta("x"), [(v,) for v in vals], "x long")
    assert got == [
        "0 seconds",
        "1 second",
        "59 seconds",
        "1 minute",
        "1 minute and 1 second",
        "1 hour",
        "1 day, 1 minute and 1 second",
        "1 minute and 40 seconds",
        "3 hours, 25 minutes and 45 seconds",
        "13 years, 8 months, 17 days, 7 hours, 48 minutes and 54 seconds",
    ]


def test_bar(spark):
    rows = [(0, 100), (100, 100), (50, 100), (1, 8), (7, 64), (150, 100)]
    got = one(spark, C.bar("x", "0", "m", 8), rows, "x long, m long")
    assert got == ["", "█" * 8, "█" * 4, "█", "▉", "█" * 8]


def test_round_half_up_and_trunc(spark):
    got = one(spark, C.round_half_up("x", 2), [(1.005,), (2.675,), (0.125,), (-1.5,)], "x double")
    assert got == [1.0, 2.68, 0.13, -1.5]  # 2.675 * 100 is exactly 267.5 in binary
    assert one(spark, C.round_half_up("x", 0), [(2.5,), (3.4999,)], "x double") == [3.0, 3.0]
    assert one(spark, C.trunc_long("x"), [(2.9,), (-2.9,)], "x double") == [2, -2]


def test_to_uint_or_zero(spark):
    got = one(spark, C.to_uint_or_zero("s"), [("202401",), ("2023",), ("all",), ("",), ("-5",), (None,)], "s string")
    assert got == [202401, 2023, 0, 0, 0, 0]


def test_table_reference_helpers(spark):
    rows = [(["db1.`t1`"],), (["plain"],), ([],)]
    df = spark.createDataFrame(rows, "a array<string>")
    out = df.select(
        C.first_element("a").alias("f"),
        C.strip_database("get(a, 0)").alias("t"),
        C.database_of("get(a, 0)").alias("d"),
    ).collect()
    assert [tuple(r) for r in out] == [("db1.`t1`", "t1", "db1"), ("plain", "plain", "plain"), (None, None, None)]


@pytest.mark.parametrize(
    "fn,steps,over",
    [
        (C.insert_duration_bucket, C.INSERT_DURATION_BUCKETS, C.INSERT_DURATION_OVER),
        (C.batch_size_class, C.BATCH_SIZE_CLASSES, C.BATCH_SIZE_OVER),
        (C.merge_duration_class, C.MERGE_DURATION_CLASSES, C.MERGE_DURATION_OVER),
        (C.merge_load_class, C.MERGE_LOAD_CLASSES, C.MERGE_LOAD_OVER),
    ],
)
def test_ladders_at_each_boundary(spark, fn, steps, over):
    xs, want = [], []
    prev_label = None
    for bound, label in steps:
        xs += [bound - 0.5, float(bound)]
        want += [label, None]  # at the bound the next step applies
        prev_label = label
    got = one(spark, fn("x"), [(x,) for x in xs], "x double")
    labels = [l for _, l in steps] + [over]
    for i, (bound, label) in enumerate(steps):
        assert got[2 * i] == label
        assert got[2 * i + 1] == labels[i + 1]
    assert prev_label is not None


def test_frequency_ladders(spark):
    rows = [(None,), (9.9,), (10.0,), (1799.0,), (1800.0,), (3599.0,), (86399.0,), (86400.0,)]
    ins = one(spark, C.insert_frequency_class("x"), rows, "x double")
    mer = one(spark, C.merge_frequency_class("x"), rows, "x double")
    assert ins == ["Rare", "<10s", "<1min", "<30min", "Hourly", "Hourly", "Daily", "Rare"]
    assert mer == ["Rare", "<10s", "<1min", "Hourly", "Hourly", "Hourly", "Daily", "Rare"]


def test_merge_pressure_ladder(spark):
    rows = [
        (9.9, 5.0),  # fast regardless of count
        (20.0, 5.0),  # slow-ish but few merges -> '-'
        (20.0, 1e4),
        (100.0, 1e4),
        (1000.0, 1e4),
        (5000.0, 1e4),
        (9000.0, 1e4),
        (9000.0, 9999.0),
    ]
    got = one(spark, C.merge_pressure_class("p", "n"), rows, "p double, n double")
    assert got == [
        "🔵 FAST",
        "-",
        "🟢 MODERATE",
        "🟡 SLOW",
        "🔴 PAINFUL (2-30 min)",
        "🟣 SEVERE (30-120 min)",
        "🛑 CRITICAL (>= 2 h)",
        "-",
    ]


def test_bar_over_window(spark):
    df = spark.createDataFrame([(1,), (2,), (4,)], "x long")
    got = sorted(r[0] for r in df.select(C.bar("x", "0", "max(x) OVER ()", 4)).collect())
    assert got == ["█", "██", "████"]
