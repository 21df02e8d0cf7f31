"""Every registered query against its DuckDB oracle, as the driver's gate
does (row count, column names and order-insensitive values)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E

SF_SMALL = "/root/testdata/sf0.001"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# The slow report keys are checked at sf0.001 in a single test below.
REPORT_KEYS = {"report_counts", "report_health_score", "report_key_findings"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=lambda t: tuple(map(str, t)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _compare(spark, duck, key):
    df = E.queries()[key](spark, SF_SMALL)
    scols, srows = _canon(df.columns, [tuple(r) for r in df.collect()])
    res = duck.execute(E.oracle_sql()[key])
    ocols, orows = _canon([d[0] for d in res.description], res.fetchall())
    assert scols == ocols
    assert srows == orows


FAST_KEYS = sorted(k for k in E.oracle_sql() if not k.startswith(("report_", "archive_")))


@pytest.mark.parametrize("key", FAST_KEYS)
def test_query_matches_oracle(spark, duck, key):
    _compare(spark, duck, key)


@pytest.mark.parametrize("key", sorted(REPORT_KEYS | {"report_query_summary", "archive_stream", "archive_retention"}))
def test_report_and_archive_match_oracle(spark, duck, key):
    _compare(spark, duck, key)


def test_every_query_has_a_callable_and_entry_runs(spark):
    qs = E.queries()
    assert len(qs) >= 17
    assert set(E.oracle_sql()) <= set(qs)
    df = E.entry(spark)
    assert df.columns == ["primary_user", "executions", "p50_ms", "p95_ms", "max_ms", "query_text"]
    assert df.count() >= 0
