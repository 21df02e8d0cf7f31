"""Operational-log fixture tables derived from the driver's test tables.

The driver's data has no database logs, so the seven log tables are derived
from it by fixed integer rules (FIXTURES.md section 3); the DuckDB oracle
builds the very same rows with SQL (:mod:`workload_audit.oracle`). Every
view is a narrow projection of one scan, so it grows with the input tables.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .logs import LogTables, conform

# --- fixed values of the fixture rules (FIXTURES.md) -----------------------
FIXTURE_NOW = dt.datetime(2024, 1, 31, 0, 0, 0)
LATE_WEEK_START = dt.date(2024, 1, 24)  # patterns shift and slow down from here
PART_LOG_SPAN_SECONDS = 1_209_600  # part events spread over 14 days before FIXTURE_NOW
PARTS_BYTES_PER_ROW = (20, 100, 300, 1000, 6000, 20000)  # by o_custkey % 6
PARTS_PARTITIONS = ("202401", "202310", "2023", "2024", "all")  # by o_orderkey % 5
NODE_MEMORY_TOTAL = 128_000_000_000.0
MAX_MEMORY_USAGE_SETTING = "64000000000"
# --- end of fixed values ---------------------------------------------------


def _s(c: Column) -> Column:
    return c.cast("string")


def _case(expr: Column, mapping: dict, default) -> Column:
    out = None
    for k, v in mapping.items():
        out = (F.when(expr == k, v) if out is None else out.when(expr == k, v))
    return out.otherwise(default)


def query_log_from_events(events: DataFrame) -> DataFrame:
    e = events.select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        # From a generator: the filters of the checks, which read texts made from ``k`` many times over, stay above
        # it and so find ``k`` told once per row; those on days still go down to the scan.
        F.explode(F.array(F.regexp_extract("props", r"([0-9]+)", 1).cast("bigint"))).alias("k"),
        F.col("ts").cast("date").alias("d"),
        F.round(F.col("value") * 100).cast("bigint").alias("v"),
        _case(F.col("event_type"), {"purchase": "Insert", "signup": "Create"}, "Select").alias("kind"),
    )
    late = F.col("d") >= F.lit(LATE_WEEK_START)
    f = e.withColumn(
        "p", F.when((F.col("k") >= 90) & late, F.col("k") % 10 + 100).otherwise(F.col("k") % 10)
    )
    p, v, kind = F.col("p"), F.col("v"), F.col("kind")
    uid = F.col("user_id") % 11
    query = (
        F.when(kind == "Insert", F.concat(F.lit("INSERT INTO db"), _s(p % 3), F.lit(".t"), _s(p), F.lit(" VALUES")))
        .when(kind == "Create", F.concat(F.lit("CREATE TABLE t"), _s(p)))
        .when(p == 7, F.lit("SELECT query FROM system.query_log"))
        .when(p % 3 == 0, F.concat(F.lit("SELECT * FROM t"), _s(p)))
        .when(p % 3 == 1, F.concat(F.lit("SELECT a FROM t"), _s(p), F.lit(" LIMIT 100")))
        .otherwise(F.concat(F.lit("SELECT a FROM t"), _s(p)))
    )
    out = f.select(
        F.col("event_id").alias("query_id"),
        F.col("ts").alias("event_time"),
        F.col("d").alias("event_date"),
        F.when(F.col("event_type") == "error", "ExceptionWhileProcessing").otherwise("QueryFinish").alias("type"),
        F.when(F.col("event_id") % 20 == 0, 0).otherwise(1).alias("is_initial_query"),
        kind.alias("query_kind"),
        F.when(uid == 0, "")
        .when(uid == 1, "monitoring-internal")
        .when(uid == 2, "sql-console")
        .otherwise(F.concat(F.lit("svc_"), _s(uid)))
        .alias("user"),
        (_case(kind, {"Insert": 1, "Create": 2}, 3) * 1000 + p).alias("normalized_query_hash"),
        query.alias("query"),
        (v * F.when(late & p.isin(1, 4), 2).otherwise(1)).alias("query_duration_ms"),
        (v * 1000).alias("read_rows"),
        (v * 40000).alias("read_bytes"),
        F.when(F.col("event_id") % 13 == 0, F.lit(0).cast("bigint"))
        .when(p % 4 == 0, F.lit(1).cast("bigint"))
        .otherwise(v * 100)
        .alias("result_rows"),
        F.when(kind == "Insert", v).otherwise(F.lit(0).cast("bigint")).alias("written_rows"),
        (v * 65536).alias("memory_usage"),
        F.create_map(F.lit("SelectedParts"), F.col("k")).alias("ProfileEvents"),
        F.concat(F.lit("db"), _s(p % 3)).alias("current_database"),
        F.array(F.concat(F.lit("db"), _s(p % 3), F.lit(".`t"), _s(p), F.lit("`"))).alias("tables"),
    )
    return conform(out, "query_log")


def part_log_from_lineitem(lineitem: DataFrame) -> DataFrame:
    sk = F.col("l_suppkey")
    new_part = F.col("l_linestatus") == "F"
    offset = (F.col("l_orderkey") * 37 + F.col("l_linenumber")) % PART_LOG_SPAN_SECONDS
    out = lineitem.select(
        F.concat(F.lit("db"), _s(sk % 3)).alias("database"),
        F.when(sk % 23 == 0, F.concat(F.lit(".inner.t"), _s(sk % 10)))
        .otherwise(F.concat(F.lit("t"), _s(sk % 10)))
        .alias("table"),
        F.lit("202401").alias("partition_id"),
        F.concat(F.lit("p_"), _s(F.col("l_orderkey")), F.lit("_"), _s(F.col("l_linenumber"))).alias("part_name"),
        F.when(new_part, "NewPart").otherwise("MergeParts").alias("event_type"),
        F.timestamp_add("SECOND", -offset, F.lit(FIXTURE_NOW.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")).alias(
            "event_time"
        ),
        (F.col("l_quantity").cast("bigint") * (1 + (sk % 10) * (sk % 10) * 50)).alias("rows"),
        (F.col("l_quantity").cast("bigint") * 100).alias("bytes_uncompressed"),
        (F.round("l_extendedprice").cast("bigint") * (sk % 3 + 1)).alias("duration_ms"),
        F.when(new_part, F.array().cast("array<string>"))
        .otherwise(F.sequence(F.lit(0), F.col("l_linenumber")).cast("array<string>"))
        .alias("merged_from"),
    )
    return conform(out, "part_log")


def parts_from_orders(orders: DataFrame) -> DataFrame:
    rows = F.round("o_totalprice").cast("bigint")
    ck6 = F.col("o_custkey") % 6
    bytes_per_row = _case(ck6, dict(enumerate(PARTS_BYTES_PER_ROW[:-1])), PARTS_BYTES_PER_ROW[-1])
    out = orders.select(
        F.concat(F.lit("db"), _s(F.col("o_custkey") % 3)).alias("database"),
        F.concat(F.lit("t"), _s(ck6)).alias("table"),
        _case(F.col("o_orderkey") % 5, dict(enumerate(PARTS_PARTITIONS[:-1])), PARTS_PARTITIONS[-1]).alias(
            "partition"
        ),
        rows.alias("rows"),
        (rows * bytes_per_row).alias("bytes_on_disk"),
        (F.col("o_orderstatus") != "P").alias("active"),
    )
    return conform(out, "parts")


def tables_from_nation(nation: DataFrame) -> DataFrame:
    n = F.col("n_nationkey")
    out = nation.select(
        F.concat(F.lit("db"), _s(n % 3)).alias("database"),
        F.concat(F.lit("t"), _s(n)).alias("name"),
        F.when(n % 2 == 0, "MergeTree").otherwise("ReplacingMergeTree").alias("engine"),
    )
    return conform(out, "tables")


def merges_from_supplier(supplier: DataFrame) -> DataFrame:
    s = F.col("s_suppkey")
    # two classes of six merge tables that ``parts`` has, the others tables that it has not
    out = supplier.select(
        F.concat(F.lit("db"), _s(s % 3)).alias("database"),
        F.concat(F.when((s % 6).isin(0, 2), "t").otherwise("m"), _s(s % 6)).alias("table"),
    )
    return conform(out, "merges")


def node_metrics(spark: SparkSession, memory_total: float | None = NODE_MEMORY_TOTAL) -> DataFrame:
    rows = [] if memory_total is None else [("MemoryTotal", float(memory_total))]
    return spark.createDataFrame(rows, "metric string, value double")


def node_settings(spark: SparkSession, max_memory_usage: str | None = MAX_MEMORY_USAGE_SETTING) -> DataFrame:
    rows = [] if max_memory_usage is None else [("max_memory_usage", max_memory_usage)]
    return spark.createDataFrame(rows, "name string, value string")


_TABLES: dict[tuple[str, str], LogTables] = {}


def fixture_tables(spark: SparkSession, sf_dir: str) -> LogTables:
    """All seven log tables derived from the driver's Parquet files.

    The table definitions (lazy plans, no data) are made once per session
    and directory, the way a job defines its inputs once and runs many
    queries over them; every query still scans the files when it runs.
    """
    try:
        session_id = spark.sparkContext.applicationId + "/" + str(id(spark._jsparkSession))
    except Exception:  # noqa: BLE001 - sessions without a local JVM handle
        session_id = str(id(spark))
    key = (session_id, os.path.abspath(sf_dir))
    if key not in _TABLES:
        _TABLES[key] = _build_fixture_tables(spark, sf_dir)
    return _TABLES[key]


def _build_fixture_tables(spark: SparkSession, sf_dir: str) -> LogTables:

    def read(name: str) -> DataFrame:
        return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))

    return LogTables(
        query_log=query_log_from_events(read("events")),
        part_log=part_log_from_lineitem(read("lineitem")),
        parts=parts_from_orders(read("orders")),
        merges=merges_from_supplier(read("supplier")),
        tables=tables_from_nation(read("nation")),
        asynchronous_metrics=node_metrics(spark),
        settings=node_settings(spark),
    )
