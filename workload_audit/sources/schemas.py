"""Explicit schemas of the seven operational log / snapshot tables."""

from __future__ import annotations

from pyspark.sql import types as T

QUERY_LOG = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("event_time", T.TimestampNTZType()),
        T.StructField("event_date", T.DateType()),
        T.StructField("type", T.StringType()),
        T.StructField("is_initial_query", T.IntegerType()),
        T.StructField("query_kind", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("normalized_query_hash", T.LongType()),
        T.StructField("query", T.StringType()),
        T.StructField("query_duration_ms", T.LongType()),
        T.StructField("read_rows", T.LongType()),
        T.StructField("read_bytes", T.LongType()),
        T.StructField("result_rows", T.LongType()),
        T.StructField("written_rows", T.LongType()),
        T.StructField("memory_usage", T.LongType()),
        T.StructField("ProfileEvents", T.MapType(T.StringType(), T.LongType())),
        T.StructField("current_database", T.StringType()),
        T.StructField("tables", T.ArrayType(T.StringType())),
    ]
)

PART_LOG = T.StructType(
    [
        T.StructField("database", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("partition_id", T.StringType()),
        T.StructField("part_name", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("event_time", T.TimestampNTZType()),
        T.StructField("rows", T.LongType()),
        T.StructField("bytes_uncompressed", T.LongType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("merged_from", T.ArrayType(T.StringType())),
    ]
)

PARTS = T.StructType(
    [
        T.StructField("database", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("partition", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("bytes_on_disk", T.LongType()),
        T.StructField("active", T.BooleanType()),
    ]
)

MERGES = T.StructType([T.StructField("database", T.StringType()), T.StructField("table", T.StringType())])

TABLES = T.StructType(
    [
        T.StructField("database", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("engine", T.StringType()),
    ]
)

ASYNC_METRICS = T.StructType([T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType())])

SETTINGS = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])

SCHEMAS: dict[str, T.StructType] = {
    "query_log": QUERY_LOG,
    "part_log": PART_LOG,
    "parts": PARTS,
    "merges": MERGES,
    "tables": TABLES,
    "asynchronous_metrics": ASYNC_METRICS,
    "settings": SETTINGS,
}

# What a NULL (or a column that a file does not have) stands for: the source's
# own default. Columns that the checks only compare for equality, or as more
# than some positive number, keep their NULLs, which fail those tests as the
# default would; so their predicates reach the files.
DEFAULTS: dict[str, dict[str, object]] = {
    "query_log": {
        "normalized_query_hash": 0,
        "query": "",
        "user": "",
        "query_duration_ms": 0,
        "read_rows": 0,
        "read_bytes": 0,
        "written_rows": 0,
        "memory_usage": 0,
    },
    "part_log": {"database": "", "table": "", "partition_id": "", "part_name": "", "rows": 0, "bytes_uncompressed": 0, "duration_ms": 0},
    "parts": {"database": "", "table": "", "partition": "", "rows": 0, "bytes_on_disk": 0},
    "merges": {"database": "", "table": ""},
    "tables": {"database": "", "name": ""},
}
# Columns without which a table is not what it is said to be.
REQUIRED: dict[str, tuple[str, ...]] = {
    "query_log": ("event_time", "event_date", "type", "query_kind", "user", "normalized_query_hash", "query"),
    "part_log": ("database", "table", "part_name", "event_type", "event_time"),
    "parts": ("database", "table", "partition", "active"),
    "merges": ("database", "table"),
    "tables": ("database", "name", "engine"),
    "asynchronous_metrics": ("metric", "value"),
    "settings": ("name", "value"),
}
