"""Readers for the operational log tables.

Inputs are Parquet datasets (or catalog tables) with the schemas in
:mod:`workload_audit.sources.schemas`. The query log is expected to be
partitioned by ``event_date`` (the archive writes ``event_month`` /
``event_date``), so the day-window predicates of every check prune whole
directories before any file is opened.
"""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, fields, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..streaming import files
from .schemas import DEFAULTS, REQUIRED, SCHEMAS


@dataclass(frozen=True)
class LogTables:
    """The inputs of an audit run; any of them may be missing (None)."""

    query_log: DataFrame | None = None
    part_log: DataFrame | None = None
    parts: DataFrame | None = None
    merges: DataFrame | None = None
    tables: DataFrame | None = None
    asynchronous_metrics: DataFrame | None = None
    settings: DataFrame | None = None
    # Optional: rolled-up days of the query log (streaming.rollup) and the
    # days on which each pattern ran (streaming.presence).
    rollup: Any = None
    presence: DataFrame | None = None

    def require(self, *names: str) -> tuple[DataFrame, ...]:
        missing = [n for n in names if getattr(self, n) is None]
        if missing:
            raise ValueError(f"missing input table(s): {', '.join(missing)}")
        return tuple(getattr(self, n) for n in names)

    def with_(self, **changes) -> "LogTables":
        return replace(self, **changes)


def conform(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the declared columns of table ``name``, in their types. A column that it lacks is NULL, unless the table is nothing
    without it; NULLs become the source's defaults (``DEFAULTS``), so that every check counts such a row alike. Extra columns are
    dropped here; Catalyst prunes further per check."""
    schema, defaults = SCHEMAS[name], DEFAULTS.get(name, {})
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [c for c in REQUIRED[name] if c not in have]
    if missing:
        raise ValueError(f"table {name!r} lacks column(s): {', '.join(missing)}")
    cols = []
    for f in schema.fields:
        value = F.col(f"`{f.name}`") if f.name in have else F.lit(None)
        if have.get(f.name) != f.dataType:
            value = value.cast(f.dataType)
        if f.name in defaults:
            value = F.coalesce(value, F.lit(defaults[f.name]).cast(f.dataType))
        cols.append(value.alias(f.name))
    return df.select(*cols)


def _same_files(spark: SparkSession, source: str) -> list[tuple[T.StructType, list[str]]]:
    """The partition folders of ``source`` by what their files have: (schema, folders). One footer per folder is read, some at a time."""
    folders = [name for name, is_folder in files.children(spark, source) if is_folder and "=" in name and not name.startswith(("_", "."))]
    if not folders:
        return []
    path = lambda name: f"{source.rstrip('/')}/{name}"
    with ThreadPoolExecutor(max_workers=8, thread_name_prefix="audit-schemas") as pool:
        schemas = list(pool.map(lambda name: spark.read.option("basePath", source).parquet(path(name)).schema, folders))
    groups: dict[str, tuple[T.StructType, list[str]]] = {}
    for name, schema in zip(folders, schemas, strict=True):
        groups.setdefault(schema.json(), (schema, []))[1].append(path(name))
    return list(groups.values())


def read_parquet(spark: SparkSession, source: str, name: str) -> DataFrame:
    """One table from a Parquet path whose partitions may differ: an old one may lack a column that later ones have, or have it in a
    narrower type. Partitions with the same files are read together, each kind is made to conform, and their
    union is the table; filters on partition columns still open only the folders that they name."""
    groups = _same_files(spark, source)
    if len(groups) < 2:
        return conform(spark.read.parquet(source), name)
    out = None
    for schema, folders in groups:
        part = conform(spark.read.option("basePath", source).schema(schema).parquet(*folders), name)
        out = part if out is None else out.unionByName(part)
    return out


def read_table(spark: SparkSession, source: str, name: str) -> DataFrame:
    """Read one table from a Parquet path or a catalog table name."""
    if os.sep in source or source.startswith(("file:", "s3", "gs:", "hdfs:", "abfs")):
        return read_parquet(spark, source, name)
    return conform(spark.table(source), name)


def read_log_tables(spark: SparkSession, sources: dict[str, str]) -> LogTables:
    """Build :class:`LogTables` from ``{table name: path or catalog name}``."""
    known = {f.name for f in fields(LogTables)} - {"rollup", "presence"}
    unknown = set(sources) - known
    if unknown:
        raise ValueError(f"unknown table(s): {', '.join(sorted(unknown))}")
    return LogTables(**{n: read_table(spark, s, n) for n, s in sources.items()})
