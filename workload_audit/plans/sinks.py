"""Report sinks (S6, S7): the findings as JSON lines and one CSV dataset per
check, written by the executors (nothing passes through the driver)."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import AuditConfig
from .report import CheckFrames, findings, own_columns, ranked

#: How a NULL is written to CSV, apart from an empty text.
CSV_NULL = "\\N"


def write_json(checks: CheckFrames, path: str, cfg: AuditConfig, generated_at: dt.datetime | None = None) -> None:
    """Two JSON-lines datasets below ``path``. ``checks`` has the report's
    envelope (``generated_at``, ``lookback_days``) and every check with its
    ``columns``, checks without rows included; ``rows`` has one line per
    finding, its values with their types and NULLs."""
    stamp = (generated_at or dt.datetime.now(dt.timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    found = findings(checks)
    spark = found.sparkSession
    listed = [(stamp, cfg.lookback_days, c, n, own_columns(df)) for (c, n), df in sorted(checks.items())]
    schema = "generated_at string, lookback_days int, category string, name string, columns array<string>"
    spark.createDataFrame(listed, schema).write.mode("overwrite").json(os.path.join(path, "checks"))
    head = F.to_json(F.struct("category", "name", "rank"))
    line = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"row":'), F.col("row_json"), F.lit("}"))
    found.select(line.alias("value")).write.mode("overwrite").text(os.path.join(path, "rows"))


def read_json(checks: CheckFrames, spark: SparkSession, path: str) -> dict[tuple[str, str], DataFrame]:
    """The rows of ``write_json`` by check, with the columns and types of ``checks`` and their ``rank``."""
    lines = spark.read.text(os.path.join(path, "rows"))
    out = {}
    for (category, name), df in checks.items():
        schema = T.StructType([T.StructField("category", T.StringType()), T.StructField("name", T.StringType()),
                               T.StructField("rank", T.IntegerType()), T.StructField("row", df.select(own_columns(df)).schema)])
        parsed = lines.select(F.from_json("value", schema).alias("x"))
        out[(category, name)] = parsed.where((F.col("x.category") == category) & (F.col("x.name") == name)).select("x.rank", "x.row.*")
    return out


def write_csv(checks: CheckFrames, root: str) -> dict[str, str]:
    """Each check's rows, their rank first, with a header line to
    ``root/category/name``. Returns the written paths."""
    out = {}
    for (category, name), df in sorted(checks.items()):
        path = os.path.join(root, category, name)
        schema = {f.name: f.dataType.typeName() for f in df.schema.fields}
        nested = lambda c: schema[c] in ("array", "map", "struct")
        own = [F.to_json(F.col(f"`{c}`")).alias(c) if nested(c) else F.col(f"`{c}`") for c in own_columns(df)]
        flat = ranked(df).select("rank", *own)
        flat.write.mode("overwrite").option("header", True).option("nullValue", CSV_NULL).csv(path)
        out[f"{category}/{name}"] = path
    return out
