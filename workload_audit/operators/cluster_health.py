"""Table and partition health from the part log and snapshots (C14-C17)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AuditConfig
from ..functions.aggregates import mean_interval_seconds
from ..functions.columns import (
    avg_sql,
    bar,
    batch_size_class,
    database_of,
    first_element,
    from_micros,
    insert_duration_bucket,
    insert_frequency_class,
    merge_duration_class,
    merge_frequency_class,
    merge_load_class,
    merge_pressure_class,
    micros,
    readable_delta,
    round_half_up,
    strip_database,
    lit,
    to_uint_or_zero,
    to_uint_or_zero_sql,
)
from ..functions.predicates import (
    FINISHED,
    INNER_TABLE_REGEX,
    MERGE_PARTS,
    NEW_PART,
    SYSTEM_DATABASE,
    not_inner_table,
)
from ..functions.quantiles import group_quantiles
from ..plans.registry import Bullet, check
from ..sources.logs import LogTables
from .common import top, ts_lit

TABLE_KEY = ["database", "table"]
PART_KEY = ["database", "table", "partition_id", "part_name"]

# --- fixed values -----------------------------------------------------------
SMALL_PART_ROWS = 1000
TINY_PART_ROWS = 100
BAR_WIDTH = 60
UNKNOWN_ENGINE = "UNKNOWN"
# Node memory: metric name, setting name, default when neither is usable.
MEMORY_METRIC = "MemoryTotal"
MEMORY_SETTING = "max_memory_usage"
DEFAULT_NODE_MEMORY = 64_000_000_000
# Oversized-part threshold in MB by node memory: (memory below, MB), else top.
OVERSIZE_STEPS = ((96e9, 1024), (192e9, 2048), (512e9, 4096))
OVERSIZE_TOP_MB = 8192
# Partition health groups below these sums are not reported.
MIN_PARTITION_ROWS = 100_000
MIN_PARTITION_BYTES = 100_000_000
PARTITION_STATUS = {
    "small": "⚪ Small / Metadata (ignored)",
    "historical_busy": "🟠 Historical (still merging / fragmented)",
    "archived": "🟤 Archived / Historical (frozen data)",
    "backlog": "🔴 Merge backlog (too many small parts, no merges)",
    "catch_up_many": "🟠 Catch-up merging (many small parts, merges active)",
    "catch_up_moderate": "🟠 Catch-up merging (moderate fragmentation)",
    "healthy_small": "🟢 Healthy / Small table",
    "healthy_batching": "🟢 Healthy / Efficient batching",
    "large_ok": "🟢 Large but OK (fits node memory)",
    "oversized": "🟡 Oversized (high merge cost)",
    "extreme": "🟥 Extreme oversize (merge tuning needed)",
    "unclassified": "⚫ Unclassified (check logic)",
}
# Report order of statuses by their leading symbol; others rank last.
STATUS_RANK = ("🔴", "🟠", "🟡", "🟥", "🟢", "⚪", "🟤")
# --- end of fixed values ----------------------------------------------------


def oversize_threshold_steps():
    return OVERSIZE_STEPS, OVERSIZE_TOP_MB


def history_bounds(cfg: AuditConfig) -> tuple[int, int]:
    """(yyyyMM of as_of minus two months, yyyy of as_of): monthly/yearly
    partitions older than these are historical."""
    y, m = cfg.as_of.year, cfg.as_of.month - 2
    while m < 1:
        y, m = y - 1, m + 12
    return y * 100 + m, cfg.as_of.year


@check(
    "cluster_health", "insert_part_fragmentation",
    needs=("part_log",), uses_patterns=False,
    headline=("batch_size_class", "insert_frequency_class", "added_parts", "small_parts_pct",),
    bullet=Bullet("{rows} of the listed tables get batches of the smallest class", column="batch_size_class", label="VERY SMALL"),
    advice="Tables with both a small batch class and a high insert frequency create the most parts; mend those first.",
)
def insert_part_fragmentation(tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """Tables creating many small parts from direct inserts.

    Replicas log the same part more than once, so parts are deduplicated by
    their key first (a shuffle on the near-unique part key, which spreads
    evenly); sums, span and exact median per table come from one table of row counts.
    """
    (part_log,) = tables.require("part_log")
    since = cfg.now - dt.timedelta(days=cfg.lookback_days)
    parts = part_log.where(
        (F.col("event_type") == NEW_PART)
        & (F.col("event_time") > ts_lit(since))
        & (F.size("merged_from") == 0)
        & not_inner_table()
    )
    dedup = parts.groupBy(*PART_KEY).agg(F.min("event_time").alias("event_time"), F.max("rows").alias("rows"))
    per = group_quantiles(
        dedup.withColumn("_at", micros("event_time")), TABLE_KEY, "rows", {"p50_rows_per_part": ("exact", 0.5)},
        approx=cfg.approx_quantiles, accuracy=cfg.approx_accuracy, rows="added_parts",
        measures=[
            ("total_rows", "sum", F.col("rows")),
            ("small_parts", "count_if", F.col("rows") < SMALL_PART_ROWS),
            ("_first", "min", F.col("_at")),
            ("_last", "max", F.col("_at")),
        ],
    )
    order = [F.desc("added_parts"), F.asc("database"), F.asc("table")]
    out = (
        top(per, order, cfg.top_n)
        .withColumn("_ivl", mean_interval_seconds(F.col("added_parts"), from_micros("_first"), from_micros("_last")))
        .withColumn("avg_rows_per_part", round_half_up(avg_sql("total_rows", "added_parts"), 0))
        .select(
            "database",
            "table",
            "added_parts",
            "total_rows",
            batch_size_class("avg_rows_per_part").alias("batch_size_class"),
            round_half_up("_ivl", 1).alias("avg_interval_sec"),
            insert_frequency_class("_ivl").alias("insert_frequency_class"),
            "avg_rows_per_part",
            "p50_rows_per_part",
            round_half_up("small_parts * 100 / added_parts", 2).alias("small_parts_pct"),
        )
    )
    return top(out, order, cfg.top_n)


@check(
    "cluster_health", "insert_duration_by_engine",
    needs=("query_log", "tables"), uses_patterns=False,
    headline=("engine", "duration_bucket", "inserts",),
    advice="Compare the shape of the histogram between engines: a long tail in one engine only is that engine's cost.",
)
def insert_duration_by_engine(tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """Insert latency histogram per table engine.

    Inserts are first aggregated per (target database, target table,
    duration bucket) with sums and counts; only that small aggregate is
    joined to the ``tables`` snapshot and re-aggregated per engine, so the
    raw log is never joined and nothing needs a broadcast of unknown size.
    The share/bar windows run over the final (engine x bucket) rows only.
    """
    query_log, table_list = tables.require("query_log", "tables")
    since = cfg.now - dt.timedelta(days=cfg.lookback_days)
    tbl = first_element("tables")
    rows = query_log.where(
        (F.col("type") == FINISHED)
        & (F.col("query_kind") == "Insert")
        & (F.col("event_date") >= F.lit(since.date()))  # implied by event_time; prunes partitions
        & (F.col("event_time") >= ts_lit(since))
        & (F.size("tables") > 0)
        & (F.col("written_rows") > 0)
        & ~tbl.rlike(INNER_TABLE_REGEX)
    )
    target_db = database_of("get(tables, 0)") if cfg.use_table_prefix else F.col("current_database")
    pre = rows.groupBy(
        target_db.alias("_db"),
        strip_database("get(tables, 0)").alias("_tbl"),
        insert_duration_bucket("query_duration_ms").alias("duration_bucket"),
    ).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("query_duration_ms").alias("_ms"),
        F.sum("written_rows").alias("_rows"),
    )
    dims = table_list.select(F.col("database").alias("_db"), F.col("name").alias("_tbl"), "engine")
    buckets = (
        pre.join(dims, ["_db", "_tbl"], "left")
        .groupBy(F.coalesce(F.col("engine"), F.lit(UNKNOWN_ENGINE)).alias("engine"), "duration_bucket")
        .agg(F.sum("_n").alias("inserts"), F.sum("_ms").alias("_ms"), F.sum("_rows").alias("_rows"))
    )
    # The OVER () windows span the final (engine x bucket) rows only.
    avg_s = f"{avg_sql('_ms', 'inserts')} / 1000.0D"
    out = buckets.select(
        "engine",
        "duration_bucket",
        "inserts",
        round_half_up("100.0D * inserts / nullif(CAST(sum(inserts) OVER () AS DOUBLE), 0.0D)", 2).alias("pct"),
        round_half_up(avg_sql("_rows", "inserts"), 1).alias("avg_rows"),
        round_half_up(avg_s, 3).alias("avg_query_s"),
        bar("inserts", "0", "max(inserts) OVER ()", BAR_WIDTH).alias("bar_chart"),
        F.expr(avg_s).alias("_avg_s"),
    )
    return out.orderBy("engine", "_avg_s").drop("_avg_s")


@check(
    "cluster_health", "merge_pressure",
    needs=("part_log",), uses_patterns=False,
    headline=("merge_duration_class", "merge_load_class", "merge_pressure_class", "total_merges",),
    advice="Read the three classes together: long merges with light load are large parts, short ones with heavy load are many parts.",
)
def merge_pressure(tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """Merge duration, load and pressure per table.

    Counts, sums, span and the exact p90 come from one table of duration
    counts, so the log is read once and the self-join of the merges with their
    own per-table span is not needed. Durations are kept in integer
    milliseconds until the end so the sums are exact.
    """
    (part_log,) = tables.require("part_log")
    since = cfg.now - dt.timedelta(days=cfg.lookback_days)
    merges = part_log.where(
        (F.col("event_type") == MERGE_PARTS)
        & (F.col("event_time") >= ts_lit(since))
        & (F.col("event_time") <= ts_lit(cfg.now))
        & not_inner_table()
    )
    positive = F.col("duration_ms") > 0
    per = group_quantiles(
        merges.withColumn("_at", micros("event_time")), TABLE_KEY, "duration_ms", {"_p90_ms": ("exact", 0.9)},
        approx=cfg.approx_quantiles, accuracy=cfg.approx_accuracy, rows="total_merges",
        measures=[
            ("_ms", "sum", F.col("duration_ms")),
            ("_n_pos", "count_if", positive),
            ("_ms_pos", "sum", F.when(positive, F.col("duration_ms"))),
            ("total_parts_merged", "sum", F.size("merged_from")),
            ("total_rows_merged", "sum", F.col("rows")),
            ("_first", "min", F.col("_at")),
            ("_last", "max", F.col("_at")),
        ],
    )
    j = (
        per.withColumns({"first_merge_time": from_micros("_first"), "last_merge_time": from_micros("_last")})
        .withColumn("_p90_s", F.col("_p90_ms").cast("double") / 1000.0)
        .withColumn("_avg_s", F.try_divide(F.col("_ms_pos").cast("double"), F.col("_n_pos").cast("double")) / 1000.0)
        .withColumn(
            "avg_merge_interval_sec",
            mean_interval_seconds(F.col("total_merges"), F.col("first_merge_time"), F.col("last_merge_time")),
        )
    )
    out = j.select(
        "database",
        "table",
        round_half_up("_p90_s", 2).alias("p90_merge_duration_s"),
        round_half_up("_avg_s", 2).alias("avg_merge_duration_s"),
        readable_delta("CAST(_p90_s AS BIGINT)").alias("p90_merge_duration_human"),
        merge_duration_class("_p90_s").alias("merge_duration_class"),
        "total_merges",
        merge_load_class("total_merges").alias("merge_load_class"),
        merge_pressure_class("_p90_s", "total_merges").alias("merge_pressure_class"),
        "total_parts_merged",
        round_half_up(avg_sql("total_parts_merged", "total_merges"), 2).alias("avg_parts_per_merge"),
        "total_rows_merged",
        round_half_up(avg_sql("total_rows_merged", "total_merges"), 0).alias("avg_rows_per_merge"),
        round_half_up("CAST(_ms AS DOUBLE) / 1000.0D / 3600.0D", 2).alias("total_merge_wall_time_h"),
        "avg_merge_interval_sec",
        merge_frequency_class("avg_merge_interval_sec").alias("merge_frequency_class"),
        readable_delta("CAST(_avg_s AS BIGINT)").alias("avg_merge_duration_human"),
        "first_merge_time",
        "last_merge_time",
    )
    order = [
        F.desc("merge_pressure_class"),
        F.desc("total_merges"),
        F.desc("p90_merge_duration_s"),
        F.asc("database"),
        F.asc("table"),
    ]
    return top(out, order, cfg.top_n)


def node_memory(tables: LogTables) -> Column:
    """Node memory in bytes (L8): the memory metric, else the memory
    setting, else a default. Each source is a global aggregate used as a
    scalar subquery (one value, evaluated once), so no join is needed."""
    metrics, settings = tables.require("asynchronous_metrics", "settings")
    from_metric = metrics.agg(
        F.coalesce(F.max(F.when(F.col("metric") == MEMORY_METRIC, F.col("value"))).cast("bigint"), F.lit(0))
    ).scalar()
    from_setting = (
        settings.agg(F.max(F.when(F.col("name") == MEMORY_SETTING, F.col("value"))).alias("_v"))
        .select(to_uint_or_zero("_v"))
        .scalar()
    )
    return (
        F.when(from_metric > 0, from_metric)
        .when(from_setting > 0, from_setting)
        .otherwise(F.lit(DEFAULT_NODE_MEMORY).cast("bigint"))
    )


def with_node_thresholds(df: DataFrame, tables: LogTables) -> DataFrame:
    """Add ``node_ram_gb`` and ``oversized_threshold_mb`` (L8) to every row."""
    steps = " ".join(f"WHEN _node_mem < {lit(float(b))} THEN {mb}" for b, mb in OVERSIZE_STEPS)
    return (
        df.withColumn("_node_mem", node_memory(tables))
        .withColumn("node_ram_gb", round_half_up("_node_mem / 1024 / 1024 / 1024", 2))
        .withColumn("oversized_threshold_mb", F.expr(f"CAST(CASE {steps} ELSE {OVERSIZE_TOP_MB} END AS BIGINT)"))
        .drop("_node_mem")
    )


def node_thresholds(tables: LogTables) -> DataFrame:
    """The node thresholds as one row (for inspection and tests)."""
    spark = tables.require("settings")[0].sparkSession
    return with_node_thresholds(spark.range(1), tables).select("node_ram_gb", "oversized_threshold_mb")


def partition_status(cfg: AuditConfig) -> Column:
    """The ordered status ladder of a partition (L9); first match wins.
    Reads size_gb, avg_part_size_mb, parts_per_gb, active_merges,
    oversized_threshold_mb and partition."""
    month_bound, year_bound = history_bounds(cfg)
    num = to_uint_or_zero_sql("`partition`")
    hist = f"((length(`partition`) = 6 AND {num} < {month_bound}) OR (length(`partition`) = 4 AND {num} < {year_bound}))"
    small = "(avg_part_size_mb < 16 OR parts_per_gb > 300)"
    thr = "oversized_threshold_mb"
    S = {k: lit(v) for k, v in PARTITION_STATUS.items()}
    return F.expr(
        "CASE "
        f"WHEN size_gb < 0.1D THEN {S['small']} "
        f"WHEN {hist} AND (active_merges > 0 OR parts_per_gb > 100) THEN {S['historical_busy']} "
        f"WHEN {hist} AND active_merges = 0 AND parts_per_gb <= 100 THEN {S['archived']} "
        f"WHEN {small} AND active_merges = 0 THEN {S['backlog']} "
        f"WHEN {small} AND active_merges > 0 THEN {S['catch_up_many']} "
        f"WHEN (avg_part_size_mb < 64 OR parts_per_gb > 150) AND active_merges > 0 THEN {S['catch_up_moderate']} "
        f"WHEN avg_part_size_mb BETWEEN 16 AND 32 AND parts_per_gb <= 50 THEN {S['healthy_small']} "
        f"WHEN avg_part_size_mb BETWEEN 32 AND 128 AND parts_per_gb <= 50 THEN {S['healthy_batching']} "
        f"WHEN avg_part_size_mb BETWEEN 128 AND {thr} * 0.8D THEN {S['healthy_batching']} "
        f"WHEN avg_part_size_mb BETWEEN {thr} * 0.8D AND {thr} * 1.5D THEN {S['large_ok']} "
        f"WHEN avg_part_size_mb BETWEEN {thr} * 1.5D AND {thr} * 3 THEN {S['oversized']} "
        f"WHEN avg_part_size_mb > {thr} * 3 THEN {S['extreme']} "
        f"ELSE {S['unclassified']} END"
    )


def status_rank(status: str) -> Column:
    """Report order of a status by its leading symbol (T4)."""
    whens = " ".join(f"WHEN startswith(({status}), {lit(p)}) THEN {i}" for i, p in enumerate(STATUS_RANK, 1))
    return F.expr(f"CASE {whens} ELSE {len(STATUS_RANK) + 1} END")


@check(
    "cluster_health", "partition_health",
    needs=("parts", "merges", "asynchronous_metrics", "settings"), uses_patterns=False,
    headline=("partition_status", "active_parts",),
    advice="The status names the first limit that a partition breaks; statuses with running merges may mend themselves.",
)
def partition_health(tables: LogTables, cfg: AuditConfig) -> DataFrame:
    """Partition fragmentation, merge backlog and oversize per partition.

    Active parts are aggregated per (database, table, partition); active
    merges per table are left-joined (J5); the node thresholds come from
    one-row global aggregates used as scalar subqueries (J6).
    """
    parts, merges = tables.require("parts", "merges")
    live = parts.where(
        F.col("active") & (F.coalesce(F.col("database"), F.lit("")) != SYSTEM_DATABASE) & not_inner_table()
    )
    ps = (
        live.groupBy("database", "table", "partition")
        .agg(
            F.count(F.lit(1)).alias("active_parts"),
            F.sum("rows").alias("_rows"),
            F.sum("bytes_on_disk").alias("_bytes"),
        )
        .where((F.col("_rows") > MIN_PARTITION_ROWS) & (F.col("_bytes") > MIN_PARTITION_BYTES))
    )
    gb = "_bytes / 1024 / 1024 / 1024"
    ps = ps.select(
        "database",
        "table",
        "partition",
        "active_parts",
        round_half_up("_rows / 1e6", 2).alias("total_rows_m"),
        round_half_up(gb, 2).alias("size_gb"),
        round_half_up(f"{avg_sql('_bytes', 'active_parts')} / 1024 / 1024", 2).alias("avg_part_size_mb"),
        round_half_up(f"active_parts / nullif({gb}, 0.0D)", 0).alias("parts_per_gb"),
    )
    activity = merges.groupBy(*TABLE_KEY).agg(F.count(F.lit(1)).alias("_merges"))
    joined = with_node_thresholds(
        ps.join(activity, TABLE_KEY, "left").withColumn(
            "active_merges", F.coalesce(F.col("_merges"), F.lit(0).cast("bigint"))
        ),
        tables,
    )
    out = joined.withColumn("partition_status", partition_status(cfg)).select(
        "database",
        "table",
        "partition",
        "partition_status",
        "total_rows_m",
        "size_gb",
        "active_parts",
        "avg_part_size_mb",
        "parts_per_gb",
        "active_merges",
        "node_ram_gb",
        "oversized_threshold_mb",
    )
    order = [
        status_rank("partition_status"),
        F.desc("parts_per_gb"),
        F.desc("size_gb"),
        F.asc("database"),
        F.asc("table"),
        F.asc("partition"),
    ]
    return top(out, order, cfg.top_n)
