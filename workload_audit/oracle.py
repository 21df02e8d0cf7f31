"""DuckDB oracle SQL for every registered query.

Each string starts with the fixture views of FIXTURES.md as CTEs over the
driver's tables, then states the check the way the source system's SQL
does (join forms, window forms, ``quantile_cont``, sorted-list exact
quantiles, row_number for the most frequent user), so the Spark plans -
which use single-pass, two-phase and rank-select forms instead - are checked
against an independent formulation.

Float conventions shared with the Spark side: means of integer columns are
``sum / count`` (exact sums), rounding is ``floor(x * 10^d + 0.5) / 10^d``,
ties in ``LIMIT`` are broken by the group key, ``query_text`` is the
smallest text of the group.
"""

from __future__ import annotations

import datetime as dt

from .config import SYSTEM_USER_LABEL, AuditConfig, fixture_config
from .functions import columns as C
from .functions import predicates as P

# ---------------------------------------------------------------------------
# Fixture views (FIXTURES.md section 3, DuckDB spelling)
# ---------------------------------------------------------------------------

FIXTURE_CTES = """
ql_e AS (SELECT event_id, ts, user_id, event_type, CAST(regexp_extract(props,'([0-9]+)',1) AS bigint) AS k,
 CAST(ts AS date) AS d, CAST(round(value*100) AS bigint) AS v,
 CASE event_type WHEN 'purchase' THEN 'Insert' WHEN 'signup' THEN 'Create' ELSE 'Select' END AS kind FROM events),
ql_f AS (SELECT *, CASE WHEN k>=90 AND d>=DATE '2024-01-24' THEN k%10+100 ELSE k%10 END AS p FROM ql_e),
query_log AS (SELECT event_id AS query_id, ts AS event_time, d AS event_date,
 CASE WHEN event_type='error' THEN 'ExceptionWhileProcessing' ELSE 'QueryFinish' END AS type,
 CASE WHEN event_id%20=0 THEN 0 ELSE 1 END AS is_initial_query, kind AS query_kind,
 CASE user_id%11 WHEN 0 THEN '' WHEN 1 THEN 'monitoring-internal' WHEN 2 THEN 'sql-console' ELSE concat('svc_',CAST(user_id%11 AS varchar)) END AS "user",
 (CASE kind WHEN 'Insert' THEN 1 WHEN 'Create' THEN 2 ELSE 3 END)*1000+p AS normalized_query_hash,
 CASE WHEN kind='Insert' THEN concat('INSERT INTO db',CAST(p%3 AS varchar),'.t',CAST(p AS varchar),' VALUES')
  WHEN kind='Create' THEN concat('CREATE TABLE t',CAST(p AS varchar))
  WHEN p=7 THEN 'SELECT query FROM system.query_log' WHEN p%3=0 THEN concat('SELECT * FROM t',CAST(p AS varchar))
  WHEN p%3=1 THEN concat('SELECT a FROM t',CAST(p AS varchar),' LIMIT 100') ELSE concat('SELECT a FROM t',CAST(p AS varchar)) END AS query,
 v*(CASE WHEN d>=DATE '2024-01-24' AND p IN (1,4) THEN 2 ELSE 1 END) AS query_duration_ms,
 v*1000 AS read_rows, v*40000 AS read_bytes,
 CASE WHEN event_id%13=0 THEN 0 WHEN p%4=0 THEN 1 ELSE v*100 END AS result_rows,
 CASE WHEN kind='Insert' THEN v ELSE 0 END AS written_rows, v*65536 AS memory_usage,
 MAP {'SelectedParts': k} AS ProfileEvents, concat('db',CAST(p%3 AS varchar)) AS current_database,
 [concat('db',CAST(p%3 AS varchar),'.`t',CAST(p AS varchar),'`')] AS tables FROM ql_f),
part_log AS (SELECT concat('db',CAST(l_suppkey%3 AS varchar)) AS database,
 CASE WHEN l_suppkey%23=0 THEN concat('.inner.t',CAST(l_suppkey%10 AS varchar)) ELSE concat('t',CAST(l_suppkey%10 AS varchar)) END AS "table", '202401' AS partition_id,
 concat('p_',CAST(l_orderkey AS varchar),'_',CAST(l_linenumber AS varchar)) AS part_name,
 CASE WHEN l_linestatus='F' THEN 'NewPart' ELSE 'MergeParts' END AS event_type,
 TIMESTAMP '2024-01-31 00:00:00' - ((l_orderkey*37+l_linenumber)%1209600) * INTERVAL '1' SECOND AS event_time,
 CAST(l_quantity AS bigint)*(1+(l_suppkey%10)*(l_suppkey%10)*50) AS "rows",
 CAST(l_quantity AS bigint)*100 AS bytes_uncompressed,
 CAST(round(l_extendedprice) AS bigint)*(l_suppkey%3+1) AS duration_ms,
 CASE WHEN l_linestatus='F' THEN [] ELSE [CAST(x AS varchar) for x in range(l_linenumber+1)] END AS merged_from FROM lineitem),
parts AS (SELECT concat('db',CAST(o_custkey%3 AS varchar)) AS database, concat('t',CAST(o_custkey%6 AS varchar)) AS "table",
 CASE o_orderkey%5 WHEN 0 THEN '202401' WHEN 1 THEN '202310' WHEN 2 THEN '2023' WHEN 3 THEN '2024' ELSE 'all' END AS "partition",
 CAST(round(o_totalprice) AS bigint) AS "rows",
 CAST(round(o_totalprice) AS bigint)*(CASE o_custkey%6 WHEN 0 THEN 20 WHEN 1 THEN 100 WHEN 2 THEN 300 WHEN 3 THEN 1000 WHEN 4 THEN 6000 ELSE 20000 END) AS bytes_on_disk,
 o_orderstatus<>'P' AS active FROM orders),
tables_ AS (SELECT concat('db',CAST(n_nationkey%3 AS varchar)) AS database, concat('t',CAST(n_nationkey AS varchar)) AS name,
 CASE WHEN n_nationkey%2=0 THEN 'MergeTree' ELSE 'ReplacingMergeTree' END AS engine FROM nation),
merges AS (SELECT concat('db',CAST(s_suppkey%3 AS varchar)) AS database,
 concat(CASE WHEN s_suppkey%6 IN (0,2) THEN 't' ELSE 'm' END,CAST(s_suppkey%6 AS varchar)) AS "table"
 FROM supplier),
asynchronous_metrics AS (SELECT 'MemoryTotal' AS metric, CAST(128000000000 AS double) AS value),
settings AS (SELECT 'max_memory_usage' AS name, '64000000000' AS value)
""".strip()


# ---------------------------------------------------------------------------
# SQL spellings of the column helpers
# ---------------------------------------------------------------------------


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def dbl(x: str) -> str:
    return f"CAST(({x}) AS DOUBLE)"


def rnd(x: str, digits: int = 0) -> str:
    scale = 10**digits
    return f"(floor({dbl(x)} * {scale} + 0.5) / {scale})"


def trunc(x: str) -> str:
    return f"CAST(trunc({dbl(x)}) AS BIGINT)"


def readable_size(x: str) -> str:
    v = dbl(x)
    idx = "CASE " + " ".join(f"WHEN abs({v}) >= {float(1024**k)!r} THEN {k}" for k in range(len(C.SIZE_UNITS) - 1, 0, -1))
    idx += " ELSE 0 END"
    cents = f"CAST(floor({v} / pow(1024.0, {idx}) * 100 + 0.5) AS BIGINT)"
    units = "[" + ", ".join(q(u) for u in C.SIZE_UNITS) + "]"
    return (
        f"CASE WHEN {v} IS NULL THEN NULL ELSE concat(CASE WHEN {cents} < 0 THEN '-' ELSE '' END, "
        f"CAST(abs({cents}) // 100 AS VARCHAR), '.', lpad(CAST(abs({cents}) % 100 AS VARCHAR), 2, '0'), ' ', "
        f"{units}[{idx} + 1]) END"
    )


def readable_delta(x: str) -> str:
    s = f"CAST(({x}) AS BIGINT)"
    parts = []
    rem = s
    for size, name in C.DELTA_UNITS:
        n = f"(({rem}) // {size})"
        parts.append(f"CASE WHEN {n} > 0 THEN concat(CAST({n} AS VARCHAR), ' {name}', CASE WHEN {n} <> 1 THEN 's' ELSE '' END) END")
        rem = f"(({rem}) % {size})"
    lst = "list_filter([" + ", ".join(parts) + "], lambda e: e IS NOT NULL)"
    return (
        f"(SELECT CASE WHEN {s} IS NULL THEN NULL WHEN len(l) = 0 THEN '0 seconds' WHEN len(l) = 1 THEN l[1] "
        f"ELSE concat(array_to_string(l[1:len(l) - 1], ', '), ' and ', l[len(l)]) END FROM (SELECT {lst} AS l))"
    )


def bar(x: str, lo: str, hi: str, width: int) -> str:
    w = (
        f"(CASE WHEN ({x}) <= ({lo}) THEN 0.0 WHEN ({x}) >= ({hi}) THEN {float(width)} "
        f"ELSE {dbl(f'({x}) - ({lo})')} * {width} / {dbl(f'({hi}) - ({lo})')} END)"
    )
    eighths = f"CAST(floor(({w} - floor({w})) * 8) AS BIGINT)"
    chars = "[" + ", ".join(q(c) for c in C.BAR_EIGHTHS) + "]"
    return (
        f"concat(repeat({q(C.BAR_FULL)}, CAST(floor({w}) AS BIGINT)), "
        f"coalesce(CASE WHEN {eighths} > 0 THEN {chars}[{eighths}] END, ''))"
    )


def ladder(x: str, steps, default: str) -> str:
    return "CASE " + " ".join(f"WHEN ({x}) < {b!r} THEN {q(l)}" for b, l in steps) + f" ELSE {q(default)} END"


def exact_quantile(x: str, p: float) -> str:
    r = f"(CAST(floor({float(p)!r}::DOUBLE * count(*)) AS BIGINT))" if p < 1 else "(count(*) - 1)"
    return f"list_sort(list({x}))[{r} + 1]"


def system_user(u: str) -> str:
    return f"CASE WHEN {u} = '' THEN {q(SYSTEM_USER_LABEL)} ELSE {u} END"


def date_lit(d: dt.date) -> str:
    return f"DATE '{d.isoformat()}'"


def ts_lit(t: dt.datetime) -> str:
    return f"TIMESTAMP '{t.strftime('%Y-%m-%d %H:%M:%S')}'"


# ---------------------------------------------------------------------------
# Shared population pieces
# ---------------------------------------------------------------------------


def user_clause(cfg: AuditConfig) -> str:
    ex = cfg.excluded_users
    return "" if not ex else 'AND "user" NOT IN (' + ", ".join(q(u) for u in ex) + ")"


def base_where(cfg: AuditConfig, since_days: int, until_days: int | None = None, types=(P.FINISHED,)) -> str:
    parts = [f"event_date >= {date_lit(cfg.today - dt.timedelta(days=since_days))}"]
    if until_days is not None:
        parts.append(f"event_date < {date_lit(cfg.today - dt.timedelta(days=until_days))}")
    parts.append("is_initial_query = 1")
    parts.append("type IN (" + ", ".join(q(t) for t in types) + ")")
    parts.append(f"query NOT LIKE {q(P.SELF_QUERY_PATTERN)}")
    return " AND ".join(parts) + " " + user_clause(cfg)


def primary_user_cte(name: str, pop: str) -> str:
    """Most frequent user per pattern, ties to the smallest user."""
    return (
        f"{name} AS (SELECT h, {system_user('u')} AS primary_user FROM ("
        f"SELECT h, u, row_number() OVER (PARTITION BY h ORDER BY c DESC, u) AS rn FROM ("
        f'SELECT normalized_query_hash AS h, "user" AS u, count(*) AS c FROM {pop} GROUP BY 1, 2)) WHERE rn = 1)'
    )


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join([FIXTURE_CTES, *ctes]) + "\n"


# ---------------------------------------------------------------------------
# The checks
# ---------------------------------------------------------------------------


def _pattern_check(cfg: AuditConfig, extra_where: str, aggs: str, select: str, having: str, order: str) -> str:
    pop = f"pop AS (SELECT * FROM query_log WHERE {base_where(cfg, cfg.lookback_days)} {extra_where})"
    agg = (
        f"agg AS (SELECT normalized_query_hash AS h, count(*) AS executions, min(query) AS query_text, {aggs} "
        f"FROM pop GROUP BY 1)"
    )
    sql = with_(pop, primary_user_cte("pu", "pop"), agg)
    sql += f"SELECT {select} FROM agg JOIN pu USING (h)"
    if having:
        sql += f" WHERE {having}"
    sql += f" ORDER BY {order}, h LIMIT {cfg.top_n}"
    return sql


def avg_sql(col: str) -> str:
    return f"(sum({col}) / count(*))"


def by_memory(cfg: AuditConfig) -> str:
    return _pattern_check(
        cfg,
        "AND query_kind = 'Select'",
        "max(memory_usage) AS max_mem, quantile_cont(memory_usage, 0.95) AS p95",
        f"primary_user, executions, {readable_size('max_mem')} AS peak_memory, {readable_size('p95')} AS p95_memory, query_text",
        "",
        "max_mem DESC",
    )


def by_read_bytes(cfg: AuditConfig) -> str:
    return _pattern_check(
        cfg,
        "AND query_kind = 'Select'",
        f"sum(read_bytes) AS s, {avg_sql('read_bytes')} AS a",
        f"primary_user, executions, {readable_size('s')} AS total_read, {readable_size('a')} AS avg_read, query_text",
        "",
        "s DESC",
    )


def by_duration(cfg: AuditConfig) -> str:
    return _pattern_check(
        cfg,
        "AND query_kind = 'Select'",
        f"{trunc('quantile_cont(query_duration_ms, 0.5)')} AS p50_ms, {trunc('quantile_cont(query_duration_ms, 0.95)')} AS p95_ms, "
        "max(query_duration_ms) AS max_ms",
        "primary_user, executions, p50_ms, p95_ms, max_ms, query_text",
        "",
        "p95_ms DESC",
    )


def by_weighted_cost(cfg: AuditConfig) -> str:
    return _pattern_check(
        cfg,
        "AND query_kind <> 'Insert'",
        f"{avg_sql('read_bytes')} AS a, {dbl('count(*)')} * {avg_sql('read_bytes')} AS cost",
        f"primary_user, executions, {readable_size('a')} AS avg_read, {readable_size('cost')} AS weighted_cost, query_text",
        "",
        "cost DESC",
    )


def wow_duration_regressions(cfg: AuditConfig) -> str:
    n = cfg.lookback_days
    factor = 1 + cfg.regression_threshold_pct / 100.0

    def week(name: str, since: int, until: int | None) -> list[str]:
        pop = f"{name}_pop AS (SELECT * FROM query_log WHERE {base_where(cfg, since, until)} AND query_kind <> 'Insert')"
        agg = (
            f"{name} AS (SELECT normalized_query_hash AS h, min(query) AS query_text, "
            f"{trunc('quantile_cont(query_duration_ms, 0.95)')} AS p95_ms, {trunc(avg_sql('read_bytes'))} AS avg_bytes "
            f"FROM {name}_pop GROUP BY 1 HAVING count(*) >= {cfg.min_executions})"
        )
        return [pop, agg]

    sql = with_(*week("tw", n, None), primary_user_cte("pu", "tw_pop"), *week("lw", 2 * n, n))
    pct = rnd("(tw.p95_ms - lw.p95_ms) / NULLIF(lw.p95_ms, 0) * 100", 2)
    bpct = rnd("(tw.avg_bytes - lw.avg_bytes) / NULLIF(lw.avg_bytes, 0) * 100", 2)
    sql += (
        f"SELECT pu.primary_user, lw.p95_ms AS prev_p95_ms, tw.p95_ms AS curr_p95_ms, {pct} AS duration_change_pct, "
        f"{readable_size('lw.avg_bytes')} AS prev_avg_read, {readable_size('tw.avg_bytes')} AS curr_avg_read, "
        f"{bpct} AS bytes_change_pct, tw.query_text "
        f"FROM tw JOIN lw ON tw.h = lw.h JOIN pu ON pu.h = tw.h "
        f"WHERE tw.p95_ms > lw.p95_ms * {factor!r}::DOUBLE "
        f"ORDER BY duration_change_pct DESC NULLS FIRST, tw.h LIMIT {cfg.top_n}"
    )
    return sql


def new_expensive_patterns(cfg: AuditConfig) -> str:
    n = cfg.lookback_days
    pop = f"pop AS (SELECT * FROM query_log WHERE {base_where(cfg, n)} AND query_kind <> 'Insert')"
    tw = (
        "tw AS (SELECT normalized_query_hash AS h, min(query) AS query_text, count(*) AS executions, "
        f"{trunc(avg_sql('query_duration_ms'))} AS avg_duration_ms, {trunc(avg_sql('read_bytes'))} AS avg_read_bytes, "
        f"{avg_sql('read_bytes')} AS avg_read_raw FROM pop GROUP BY 1 "
        f"HAVING {trunc(avg_sql('read_bytes'))} > 100000000 OR {trunc(avg_sql('query_duration_ms'))} > 10000)"
    )
    bl = (
        "bl AS (SELECT DISTINCT normalized_query_hash AS h FROM query_log "
        f"WHERE {base_where(cfg, 4 * n, n)} AND query_kind <> 'Insert')"
    )
    sql = with_(pop, primary_user_cte("pu", "pop"), tw, bl)
    sql += (
        f"SELECT pu.primary_user, executions, avg_duration_ms, {readable_size('avg_read_raw')} AS avg_read, query_text "
        "FROM tw JOIN pu USING (h) WHERE NOT EXISTS (SELECT 1 FROM bl WHERE bl.h = tw.h) "
        f"ORDER BY avg_read_bytes DESC, h LIMIT {cfg.top_n}"
    )
    return sql


def by_user(cfg: AuditConfig) -> str:
    pop = f"pop AS (SELECT * FROM query_log WHERE {base_where(cfg, cfg.lookback_days, types=(P.FINISHED, P.FAILED))})"
    err = f"count(*) FILTER (WHERE type = {q(P.FAILED)})"
    sql = with_(pop)
    sql += (
        f'SELECT {system_user(chr(34) + "user" + chr(34))} AS "user", count(*) AS total_queries, '
        f"{readable_size('sum(read_bytes)')} AS total_read, "
        f"{rnd('sum(query_duration_ms) / 1000 / 3600', 2)} AS total_hours, {err} AS errors, "
        f"{rnd(f'{err} / count(*) * 100', 2)} AS error_rate_pct "
        "FROM pop GROUP BY 1 ORDER BY sum(read_bytes) DESC"
    )
    return sql


def full_scans(cfg: AuditConfig) -> str:
    ratio = rnd("arr / ares", 2)
    return _pattern_check(
        cfg,
        "AND query_kind = 'Select' AND result_rows > 0",
        f"{avg_sql('read_rows')} AS arr, {avg_sql('result_rows')} AS ares, {avg_sql('read_bytes')} AS ab",
        f"primary_user, executions, {trunc('arr')} AS avg_read_rows, {trunc('ares')} AS avg_result_rows, "
        f"{ratio} AS scan_ratio, {readable_size('ab')} AS avg_read, query_text",
        f"{ratio} > {float(cfg.scan_ratio_threshold)!r}",
        "executions * arr DESC",
    )


def select_star_wide_tables(cfg: AuditConfig) -> str:
    return _pattern_check(
        cfg,
        f"AND query_kind = 'Select' AND regexp_matches(query, {q(P.SELECT_STAR_REGEX)})",
        f"{avg_sql('read_bytes')} AS ab",
        f"primary_user, executions, {readable_size('ab')} AS avg_read, query_text",
        "",
        "executions DESC",
    )


def missing_partition_filter(cfg: AuditConfig) -> str:
    sp = "coalesce(ProfileEvents['SelectedParts'], 0)"
    return _pattern_check(
        cfg,
        f"AND query_kind = 'Select' AND {sp} > {cfg.min_parts_threshold}",
        f"{trunc(avg_sql(sp))} AS avg_selected_parts, {avg_sql('read_rows')} AS arr, {avg_sql('read_bytes')} AS ab",
        f"primary_user, executions, avg_selected_parts, {trunc('arr')} AS avg_read_rows, {readable_size('ab')} AS avg_read, query_text",
        "",
        "avg_selected_parts * executions DESC",
    )


def unbounded_results(cfg: AuditConfig) -> str:
    return _pattern_check(
        cfg,
        f"AND query_kind = 'Select' AND result_rows > {cfg.max_result_rows} AND NOT regexp_matches(query, {q(P.LIMIT_REGEX)})",
        f"{trunc(avg_sql('result_rows'))} AS avg_result_rows, max(result_rows) AS max_result_rows, {avg_sql('read_bytes')} AS ab",
        f"primary_user, executions, avg_result_rows, max_result_rows, {readable_size('ab')} AS avg_read, query_text",
        "",
        "avg_result_rows DESC",
    )


def repeated_identical(cfg: AuditConfig) -> str:
    per_hour = rnd(f"executions / {cfg.lookback_days} / 24", 2)
    return _pattern_check(
        cfg,
        f"AND query NOT ILIKE {q(P.INSERT_TEXT_PREFIX)}",
        f"{avg_sql('read_bytes')} AS ab",
        f"primary_user, executions AS total_executions, {per_hour} AS avg_per_hour, {readable_size('ab')} AS avg_read, query_text",
        f"{per_hour} > {float(cfg.repeat_threshold)!r}",
        "executions DESC",
    )


def small_insert_batches(cfg: AuditConfig) -> str:
    return _pattern_check(
        cfg,
        f"AND query_kind = 'Insert' AND written_rows < {cfg.min_batch_size}",
        f"{trunc(avg_sql('written_rows'))} AS avg_written_rows, CAST(sum(written_rows) AS BIGINT) AS total_written_rows",
        "primary_user, executions, avg_written_rows, total_written_rows, query_text",
        "",
        "executions DESC",
    )


def _not_inner(col: str = '"table"') -> str:
    return " AND ".join(f"{col} NOT LIKE {q(p)}" for p in P.INNER_TABLE_PATTERNS)


def insert_part_fragmentation(cfg: AuditConfig) -> str:
    since = cfg.now - dt.timedelta(days=cfg.lookback_days)
    base = (
        'base AS (SELECT database, "table", partition_id, part_name, event_time, "rows" FROM part_log '
        f"WHERE event_type = {q(P.NEW_PART)} AND event_time > {ts_lit(since)} AND len(merged_from) = 0 AND {_not_inner()})"
    )
    dedup = (
        'dedup AS (SELECT database, "table", partition_id, part_name, min(event_time) AS event_time, max("rows") AS "rows" '
        'FROM base GROUP BY database, "table", partition_id, part_name)'
    )
    per = (
        'per AS (SELECT database, "table", count(*) AS added_parts, CAST(sum("rows") AS BIGINT) AS total_rows, '
        f"{rnd(avg_sql(chr(34) + 'rows' + chr(34)), 0)} AS avg_rows_per_part, {exact_quantile(chr(34) + 'rows' + chr(34), 0.5)} AS p50_rows_per_part, "
        f"{rnd('100 * count(*) FILTER (WHERE ' + chr(34) + 'rows' + chr(34) + ' < 1000) / count(*)', 2)} AS small_parts_pct, "
        "CASE WHEN count(*) > 1 THEN CAST(date_diff('second', min(event_time), max(event_time)) AS DOUBLE) / (count(*) - 1) END "
        'AS ivl FROM dedup GROUP BY database, "table")'
    )
    sql = with_(base, dedup, per)
    sql += (
        f'SELECT database, "table", added_parts, total_rows, {ladder("avg_rows_per_part", C.BATCH_SIZE_CLASSES, C.BATCH_SIZE_OVER)} '
        f"AS batch_size_class, {rnd('ivl', 1)} AS avg_interval_sec, "
        f"{ladder('coalesce(ivl, 1e12)', C.INSERT_FREQUENCY_CLASSES, C.FREQUENCY_OVER)} AS insert_frequency_class, "
        "avg_rows_per_part, p50_rows_per_part, small_parts_pct "
        f'FROM per ORDER BY added_parts DESC, database, "table" LIMIT {cfg.top_n}'
    )
    return sql


def insert_duration_by_engine(cfg: AuditConfig) -> str:
    since = cfg.now - dt.timedelta(days=cfg.lookback_days)
    target_db = "coalesce(replace(split_part(tables[1], '.', 1), '`', ''), '')" if cfg.use_table_prefix else "current_database"
    qrows = (
        "q AS (SELECT query_duration_ms, written_rows, tables[1] AS tbl, "
        f"{target_db} AS target_db, "
        "replace(substring(tables[1], position('.' IN tables[1]) + 1), '`', '') AS target_table "
        f"FROM query_log WHERE type = {q(P.FINISHED)} AND query_kind = 'Insert' AND event_time >= {ts_lit(since)} "
        f"AND len(tables) > 0 AND written_rows > 0 AND NOT regexp_matches(tables[1], {q(P.INNER_TABLE_REGEX)}))"
    )
    buckets = (
        f"b AS (SELECT t.engine, {ladder('q.query_duration_ms', C.INSERT_DURATION_BUCKETS, C.INSERT_DURATION_OVER)} AS duration_bucket, "
        "count(*) AS inserts, sum(q.query_duration_ms) / count(*) / 1000.0::DOUBLE AS avg_duration_s, "
        "sum(q.written_rows) / count(*) AS avg_rows_per_insert "
        "FROM q LEFT JOIN tables_ t ON t.database = q.target_db AND t.name = q.target_table GROUP BY t.engine, duration_bucket)"
    )
    sql = with_(qrows, buckets)
    pct = rnd("100.0::DOUBLE * inserts / NULLIF(CAST(sum(inserts) OVER () AS DOUBLE), 0)", 2)
    sql += (
        f"SELECT coalesce(engine, 'UNKNOWN') AS engine, duration_bucket, inserts, {pct} AS pct, "
        f"{rnd('avg_rows_per_insert', 1)} AS avg_rows, {rnd('avg_duration_s', 3)} AS avg_query_s, "
        f"{bar('inserts', '0', 'max(inserts) OVER ()', 60)} AS bar_chart FROM b ORDER BY engine, avg_duration_s"
    )
    return sql


def merge_pressure(cfg: AuditConfig) -> str:
    since = cfg.now - dt.timedelta(days=cfg.lookback_days)
    m = (
        'm AS (SELECT database, "table", event_time, duration_ms, len(merged_from) AS input_parts, "rows" AS out_rows '
        f"FROM part_log WHERE event_type = {q(P.MERGE_PARTS)} AND event_time >= {ts_lit(since)} "
        f"AND event_time <= {ts_lit(cfg.now)} AND {_not_inner()})"
    )
    span = (
        's AS (SELECT database, "table", CASE WHEN count(*) > 1 THEN '
        "CAST(date_diff('second', min(event_time), max(event_time)) AS DOUBLE) / (count(*) - 1) END AS avg_merge_interval_sec "
        'FROM m GROUP BY database, "table")'
    )
    p90 = f"({dbl(exact_quantile('m.duration_ms', 0.9))} / 1000.0::DOUBLE)"
    avg_pos = "(sum(m.duration_ms) FILTER (WHERE m.duration_ms > 0) / count(*) FILTER (WHERE m.duration_ms > 0) / 1000.0::DOUBLE)"
    g = (
        f'g AS (SELECT m.database, m."table", {p90} AS p90, {avg_pos} AS avg_pos, count(*) AS total_merges, '
        "CAST(sum(m.input_parts) AS BIGINT) AS total_parts_merged, sum(m.input_parts) / count(*) AS avg_parts, "
        "CAST(sum(m.out_rows) AS BIGINT) AS total_rows_merged, sum(m.out_rows) / count(*) AS avg_rows, "
        "sum(m.duration_ms) / 1000.0::DOUBLE / 3600.0::DOUBLE AS wall_h, s.avg_merge_interval_sec, "
        "min(m.event_time) AS first_merge_time, max(m.event_time) AS last_merge_time "
        'FROM m JOIN s ON m.database = s.database AND m."table" = s."table" '
        'GROUP BY m.database, m."table", s.avg_merge_interval_sec)'
    )
    pressure = "CASE WHEN p90 < 10 THEN " + q(C.PRESSURE_FAST[1]) + " "
    pressure += " ".join(f"WHEN p90 < {b} AND total_merges >= 1e4 THEN {q(l)}" for b, l in C.PRESSURE_CLASSES)
    pressure += f" WHEN total_merges >= 1e4 THEN {q(C.PRESSURE_CRITICAL)} ELSE {q(C.PRESSURE_NONE)} END"
    sql = with_(m, span, g)
    sql += (
        f'SELECT database, "table", {rnd("p90", 2)} AS p90_merge_duration_s, {rnd("avg_pos", 2)} AS avg_merge_duration_s, '
        f"{readable_delta(trunc('p90'))} AS p90_merge_duration_human, "
        f"{ladder('p90', C.MERGE_DURATION_CLASSES, C.MERGE_DURATION_OVER)} AS merge_duration_class, total_merges, "
        f"{ladder('total_merges', C.MERGE_LOAD_CLASSES, C.MERGE_LOAD_OVER)} AS merge_load_class, "
        f"{pressure} AS merge_pressure_class, total_parts_merged, {rnd('avg_parts', 2)} AS avg_parts_per_merge, "
        f"total_rows_merged, {rnd('avg_rows', 0)} AS avg_rows_per_merge, {rnd('wall_h', 2)} AS total_merge_wall_time_h, "
        "avg_merge_interval_sec, "
        f"{ladder('coalesce(avg_merge_interval_sec, 1e12)', C.MERGE_FREQUENCY_CLASSES, C.FREQUENCY_OVER)} AS merge_frequency_class, "
        f"{readable_delta(trunc('avg_pos'))} AS avg_merge_duration_human, first_merge_time, last_merge_time "
        "FROM g ORDER BY merge_pressure_class DESC, total_merges DESC, p90_merge_duration_s DESC, database, \"table\" "
        f"LIMIT {cfg.top_n}"
    )
    return sql


def partition_health(cfg: AuditConfig) -> str:
    ctes, status, rank = _partition_status_sql(cfg)
    ps = (
        'ps AS (SELECT database, "table", "partition", count(*) AS active_parts, '
        f"{rnd('sum(\"rows\") / 1e6', 2)} AS total_rows_m, "
        f"{rnd('sum(bytes_on_disk) / 1024 / 1024 / 1024', 2)} AS size_gb, "
        f"{rnd('sum(bytes_on_disk) / count(*) / 1024 / 1024', 2)} AS avg_part_size_mb, "
        f"{rnd('count(*) / NULLIF(sum(bytes_on_disk) / 1024 / 1024 / 1024, 0)', 0)} AS parts_per_gb "
        f"FROM parts WHERE active AND database NOT IN ('system') AND {_not_inner()} "
        'GROUP BY database, "table", "partition" HAVING sum("rows") > 100000 AND sum(bytes_on_disk) > 100000000)'
    )
    sql = with_(*ctes, ps)
    sql += (
        "SELECT * FROM ("
        f'SELECT ps.database, ps."table", ps."partition", {status} AS partition_status, ps.total_rows_m, ps.size_gb, '
        "ps.active_parts, ps.avg_part_size_mb, ps.parts_per_gb, coalesce(ma.active_merges, 0) AS active_merges, "
        "t.node_ram_gb, t.oversized_threshold_mb "
        'FROM ps LEFT JOIN ma ON ps.database = ma.database AND ps."table" = ma."table" CROSS JOIN thr t) x '
        f'ORDER BY {rank}, parts_per_gb DESC, size_gb DESC, database, "table", "partition" LIMIT {cfg.top_n}'
    )
    return sql


CHECK_SQL = {
    "top_n/by_memory": by_memory,
    "top_n/by_read_bytes": by_read_bytes,
    "top_n/by_duration": by_duration,
    "top_n/by_weighted_cost": by_weighted_cost,
    "anomalies/wow_duration_regressions": wow_duration_regressions,
    "anomalies/new_expensive_patterns": new_expensive_patterns,
    "cost_attribution/by_user": by_user,
    "anti_patterns/full_scans": full_scans,
    "anti_patterns/select_star_wide_tables": select_star_wide_tables,
    "anti_patterns/missing_partition_filter": missing_partition_filter,
    "anti_patterns/unbounded_results": unbounded_results,
    "anti_patterns/repeated_identical": repeated_identical,
    "anti_patterns/small_insert_batches": small_insert_batches,
    "cluster_health/insert_part_fragmentation": insert_part_fragmentation,
    "cluster_health/insert_duration_by_engine": insert_duration_by_engine,
    "cluster_health/merge_pressure": merge_pressure,
    "cluster_health/partition_health": partition_health,
}


def check_sql(cfg: AuditConfig | None = None) -> dict[str, str]:
    cfg = cfg or fixture_config()
    return {k: f(cfg) for k, f in CHECK_SQL.items()}


# ---------------------------------------------------------------------------
# Stand-alone operator queries
# ---------------------------------------------------------------------------


def op_anti_join(cfg: AuditConfig) -> str:
    n = cfg.lookback_days
    cur = f"cur AS (SELECT normalized_query_hash, count(*) AS executions FROM query_log WHERE {base_where(cfg, n)} AND query_kind <> 'Insert' GROUP BY 1)"
    bl = f"bl AS (SELECT normalized_query_hash FROM query_log WHERE {base_where(cfg, 4 * n, n)} AND query_kind <> 'Insert')"
    return with_(cur, bl) + "SELECT * FROM cur WHERE normalized_query_hash NOT IN (SELECT normalized_query_hash FROM bl)"


def op_quantile_exact(cfg: AuditConfig) -> str:
    return with_() + (
        f'SELECT database, "table", count(*) AS merges, {exact_quantile("duration_ms", 0.5)} AS p50_ms, '
        f'{exact_quantile("duration_ms", 0.9)} AS p90_ms, {exact_quantile("duration_ms", 1.0)} AS max_ms '
        f"FROM part_log WHERE event_type = {q(P.MERGE_PARTS)} GROUP BY database, \"table\""
    )


def cont_quantile(x: str, p: float) -> str:
    """Linear interpolation between the sorted elements at ranks floor/ceil
    of p * (n - 1), spelled out (DuckDB's own quantile_cont can differ in
    the last bit of the interpolation)."""
    pos = f"(({float(p)!r})::DOUBLE * (count(*) - 1))"
    lo = f"CAST(list_sort(list({x}))[CAST(floor({pos}) AS BIGINT) + 1] AS DOUBLE)"
    hi = f"CAST(list_sort(list({x}))[CAST(ceil({pos}) AS BIGINT) + 1] AS DOUBLE)"
    return f"({lo} + ({hi} - {lo}) * ({pos} - floor({pos})))"


def op_quantile_cont(cfg: AuditConfig) -> str:
    return with_() + (
        f"SELECT normalized_query_hash, {cont_quantile('query_duration_ms', 0.5)} AS p50, "
        f"{cont_quantile('query_duration_ms', 0.95)} AS p95, {cont_quantile('query_duration_ms', 0.99)} AS p99 "
        "FROM query_log GROUP BY 1"
    )


def op_primary_user(cfg: AuditConfig) -> str:
    return with_(primary_user_cte("pu", "query_log")) + (
        "SELECT normalized_query_hash, pu.primary_user, count(*) AS executions, min(query) AS query_text "
        "FROM query_log JOIN pu ON pu.h = normalized_query_hash GROUP BY normalized_query_hash, pu.primary_user"
    )


def op_interval_mean(cfg: AuditConfig) -> str:
    return with_() + (
        'SELECT database, "table", count(*) AS parts, CASE WHEN count(*) > 1 THEN '
        "CAST(date_diff('second', min(event_time), max(event_time)) AS DOUBLE) / (count(*) - 1) END AS avg_interval_sec "
        f"FROM part_log WHERE event_type = {q(P.NEW_PART)} GROUP BY database, \"table\""
    )


def op_part_dedup(cfg: AuditConfig) -> str:
    d = (
        'd AS (SELECT database, "table", partition_id, part_name, min(event_time) AS event_time, max("rows") AS "rows", '
        f"count(*) AS copies FROM part_log WHERE event_type = {q(P.NEW_PART)} GROUP BY ALL)"
    )
    return with_(d) + (
        'SELECT database, "table", count(*) AS parts, CAST(sum(copies) AS BIGINT) AS logged, '
        'CAST(sum("rows") AS BIGINT) AS "rows", min(event_time) AS first_part FROM d GROUP BY database, "table"'
    )


def op_share_of_total(cfg: AuditConfig) -> str:
    pct = rnd("100.0::DOUBLE * executions / NULLIF(CAST(sum(executions) OVER () AS DOUBLE), 0)", 2)
    per = "per AS (SELECT query_kind, count(*) AS executions FROM query_log GROUP BY 1)"
    return with_(per) + (
        f"SELECT query_kind, executions, {pct} AS pct, {bar('executions', '0', 'max(executions) OVER ()', 30)} AS bar_chart FROM per"
    )


def op_readable_size(cfg: AuditConfig) -> str:
    per = (
        "per AS (SELECT normalized_query_hash, sum(read_bytes) AS s, count(*) AS n, max(memory_usage) AS m, "
        "min(read_bytes) AS lo FROM query_log GROUP BY 1)"
    )
    return with_(per) + (
        f"SELECT normalized_query_hash, {readable_size('s')} AS total_read, {readable_size('s / n')} AS avg_read, "
        f"{readable_size('m')} AS peak_memory, {readable_size('lo')} AS min_read FROM per"
    )


def op_readable_delta(cfg: AuditConfig) -> str:
    per = (
        'per AS (SELECT database, "table", max(duration_ms) AS d, '
        "date_diff('second', min(event_time), max(event_time)) AS span FROM part_log GROUP BY database, \"table\")"
    )
    return with_(per) + (
        f'SELECT database, "table", {readable_delta(trunc("d / 1000.0"))} AS longest_merge, '
        f"{readable_delta('span')} AS span FROM per"
    )


def op_bar(cfg: AuditConfig) -> str:
    per = 'per AS (SELECT "user", count(*) AS executions FROM query_log GROUP BY 1)'
    return with_(per) + f'SELECT "user", executions, {bar("executions", "0", "max(executions) OVER ()", 60)} AS bar_chart FROM per'


def _partition_status_sql(cfg: AuditConfig) -> tuple[list[str], str, str]:
    """CTEs (mem, thr, ma) plus the status CASE and the rank CASE over ps/ma/t."""
    from .operators.cluster_health import PARTITION_STATUS, STATUS_RANK, history_bounds, oversize_threshold_steps

    month_bound, year_bound = history_bounds(cfg)
    mem = (
        "mem AS (SELECT CASE WHEN a > 0 THEN a WHEN b > 0 THEN b ELSE 64000000000 END AS total FROM "
        "(SELECT coalesce(CAST(trunc(max(value) FILTER (WHERE metric = 'MemoryTotal')) AS BIGINT), 0) AS a FROM asynchronous_metrics) "
        "CROSS JOIN (SELECT coalesce(CASE WHEN regexp_full_match(v, '[0-9]+') THEN TRY_CAST(v AS BIGINT) END, 0) AS b FROM "
        "(SELECT max(value) FILTER (WHERE name = 'max_memory_usage') AS v FROM settings)))"
    )
    steps, top_mb = oversize_threshold_steps()
    thr = (
        f"thr AS (SELECT {rnd('total / 1024 / 1024 / 1024', 2)} AS node_ram_gb, "
        "CAST(CASE " + " ".join(f"WHEN total < {b!r} THEN {mb}" for b, mb in steps)
        + f" ELSE {top_mb} END AS BIGINT) AS oversized_threshold_mb FROM mem)"
    )
    ma = 'ma AS (SELECT database, "table", count(*) AS active_merges FROM merges GROUP BY database, "table")'
    num = "coalesce(CASE WHEN regexp_full_match(ps.\"partition\", '[0-9]+') THEN TRY_CAST(ps.\"partition\" AS BIGINT) END, 0)"
    hist = (
        f"((length(ps.\"partition\") = 6 AND {num} < {month_bound}) OR (length(ps.\"partition\") = 4 AND {num} < {year_bound}))"
    )
    am = "coalesce(ma.active_merges, 0)"
    S = PARTITION_STATUS
    status = (
        "CASE "
        f"WHEN ps.size_gb < 0.1 THEN {q(S['small'])} "
        f"WHEN {hist} AND ({am} > 0 OR ps.parts_per_gb > 100) THEN {q(S['historical_busy'])} "
        f"WHEN {hist} AND {am} = 0 AND ps.parts_per_gb <= 100 THEN {q(S['archived'])} "
        f"WHEN (ps.avg_part_size_mb < 16 OR ps.parts_per_gb > 300) AND {am} = 0 THEN {q(S['backlog'])} "
        f"WHEN (ps.avg_part_size_mb < 16 OR ps.parts_per_gb > 300) AND {am} > 0 THEN {q(S['catch_up_many'])} "
        f"WHEN (ps.avg_part_size_mb < 64 OR ps.parts_per_gb > 150) AND {am} > 0 THEN {q(S['catch_up_moderate'])} "
        f"WHEN ps.avg_part_size_mb BETWEEN 16 AND 32 AND ps.parts_per_gb <= 50 THEN {q(S['healthy_small'])} "
        f"WHEN ps.avg_part_size_mb BETWEEN 32 AND 128 AND ps.parts_per_gb <= 50 THEN {q(S['healthy_batching'])} "
        f"WHEN ps.avg_part_size_mb BETWEEN 128 AND t.oversized_threshold_mb * 0.8 THEN {q(S['healthy_batching'])} "
        f"WHEN ps.avg_part_size_mb BETWEEN t.oversized_threshold_mb * 0.8 AND t.oversized_threshold_mb * 1.5 THEN {q(S['large_ok'])} "
        f"WHEN ps.avg_part_size_mb BETWEEN t.oversized_threshold_mb * 1.5 AND t.oversized_threshold_mb * 3 THEN {q(S['oversized'])} "
        f"WHEN ps.avg_part_size_mb > t.oversized_threshold_mb * 3 THEN {q(S['extreme'])} "
        f"ELSE {q(S['unclassified'])} END"
    )
    rank = "CASE " + " ".join(f"WHEN partition_status LIKE {q(p + '%')} THEN {i}" for i, p in enumerate(STATUS_RANK, 1))
    rank += f" ELSE {len(STATUS_RANK) + 1} END"
    return [mem, thr, ma], status, rank


def op_insert_targets(cfg: AuditConfig) -> str:
    inner = "[concat(current_database, CASE WHEN query_id % 2 = 0 THEN '.`.inner.t1`' ELSE '.`.tmp.inner.t1`' END)]"
    named = f"ql_t AS (SELECT * REPLACE (CASE WHEN query_id % 5 = 0 THEN [] WHEN query_id % 7 = 0 THEN {inner} ELSE tables END AS tables) FROM query_log)"
    return insert_duration_by_engine(cfg).replace("FROM query_log", "FROM ql_t").replace("\nq AS (", f"\n{named},\nq AS (", 1)


def op_status_rank(cfg: AuditConfig) -> str:
    ctes, status, rank = _partition_status_sql(cfg)
    ps = (
        'ps AS (SELECT database, "table", "partition", '
        f"{rnd('sum(bytes_on_disk) / 1024 / 1024 / 1024', 2)} AS size_gb, "
        f"{rnd('sum(bytes_on_disk) / count(*) / 1024 / 1024', 2)} AS avg_part_size_mb, "
        f"{rnd('count(*) / NULLIF(sum(bytes_on_disk) / 1024 / 1024 / 1024, 0)', 0)} AS parts_per_gb "
        'FROM parts WHERE active GROUP BY database, "table", "partition")'
    )
    return with_(*ctes, ps) + (
        f"SELECT database, \"table\", \"partition\", partition_status, {rank} AS status_rank FROM ("
        f'SELECT ps.database, ps."table", ps."partition", {status} AS partition_status '
        'FROM ps LEFT JOIN ma ON ps.database = ma.database AND ps."table" = ma."table" CROSS JOIN thr t)'
    )


OPERATOR_SQL = {
    "op_insert_targets": op_insert_targets,
    "op_anti_join": op_anti_join,
    "op_quantile_exact": op_quantile_exact,
    "op_quantile_cont": op_quantile_cont,
    "op_primary_user": op_primary_user,
    "op_interval_mean": op_interval_mean,
    "op_part_dedup": op_part_dedup,
    "op_share_of_total": op_share_of_total,
    "op_readable_size": op_readable_size,
    "op_readable_delta": op_readable_delta,
    "op_bar": op_bar,
    "op_status_rank": op_status_rank,
}


def operator_sql(cfg: AuditConfig | None = None) -> dict[str, str]:
    cfg = cfg or fixture_config()
    return {k: f(cfg) for k, f in OPERATOR_SQL.items()}


# ---------------------------------------------------------------------------
# Report and archive queries
# ---------------------------------------------------------------------------


def _per_check(cfg: AuditConfig, body: str, only=None) -> str:
    """UNION ALL over the checks (or those whose key ``only`` accepts) of ``body`` formatted with {cat}, {name},
    {desc} and {sql} (the check's own SQL as a subquery)."""
    from .plans.registry import select_checks

    described = {(s.category, s.name): s.description for s in select_checks()}
    parts = []
    for key, fn in CHECK_SQL.items():
        cat, name = key.split("/")
        if only is not None and not only(key):
            continue
        parts.append(body.format(cat=q(cat), name=q(name), desc=q(described[(cat, name)]), sql=fn(cfg)))
    return "\nUNION ALL\n".join(f"({p})" for p in parts)


def _severity_case(j: str) -> tuple[str, str, str]:
    from .plans.report import SEVERITY_MAP

    sev = "CASE " + " ".join(f"WHEN contains({j}, {q(k)}) THEN {q(lv)}" for k, lv, _ in SEVERITY_MAP) + " END"
    lab = "CASE " + " ".join(f"WHEN contains({j}, {q(k)}) THEN {q(lb)}" for k, _, lb in SEVERITY_MAP) + " END"
    crit = "(" + " OR ".join(f"contains({j}, {q(k)})" for k, lv, _ in SEVERITY_MAP if lv == "critical") + ")"
    return sev, lab, crit


def report_counts(cfg: AuditConfig) -> str:
    return _per_check(
        cfg, "SELECT {cat} AS category, {name} AS name, {desc} AS description, CAST(count(*) AS BIGINT) AS \"rows\" FROM ({sql}) x"
    )


# A value as text: doubles with six decimals, all else as cast.
_TEXT = "CASE WHEN typeof({c}) IN ('DOUBLE', 'FLOAT') THEN CAST(TRY_CAST({c} AS DECIMAL(38,6)) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"
_VALUES = (
    'SELECT {cat} AS category, {name} AS name, CAST("$rank" AS INTEGER) AS rank, "column", value FROM ('
    "SELECT \"$rank\", "
    + _TEXT.replace("{c}", "COLUMNS(* EXCLUDE \"$rank\")")
    + " FROM (SELECT row_number() OVER () AS \"$rank\", x.* FROM ({sql}) x)) "
    'UNPIVOT INCLUDE NULLS (value FOR "column" IN (COLUMNS(* EXCLUDE "$rank")))'
)


def report_findings(cfg: AuditConfig) -> str:
    return _per_check(cfg, _VALUES)


def report_severity(cfg: AuditConfig) -> str:
    sev, lab, _ = _severity_case("value")
    return (
        f"SELECT *, {sev} AS severity, {lab} AS severity_label, coalesce({sev} = 'critical', false) AS is_critical "
        f"FROM ({report_findings(cfg)}) v WHERE regexp_matches(\"column\", '_class$|^partition_status$')"
    )


def report_preview(cfg: AuditConfig) -> str:
    from .plans.report import PREVIEW_ROWS

    return (
        f'SELECT v.category, v.name, v.rank, v."column", v.value, CAST(greatest(c."rows" - {PREVIEW_ROWS}, 0) AS BIGINT) AS more '
        f"FROM ({report_findings(cfg)}) v JOIN ({report_counts(cfg)}) c ON c.category = v.category AND c.name = v.name WHERE v.rank <= {PREVIEW_ROWS}"
    )


def report_metric_lines(cfg: AuditConfig) -> str:
    from .plans.registry import select_checks
    from .plans.report import SUBJECT_COLUMNS

    headlines = {(s.category, s.name): s.headline for s in select_checks()}
    wanted = ", ".join(f"({q(c)}, {q(n)}, {q(h)}, {k})" for (c, n), hs in headlines.items() for k, h in enumerate(hs))
    subjects = ", ".join(f"({q(c)}, {k})" for k, c in enumerate(SUBJECT_COLUMNS))
    return (
        f"WITH v AS MATERIALIZED ({report_findings(cfg)}), "
        f's AS (SELECT category, name, rank, string_agg(coalesce(value, \'-\'), \'.\' ORDER BY k) AS subject FROM v JOIN (VALUES {subjects}) t(c, k) ON v."column" = t.c GROUP BY ALL), '
        f"m AS (SELECT v.category, v.name, rank, string_agg(concat(v.\"column\", '=', coalesce(value, '-')), ', ' ORDER BY k) AS metrics "
        f'FROM v JOIN (VALUES {wanted}) h(category, name, c, k) ON v.category = h.category AND v.name = h.name AND v."column" = h.c GROUP BY ALL) '
        "SELECT m.category, m.name, m.rank, concat(coalesce(subject || ': ', ''), metrics) AS line "
        "FROM m LEFT JOIN s ON s.category = m.category AND s.name = m.name AND s.rank = m.rank"
    )


def _check_stats(cfg: AuditConfig) -> str:
    return (
        f'SELECT c.category, c.name, c."rows" AS n, coalesce(max(CAST(v.is_critical AS INTEGER)), 0) AS c FROM ({report_counts(cfg)}) c '
        f"LEFT JOIN ({report_severity(cfg)}) v ON v.category = c.category AND v.name = c.name GROUP BY ALL"
    )


def report_health_score(cfg: AuditConfig) -> str:
    from .plans import report as R

    weight = "CASE " + " ".join(f"WHEN category = {q(c)} THEN {w}" for c, w in R.CATEGORY_WEIGHTS) + " ELSE 1 END"
    tenths = (
        f"CASE WHEN n = 0 THEN 0 WHEN c = 1 THEN {R.ISSUE_TENTHS_CRITICAL} "
        f"WHEN category IN ('anomalies', 'anti_patterns') THEN {R.ISSUE_TENTHS_PATTERNS} ELSE {R.ISSUE_TENTHS_OTHER} END"
    )
    score = (
        f"CAST(CASE WHEN total = 0 THEN {R.UNKNOWN_SCORE} ELSE least(greatest(floor(100.0::DOUBLE - "
        f"CAST(issue10 * {R.SCORE_SPAN // 10} AS DOUBLE) / CAST(total AS DOUBLE)), 0), 100) END AS INTEGER)"
    )
    return (
        f"WITH per AS ({_check_stats(cfg)}), agg AS (SELECT sum({weight}) AS total, sum(({weight}) * ({tenths})) AS issue10 FROM per), "
        f"s AS (SELECT total, {score} AS score FROM agg) "
        f"SELECT score, CASE WHEN total = 0 THEN 'Unknown' WHEN score >= {R.HEALTHY_FROM} THEN 'Healthy' "
        f"WHEN score >= {R.ATTENTION_FROM} THEN 'Needs Attention' ELSE 'Critical' END AS label, "
        f"CASE WHEN total = 0 THEN 'info' WHEN score >= {R.HEALTHY_FROM} THEN 'ok' "
        f"WHEN score >= {R.ATTENTION_FROM} THEN 'warning' ELSE 'critical' END AS level FROM s"
    )


def report_key_findings(cfg: AuditConfig) -> str:
    def patterns(name: str, text: str) -> str:
        return f"SELECT concat({text}, ': ', n, ' patterns') FROM (SELECT count(*) AS n FROM ({CHECK_SQL[name](cfg)}) x) WHERE n > 0"

    wow = f"(SELECT count(*) AS n FROM ({wow_duration_regressions(cfg)}) x)"
    frag = f"(SELECT count(*) AS n FROM ({insert_part_fragmentation(cfg)}) x WHERE batch_size_class LIKE '%VERY SMALL%')"
    lines = {
        "anomalies/new_expensive_patterns": patterns("anomalies/new_expensive_patterns", "'expensive and not seen in the three periods before'"),
        "anomalies/wow_duration_regressions": f"SELECT CASE WHEN n > 0 THEN concat('p95 up by over {cfg.regression_threshold_pct:g} % on the period before: ', n, ' patterns') "
        f"ELSE 'p95 steady against the period before' END FROM {wow}",
        "anti_patterns/full_scans": patterns("anti_patterns/full_scans", f"'over {cfg.scan_ratio_threshold:g} rows read for each one returned'"),
        "anti_patterns/missing_partition_filter": patterns("anti_patterns/missing_partition_filter", f"'over {cfg.min_parts_threshold:g} parts read by a run'"),
        "anti_patterns/repeated_identical": patterns("anti_patterns/repeated_identical", f"'over {cfg.repeat_threshold:g} runs an hour'"),
        "anti_patterns/select_star_wide_tables": patterns("anti_patterns/select_star_wide_tables", "'SELECT * without a column list'"),
        "anti_patterns/small_insert_batches": patterns("anti_patterns/small_insert_batches", f"'under {cfg.min_batch_size:g} rows written by an insert'"),
        "anti_patterns/unbounded_results": patterns("anti_patterns/unbounded_results", f"'over {cfg.max_result_rows:g} rows returned without a limit'"),
        "cluster_health/insert_part_fragmentation": f"SELECT concat(n, ' of the listed tables get batches of the smallest class') FROM {frag} WHERE n > 0",
        "cost_attribution/by_user": f'SELECT concat("user", \' read the most in {cfg.lookback_days:g} days: \', total_read) FROM (SELECT row_number() OVER () AS k, x.* FROM ({by_user(cfg)}) x) WHERE k = 1',
    }
    order = sorted(CHECK_SQL)
    return " UNION ALL ".join(f"(SELECT {order.index(key) + 1} AS ord, text FROM ({sql}) t(text))" for key, sql in lines.items())


def report_query_summary(cfg: AuditConfig) -> str:
    from .plans import report as R

    per = "per AS (SELECT normalized_query_hash, min(query) AS q0 FROM query_log GROUP BY 1)"
    s = "s AS (SELECT normalized_query_hash, regexp_replace(q0, '^\\s+|\\s+$', '', 'g') AS t FROM per)"
    ins = f"regexp_extract(t, {q(R.INSERT_TARGET_REGEX)}, 1)"
    frm = f"regexp_replace(regexp_extract(t, {q(R.FROM_TABLE_REGEX)}, 1), '^\\(+|\\(+$', '', 'g')"
    return with_(per, s) + (
        f"SELECT normalized_query_hash, CASE WHEN {ins} <> '' THEN concat({ins}, ' ...') "
        f"WHEN regexp_matches(t, {q(R.FROM_TABLE_REGEX)}) THEN concat(substring(split_part(t, chr(10), 1), 1, {R.SUMMARY_FIRST_LINE_CHARS}), '... FROM ', {frm}) "
        f"ELSE concat(replace(substring(t, 1, {R.SUMMARY_MAX_CHARS}), chr(10), ' '), CASE WHEN length(t) > {R.SUMMARY_MAX_CHARS} THEN '...' ELSE '' END) END "
        "AS summary FROM s"
    )


def report_recommendations(cfg: AuditConfig) -> str:
    from .plans import report as R
    from .plans.registry import select_checks

    related = dict(R.RELATED_CHECKS)
    values = ", ".join(
        f"({q(s.category)}, {q(s.name)}, {q(s.advice)}, "
        + ("[" + ", ".join(q(x) for x in related.get((s.category, s.name), ())) + "]::VARCHAR[]")
        + ")"
        for s in select_checks()
    )
    return (
        f"SELECT c.category, c.name, c.\"rows\", a.recommendation, array_to_string(a.related, ', ') AS related FROM ({report_counts(cfg)}) c "
        f"LEFT JOIN (VALUES {values}) a(category, name, recommendation, related) "
        "ON a.category = c.category AND a.name = c.name WHERE c.\"rows\" > 0"
    )


def _archive_summary(where: str) -> str:
    return with_() + (
        "SELECT event_date, count(*) AS \"rows\", CAST(sum(query_id) AS BIGINT) AS sum_query_id, "
        "CAST(sum(normalized_query_hash) AS BIGINT) AS sum_hash, min(event_time) AS first_event, "
        f"max(event_time) AS last_event FROM query_log {where} GROUP BY event_date"
    )


def archive_backfill(cfg: AuditConfig) -> str:
    from .plans.queries import ARCHIVE_CUTOFF

    return _archive_summary(f"WHERE event_time < {ts_lit(ARCHIVE_CUTOFF)}")


def archive_stream(cfg: AuditConfig) -> str:
    return _archive_summary("")


def archive_retention(cfg: AuditConfig) -> str:
    from .plans.queries import ARCHIVE_RETENTION_DAYS

    return _archive_summary(f"WHERE event_date > {date_lit(cfg.today - dt.timedelta(days=ARCHIVE_RETENTION_DAYS))}")


#: Checks that rank query patterns, and those that read other tables or no patterns.
_OTHERS = ("cluster_health/",)


def rollup_checks(cfg: AuditConfig) -> str:
    return _per_check(cfg, _VALUES, lambda key: not key.startswith(_OTHERS))


def archive_checks(cfg: AuditConfig) -> str:
    return _per_check(cfg, _VALUES, lambda key: not key.startswith(_OTHERS) or key.endswith("insert_duration_by_engine"))


def selected_checks(cfg: AuditConfig) -> str:
    return _per_check(cfg, _VALUES, lambda key: key.startswith(("anti_patterns/", "cost_attribution/")))


def run_outcomes(cfg: AuditConfig) -> str:
    failed, late = ("insert_part_fragmentation", "merge_pressure"), "by_memory"
    states = f"CASE WHEN name IN {failed} THEN 'failed' WHEN name = '{late}' THEN 'timed out' ELSE 'done' END"
    return f'SELECT category, name, {states} AS state, CASE WHEN {states} = \'done\' THEN "rows" ELSE 0 END AS "rows" FROM ({report_counts(cfg)}) c'


REPORT_SQL = {
    "rollup_checks": rollup_checks,
    "presence_new_patterns": new_expensive_patterns,
    "reader_checks": report_findings,
    "archive_checks": archive_checks,
    "archive_compact": archive_stream,
    "archive_rerun": archive_stream,
    "selected_checks": selected_checks,
    "run_outcomes": run_outcomes,
    "report_counts": report_counts,
    "report_severity": report_severity,
    "report_preview": report_preview,
    "report_findings": report_findings,
    "report_metric_lines": report_metric_lines,
    "report_health_score": report_health_score,
    "report_key_findings": report_key_findings,
    "report_query_summary": report_query_summary,
    "report_recommendations": report_recommendations,
    "sink_json": report_findings,
    "sink_csv": report_findings,
    "archive_backfill": archive_backfill,
    "archive_stream": archive_stream,
    "archive_retention": archive_retention,
}


def report_sql(cfg: AuditConfig | None = None) -> dict[str, str]:
    cfg = cfg or fixture_config()
    return {k: f(cfg) for k, f in REPORT_SQL.items()}
