"""Scalar Column helpers: readable formats, rounding, casts and class ladders.

Every helper takes its input as Spark SQL expression text (a column name or
a small expression such as ``"sum_read / executions"``) and returns one
Column parsed by ``F.expr`` - a single call into the JVM, where the same
tree built node by node through the Column API costs hundreds of calls. The
result is an ordinary built-in expression: it stays inside whole-stage
codegen (no Python UDF anywhere). Each ``*_sql`` function returns the text,
for callers that compose larger expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (formats and class labels of the report) -----------------
# Binary size units, 1024 apart.
SIZE_UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB", "ZiB", "YiB")
# Time-delta units: (seconds per unit, singular name). A month is 30.5 days.
DELTA_UNITS = (
    (31_536_000, "year"),
    (2_635_200, "month"),
    (86_400, "day"),
    (3_600, "hour"),
    (60, "minute"),
    (1, "second"),
)
# Bar characters: full block, then partial blocks of 1/8 ... 7/8.
BAR_FULL = "█"
BAR_EIGHTHS = ("▏", "▎", "▍", "▌", "▋", "▊", "▉")

# Ladders: (exclusive upper bound, label), first match wins, then the default.
INSERT_DURATION_BUCKETS = (
    (100, "<0.1s"),
    (200, "<0.2s"),
    (500, "<0.5s"),
    (1000, "<1s"),
    (2000, "<2s"),
    (5000, "<5s"),
    (10000, "<10s"),
    (30000, "<30s"),
    (60000, "<60s"),
)
INSERT_DURATION_OVER = ">=60s"

BATCH_SIZE_CLASSES = (
    (1e2, "🟥 VERY SMALL"),
    (1e3, "🟧 SMALL"),
    (1e4, "🟩 NORMAL"),
    (1e5, "🟦 LARGE"),
    (1e6, "🟪 X LARGE"),
)
BATCH_SIZE_OVER = "🟫 XX LARGE"

INSERT_FREQUENCY_CLASSES = (
    (10, "<10s"),
    (60, "<1min"),
    (300, "<5min"),
    (900, "<15min"),
    (1800, "<30min"),
    (3600, "Hourly"),
    (86400, "Daily"),
)
MERGE_FREQUENCY_CLASSES = (
    (10, "<10s"),
    (60, "<1min"),
    (300, "<5min"),
    (900, "<15min"),
    (3600, "Hourly"),
    (86400, "Daily"),
)
FREQUENCY_OVER = "Rare"
MISSING_INTERVAL = 1e12  # a NULL interval (single event) counts as this many seconds

MERGE_DURATION_CLASSES = (
    (5, "🟢 FAST"),
    (30, "🟡 MODERATE"),
    (120, "🟠 SLOW"),
)
MERGE_DURATION_OVER = "🔴 PAINFUL"

MERGE_LOAD_CLASSES = (
    (1e3, "⚪ LIGHT LOAD"),
    (5e3, "🟡 MEDIUM LOAD"),
    (2e4, "🟠 HEAVY LOAD"),
)
MERGE_LOAD_OVER = "🔴 EXTREME LOAD"

# Pressure: the first step ignores the merge count; the others need at
# least PRESSURE_MIN_MERGES merges; the last applies to any p90.
PRESSURE_FAST = (10, "🔵 FAST")
PRESSURE_MIN_MERGES = 1e4
PRESSURE_CLASSES = (
    (30, "🟢 MODERATE"),
    (120, "🟡 SLOW"),
    (1800, "🔴 PAINFUL (2-30 min)"),
    (7200, "🟣 SEVERE (30-120 min)"),
)
PRESSURE_CRITICAL = "🛑 CRITICAL (>= 2 h)"
PRESSURE_NONE = "-"
# --- end of fixed values ---------------------------------------------------


def lit(v) -> str:
    """SQL literal for a Python string or number."""
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(v, float):
        return f"{v!r}D"
    return str(v)


def ladder_sql(x: str, steps: Sequence[tuple[float, str]], default: str) -> str:
    """``CASE WHEN x < b1 THEN l1 WHEN x < b2 THEN l2 ... ELSE default END``."""
    whens = " ".join(f"WHEN ({x}) < {lit(float(b))} THEN {lit(l)}" for b, l in steps)
    return f"CASE {whens} ELSE {lit(default)} END"


def ladder(x: str, steps: Sequence[tuple[float, str]], default: str) -> Column:
    return F.expr(ladder_sql(x, steps, default))


def round_half_up_sql(x: str, digits: int = 0) -> str:
    scale = 10**digits
    return f"CAST(floor(CAST(({x}) AS DOUBLE) * {scale} + 0.5D) / {scale} AS DOUBLE)"


def round_half_up(x: str, digits: int = 0) -> Column:
    """``floor(x * 10^d + 0.5) / 10^d`` as double; the same expression is
    used by the oracle, so both engines agree on half-way cases."""
    return F.expr(round_half_up_sql(x, digits))


def trunc_long(x: str) -> Column:
    """Float -> signed 64-bit integer, truncating toward zero."""
    return F.expr(f"CAST(({x}) AS BIGINT)")


def avg_sql(total: str, n: str) -> str:
    """Mean from an exact sum and a count, as double."""
    return f"(CAST(({total}) AS DOUBLE) / CAST(({n}) AS DOUBLE))"


def readable_size_sql(x: str) -> str:
    v = f"CAST(({x}) AS DOUBLE)"
    idx = "CASE " + " ".join(
        f"WHEN abs({v}) >= {lit(float(1024**k))} THEN {k}" for k in range(len(SIZE_UNITS) - 1, 0, -1)
    ) + " ELSE 0 END"
    units = "array(" + ", ".join(lit(u) for u in SIZE_UNITS) + ")"
    # Bind (cents, unit index) once through a one-element lambda.
    return (
        f"CASE WHEN {v} IS NULL THEN NULL ELSE transform(array(named_struct("
        f"'c', floor({v} / pow(1024.0D, {idx}) * 100 + 0.5D), 'i', {idx})), s -> concat("
        "CASE WHEN s.c < 0 THEN '-' ELSE '' END, CAST(abs(s.c) div 100 AS STRING), '.', "
        f"lpad(CAST(abs(s.c) % 100 AS STRING), 2, '0'), ' ', element_at({units}, s.i + 1)))[0] END"
    )


def readable_size(x: str) -> Column:
    """Bytes as text with a binary unit, e.g. ``4.20 GiB`` / ``512.00 B``."""
    return F.expr(readable_size_sql(x))


def readable_delta_sql(x: str) -> str:
    rem = f"CAST(({x}) AS BIGINT)"
    parts = []
    for size, name in DELTA_UNITS:
        n = f"({rem} div {size})" if size > 1 else rem
        parts.append(f"CASE WHEN {n} > 0 THEN concat(CAST({n} AS STRING), {lit(' ' + name)}, CASE WHEN {n} <> 1 THEN 's' ELSE '' END) END")
        rem = f"({rem} % {size})"
    arr = "array_compact(array(" + ", ".join(parts) + "))"
    return (
        f"CASE WHEN ({x}) IS NULL THEN NULL ELSE transform(array({arr}), a -> CASE WHEN size(a) = 0 THEN '0 seconds' "
        "WHEN size(a) = 1 THEN element_at(a, 1) "
        "ELSE concat(array_join(slice(a, 1, size(a) - 1), ', '), ' and ', element_at(a, -1)) END)[0] END"
    )


def readable_delta(x: str) -> Column:
    """Whole seconds as ``1 day, 2 hours and 5 seconds`` (``0 seconds`` for 0)."""
    return F.expr(readable_delta_sql(x))


def bar_sql(x: str, lo: str, hi: str, width: int) -> str:
    w = (
        f"CASE WHEN ({x}) <= ({lo}) THEN 0.0D WHEN ({x}) >= ({hi}) THEN {lit(float(width))} "
        f"ELSE CAST(({x}) - ({lo}) AS DOUBLE) * {width} / CAST(({hi}) - ({lo}) AS DOUBLE) END"
    )
    chars = "array(" + ", ".join(lit(c) for c in BAR_EIGHTHS) + ")"
    return (
        f"transform(array({w}), w -> concat(repeat({lit(BAR_FULL)}, CAST(floor(w) AS INT)), "
        f"coalesce(CASE WHEN floor((w - floor(w)) * 8) > 0 THEN element_at({chars}, CAST(floor((w - floor(w)) * 8) AS INT)) END, '')))[0]"
    )


def bar(x: str, lo: str, hi: str, width: int) -> Column:
    """Unicode bar of ``width`` cells for ``x`` scaled from [lo, hi]; ``hi``
    may be a window expression such as ``max(n) OVER ()``."""
    return F.expr(bar_sql(x, lo, hi, width))


def to_uint_or_zero_sql(s: str) -> str:
    return f"coalesce(CASE WHEN ({s}) RLIKE '^[0-9]+$' THEN try_cast(({s}) AS BIGINT) END, CAST(0 AS BIGINT))"


def to_uint_or_zero(s: str) -> Column:
    """Digits-only text -> non-negative long; anything else -> 0."""
    return F.expr(to_uint_or_zero_sql(s))


def first_element(arr: str) -> Column:
    """``arr[1]`` that is NULL (not an error) for an empty array."""
    return F.expr(f"get(({arr}), 0)")


def strip_database(table_ref: str) -> Column:
    """``db.`t``` -> ``t``: drop everything up to the first dot and backticks."""
    return F.expr(f"replace(substr(({table_ref}), instr(({table_ref}), '.') + 1), '`', '')")


def database_of(table_ref: str) -> Column:
    """``db.`t``` -> ``db`` (the whole name when there is no dot)."""
    return F.expr(f"replace(substring_index(({table_ref}), '.', 1), '`', '')")


def insert_duration_bucket(ms: str) -> Column:
    return ladder(ms, INSERT_DURATION_BUCKETS, INSERT_DURATION_OVER)


def batch_size_class(avg_rows: str) -> Column:
    return ladder(avg_rows, BATCH_SIZE_CLASSES, BATCH_SIZE_OVER)


def insert_frequency_class(interval_s: str) -> Column:
    return ladder(f"coalesce(({interval_s}), {lit(MISSING_INTERVAL)})", INSERT_FREQUENCY_CLASSES, FREQUENCY_OVER)


def merge_frequency_class(interval_s: str) -> Column:
    return ladder(f"coalesce(({interval_s}), {lit(MISSING_INTERVAL)})", MERGE_FREQUENCY_CLASSES, FREQUENCY_OVER)


def merge_duration_class(p90_s: str) -> Column:
    return ladder(p90_s, MERGE_DURATION_CLASSES, MERGE_DURATION_OVER)


def merge_load_class(merges: str) -> Column:
    return ladder(merges, MERGE_LOAD_CLASSES, MERGE_LOAD_OVER)


def merge_pressure_class(p90_s: str, merges: str) -> Column:
    busy = f"({merges}) >= {lit(PRESSURE_MIN_MERGES)}"
    whens = [f"WHEN ({p90_s}) < {lit(float(PRESSURE_FAST[0]))} THEN {lit(PRESSURE_FAST[1])}"]
    whens += [f"WHEN ({p90_s}) < {lit(float(b))} AND {busy} THEN {lit(l)}" for b, l in PRESSURE_CLASSES]
    whens.append(f"WHEN {busy} THEN {lit(PRESSURE_CRITICAL)}")
    return F.expr("CASE " + " ".join(whens) + f" ELSE {lit(PRESSURE_NONE)} END")


def micros(ts: str) -> Column:
    """A wall-clock timestamp as microseconds since 1970, in no time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def from_micros(n: str) -> Column:
    """The wall-clock timestamp of ``micros``."""
    return F.expr(f"timestampadd(MICROSECOND, {n}, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
