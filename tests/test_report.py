"""Report tables (R1-R9) and sinks."""

import json
import os
import uuid

from pyspark.sql import functions as F

from workload_audit.plans import report as R
from workload_audit.plans import sinks
from workload_audit.plans.runner import build_checks
from workload_audit.session import checkpoint_dir


def _found(spark, rows):
    return spark.createDataFrame(rows, "category string, name string, rank int, `column` string, value string")


def test_severity_of_each_class_value(spark):
    told = _found(
        spark,
        [
            ("cluster_health", "merge_pressure", 1, "merge_duration_class", "🟠 SLOW"),
            ("cluster_health", "merge_pressure", 1, "merge_load_class", "⚪ LIGHT LOAD"),
            ("cluster_health", "insert_part_fragmentation", 1, "batch_size_class", "🟥 VERY SMALL"),
            ("top_n", "by_memory", 1, "query_text", "SELECT '🟥 VERY SMALL'"),
            ("cluster_health", "partition_health", 1, "partition_status", None),
        ],
    )
    got = {(r["name"], r["column"]): (r["severity"], r["severity_label"], r["is_critical"]) for r in R.severity(told).collect()}
    assert got == {
        ("merge_pressure", "merge_duration_class"): ("warning", "Slow", False),
        ("merge_pressure", "merge_load_class"): ("ok", "Light Load", False),
        ("insert_part_fragmentation", "batch_size_class"): ("critical", "Very Small", True),
        ("partition_health", "partition_status"): (None, None, False),
    }


def _score(spark, stats):
    return R.health_score(spark.createDataFrame(stats, "category string, name string, rows long, critical int")).collect()[0]


def test_health_score_cases(spark):
    s = _score(spark, [("top_n", "a", 0, 0), ("anomalies", "b", 0, 0)])
    assert (s["score"], s["label"], s["level"]) == (100, "Healthy", "ok")
    s = _score(spark, [])
    assert (s["score"], s["label"]) == (50, "Unknown")
    s = _score(spark, [("cluster_health", "insert_part_fragmentation", 1, 1)])
    assert (s["score"], s["label"]) == (20, "Critical")
    s = _score(spark, [("anomalies", "x", 2, 0), ("top_n", "y", 3, 0), ("top_n", "z", 0, 0)])
    # issue = 3*0.6 + 1*0.3 = 2.1 of weight 5 -> 100 - 33.6 -> 66
    assert (s["score"], s["label"]) == (66, "Needs Attention")


def test_query_summary(spark):
    rows = [
        ("  insert into db.t values (1)",),
        ("SELECT a, b\nFROM (sub) WHERE x",),
        ("SHOW TABLES",),
        ("X" * 90,),
    ]
    got = [r[0] for r in spark.createDataFrame(rows, "q string").select(R.query_summary(F.col("q"))).collect()]
    assert got == ["insert into db.t ...", "SELECT a, b... FROM sub)", "SHOW TABLES", "X" * 80 + "..."]


def test_findings_preview_and_sinks(spark, tables_small, cfg):
    checks = build_checks(tables_small, cfg.with_(only_categories=("top_n", "cost_attribution")), share_base=False)
    found = R.findings(checks)
    rows = found.collect()
    per = {}
    for r in rows:
        per.setdefault((r["category"], r["name"]), []).append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in per.values())
    # rank 1 of by_user is the largest reader
    top_user = json.loads([r for r in rows if r["name"] == "by_user" and r["rank"] == 1][0]["row_json"])
    assert top_user["user"]
    prev = R.preview(found).collect()
    assert all(r["rank"] <= 5 for r in prev)
    counts = R.result_counts(spark, checks, found)
    assert counts.count() == 5
    lines = R.metric_lines(checks).collect()
    assert len(lines) == len(rows) and all("=" in r["line"] for r in lines)
    (line,) = R.key_findings(checks, cfg).collect()
    assert line["text"] == f"{top_user['user']} read the most in 7 days: {top_user['total_read']}"
    rec = R.recommendations(spark, counts).collect()
    assert all(r["recommendation"] for r in rec)

    out = os.path.join(checkpoint_dir(spark), f"sink-{uuid.uuid4().hex}")
    sinks.write_json(checks, os.path.join(out, "json"), cfg)
    listed = spark.read.json(os.path.join(out, "json", "checks"))
    assert listed.count() == 5 and {"generated_at", "lookback_days", "columns"} <= set(listed.columns)
    told = lambda df: sorted(map(tuple, df.collect()), key=str)
    want = told(R.values(checks))
    assert told(R.values(sinks.read_json(checks, spark, os.path.join(out, "json")))) == want
    paths = sinks.write_csv(checks, os.path.join(out, "csv"))
    assert set(paths) == {"top_n/by_memory", "top_n/by_read_bytes", "top_n/by_duration", "top_n/by_weighted_cost", "cost_attribution/by_user"}
    csv = spark.read.option("header", True).csv(paths["cost_attribution/by_user"])
    assert "error_rate_pct" in csv.columns and csv.count() == len(per[("cost_attribution", "by_user")])


def test_json_keeps_types_nulls_and_empty_checks(spark, cfg):
    frame = spark.createDataFrame([("a", None, 3, 0.5)], "x string, y string, z long, w double")
    checks = {("c", "one"): frame, ("c", "none"): frame.limit(0)}
    out = os.path.join(checkpoint_dir(spark), f"json-{uuid.uuid4().hex}")
    sinks.write_json(checks, out, cfg)
    (line,) = [json.loads(r["value"]) for r in spark.read.text(os.path.join(out, "rows")).collect()]
    assert line == {"category": "c", "name": "one", "rank": 1, "row": {"x": "a", "y": None, "z": 3, "w": 0.5}}
    assert {r["name"]: r["columns"] for r in spark.read.json(os.path.join(out, "checks")).collect()} == {"one": list("xyzw"), "none": list("xyzw")}


def test_ranks_are_global_without_a_window(spark):
    """A sorted result of many partitions keeps them; places follow from counts per partition."""
    users = spark.range(200_000).selectExpr("cast(pmod(id * 7919, 200000) as bigint) as n", "'x' as y").repartition(7).orderBy(F.desc("n"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled",)}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        out = R.ranked(users)
        assert out.rdd.getNumPartitions() > 1
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert out.where("rank <> 200000 - n").count() == 0 and out.count() == 200_000
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_doubles_that_no_decimal_holds(spark):
    frame = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1e33), (4, 0.125), (5, None)], "k int, x double").orderBy("k")
    got = {r["rank"]: r["value"] for r in R.values({("c", "n"): frame}).collect() if r["column"] == "x"}
    assert got == {1: "NaN", 2: "Infinity", 3: "1.0E33", 4: "0.125000", 5: None}


def test_report_plans_have_no_global_window(spark, tables_small, cfg):
    checks = R.settled(build_checks(tables_small, cfg.with_(only_categories=("cost_attribution", "anomalies"))))
    found = R.findings(checks)
    for df in (found, R.preview(found), R.values(checks), R.metric_lines(checks), R.key_findings(checks, cfg)):
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
