"""Incremental secret scanning over content-addressed texts (operator 2, native)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import cut, run_path


@dataclass(frozen=True)
class Rule:
    """A rule of the scan. ``pattern`` may have groups; ``value`` is the one that must have ``least`` characters (0: the whole match)."""

    kind: str
    version: int
    pattern: str
    value: int
    least: int


RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", 1, r"[0-9a-f]+", 0, 32),
)

LEDGER = "blob string, kind string, version int, spans array<struct<start:long,end:long>>"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _spans(rule: Rule) -> Column:
    """Leftmost non-overlapping matches of a rule in ``text`` that are long enough, as places in code points.

    ``\\G`` ties each match to the end of the last one and a reluctant group takes
    what lies between; so the k-th place is the sum of the lengths so far.
    Texts without a long enough match are told apart by a plain search first.
    """
    tied = rf"\G([\s\S]*?)(?:({rule.pattern}))"
    found = F.regexp_extract_all("text", F.lit(tied), F.lit(2))
    gaps = F.regexp_extract_all("text", F.lit(tied), F.lit(1))
    values = F.regexp_extract_all("text", F.lit(tied), F.lit(2 + rule.value))
    return F.arrays_zip(
        F.transform(found, F.length).alias("size"), F.transform(gaps, F.length).alias("gap"), F.transform(values, F.length).alias("value")
    )


def _quick(rule: Rule) -> Column:
    """Whether ``text`` can have a match of the rule that is long enough: its last repeat needs ``least`` characters in a row."""
    if rule.pattern.endswith("]+") or rule.pattern.endswith("]+)"):
        head, bracket, tail = rule.pattern.rpartition("+")
        return F.col("text").rlike(head + f"{{{rule.least if rule.value else _needed(rule)},}}" + tail)
    return F.col("text").rlike(rule.pattern)


def _needed(rule: Rule) -> int:
    """Repeats of the last class in a match of ``least`` characters, if all before it is literal."""
    return max(1, rule.least - len(rule.pattern[: rule.pattern.rindex("[")]))


def scan_blobs(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Ledger rows (blob, kind, version, spans) of the texts in ``blobs`` (blob, text, todo), for the kinds in ``todo``. Rows of one blob count once."""
    parts = None
    for rule in rules:
        # rows equal in path and text come as often as they stand; the running sum below is right for one row of a blob only
        once = blobs.filter(F.array_contains("todo", f"{rule.kind}:{rule.version}") & _quick(rule)).dropDuplicates(["blob"])
        hits = once.select("blob", F.posexplode(_spans(rule)).alias("k", "m"))
        before = Window.partitionBy("blob").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
        placed = hits.withColumn("end", F.sum(F.col("m.gap") + F.col("m.size")).over(before)).filter(F.col("m.value") >= rule.least)
        rows = placed.groupBy("blob").agg(
            F.array_sort(F.collect_list(F.struct((F.col("end") - F.col("m.size")).cast("long").alias("start"), F.col("end").cast("long").alias("end")))).alias("spans")
        ).select("blob", F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), "spans")
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger so far: what each (blob, kind, version) holds. A blob without findings has a row with empty spans."""
    return spark.read.schema(LEDGER).parquet(path)


def scan_versions(versions: DataFrame, path: str, rules: Sequence[Rule] = RULES, first: bool = False) -> DataFrame:
    """Scan what the ledger at ``path`` doesn't hold yet, add it, and return the whole ledger.

    ``versions`` has (path, text): every historical version of every file. Equal texts are one
    blob, and a blob is scanned once for each version of a rule, whatever the
    number of its paths. A new rule, or a new version of one, is run over all blobs anew, and nothing else is.
    ``first`` starts a ledger.
    """
    spark = versions.sparkSession
    wanted = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    texts = versions.select("path", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # one path stands for each blob, so that only its text goes on; rows equal in path and text go on together, and scan_blobs takes one of them
    blobs = texts.groupBy(blob_id(F.col("text")).alias("blob")).agg(F.min("path").alias("at"))
    if first:
        new = blobs.withColumn("todo", wanted)
    else:
        known = read_ledger(spark, path).groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("known"))
        new = blobs.join(known, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("known", F.array().cast("array<string>")))).drop("known").filter(F.size("todo") > 0)
    new = cut(new)
    old = texts.withColumn("blob", blob_id(F.col("text")))
    sources = new.withColumnRenamed("blob", "b").hint("shuffle_hash")
    unseen = old.join(sources, F.col("path").eqNullSafe(F.col("at")) & (F.col("blob") == F.col("b"))).select("blob", "text", "todo")
    found = scan_blobs(unseen, rules)
    listed = new.select("blob", F.explode("todo").alias("rule")).select(
        "blob", F.split_part("rule", F.lit(":"), F.lit(1)).alias("kind"), F.split_part("rule", F.lit(":"), F.lit(2)).cast("int").alias("version")
    )
    rows = listed.join(found, ["blob", "kind", "version"], "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")))
    rows.select("blob", "kind", "version", "spans").write.mode("append").parquet(path)
    return read_ledger(spark, path)


def find_secrets(docs: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger's findings joined back to every document: (doc_id, n_<kind>..., spans).

    ``spans`` is kind:start:end of each finding by start, then kind in the order of
    the rules; empty without findings. Null text: empty. Null and repeated ids keep a row each.
    """
    order = {r.kind: i for i, r in enumerate(rules)}
    current = [f"{r.kind}:{r.version}" for r in rules]
    hits = ledger.filter(F.concat_ws(":", "kind", "version").isin(current) & (F.size("spans") > 0))
    rank = F.element_at(F.create_map(*[x for k, i in order.items() for x in (F.lit(k), F.lit(i))]), F.col("kind"))
    each = hits.select("blob", rank.alias("rank"), "kind", F.explode("spans").alias("s"))
    by_blob = each.groupBy("blob").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in order],
        F.array_sort(F.collect_list(F.struct("s.start", "rank", "s.end", "kind"))).alias("all"),
    ).withColumn("spans", F.concat_ws(",", F.transform("all", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))))
    rows = docs.select(F.col(id_col).alias("doc_id"), blob_id(F.col(text_col)).alias("blob"))
    return rows.join(by_blob.drop("all"), "blob", "left").select(
        "doc_id", "blob", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in order], F.coalesce("spans", F.lit("")).alias("spans")
    )


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ledger = scan_versions(docs.select(F.col("doc_id").alias("path"), "text"), run_path(spark, "secret-ledger"), first=True)
    found = find_secrets(docs, ledger)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("spans").cast("binary"), 256).alias("base_sha256"), "spans", "blob")
