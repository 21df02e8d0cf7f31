"""The corpus pipeline: five stages over ``documents``, each written and read again by the next.

Quality classifier, line dedup, n-gram Jaccard join, mixing sources to target weights, best-fit packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workload_audit.llm.features import text_key
from workload_audit.llm.line_dedup import dedup_lines
from workload_audit.llm.mixing import mix, take
from workload_audit.llm.ngram_join import near_duplicates
from workload_audit.llm.packing import pack, token_pieces
from workload_audit.llm.quality_ranking import rank_quality
from workload_audit.llm.storage import cut, run_path, ship, unwrapped, wrapped


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. The verdict goes by id and text, so rows that share an id, null included, are judged each by its own text."""
    ship(spark)
    verdicts = rank_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keyed=True)
    rejected = verdicts.filter("predicted = 0").select(F.col("doc_id").alias("_id"), "text_key").distinct()
    same = docs["doc_id"].eqNullSafe(rejected["_id"]) & (text_key(docs["text"]) == rejected["text_key"])
    return docs.join(rejected, same, "left_anti")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; one that had text and loses every line of it is a copy, and goes. n_chars follows the text."""
    ship(spark)
    left = dedup_lines(docs).filter("size(_dropped) < _lines or size(_dropped) = 0")
    return left.withColumn("n_chars", F.when(F.size("_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id (null last), then text hash; of rows equal in id and text, one.

    Texts are linked whatever their ids: unlike texts of one id stay, near copies without an id go. Texts without words link with nothing and stay.
    """
    ship(spark)
    key = text_key(F.col("text"))
    groups = cut(near_duplicates(docs.select(key.alias("doc_id"), "text")).groupBy(F.col("doc_id").alias("key")).agg(
        F.max("n_shingles").alias("n"), F.min("component_id").alias("component")))
    ids = docs.select(F.col("doc_id").alias("id"), key.alias("hash")).groupBy("id", "hash").agg(F.count(F.lit(1)).alias("rows"))
    by_text = ids.groupBy("hash").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash", "rows")).alias("own"))
    linked = by_text.join(groups.filter("n > 0"), F.col("hash") == F.col("key")).groupBy("component").agg(F.min("own").alias("f"))
    wordless = ids.join(groups.filter("n = 0"), F.col("hash") == F.col("key"), "left_semi").select("id", "hash", F.lit(1).cast("long").alias("rows"))
    stays = cut(linked.select("f.id", "f.hash", "f.rows").unionByName(wordless)).select(F.col("id").alias("_id"), F.col("hash").alias("_hash"), "rows")
    base = docs.select(wrapped(docs), F.col("doc_id").alias("id"), key.alias("hash"))
    marked = base.join(stays, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))).select("row", "id", "hash", "rows")
    several = marked.filter("rows > 1").dropDuplicates(["id", "hash"])
    return marked.filter("rows = 1").unionByName(several).select(*unwrapped(docs.columns))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    ship(spark)
    return take(docs, mix(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; a document that the mix took twice has its pieces twice."""
    ship(spark)
    return pack(token_pieces(docs))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_join),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: SQL can't express the learned classifier, the edit join or best-fit packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = run_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
