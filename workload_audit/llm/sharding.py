"""Balanced contiguous shards from global prefix sums of byte sizes (operator 9, native)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import running
from .storage import cut


def assign_shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document in one of ``n_shards`` contiguous runs of the ``id_col`` order, the runs' bytes near equal.

    A document's size is the bytes of its text plus 1. The global prefix sum of
    the sizes comes from per-partition totals (see ``prefix.running``), and the
    cuts stand at equal targets: a document belongs to the shard in which its
    middle byte lies, so a shard is off its target by half a document at each
    end. Returns doc_id, size, text_crc32, shard, slot (place in the shard, from 0).

    Null text: size 1, CRC of the empty text. Null or repeated ids: nulls come
    first, rows with one id stay next to each other. No rows: no shards. A
    document larger than a shard fills one alone, and neighbouring shards may
    stay empty. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    placed = cut(running(sized, [F.col("doc_id"), F.col("text_crc32")], {"before": F.col("size")}))
    total = placed.agg(F.coalesce(F.sum("size"), F.lit(1))).first()[0]
    rows = placed.withColumn(
        "shard", F.least(F.lit(n_shards - 1), F.expr(f"({n_shards} * (2 * before + size)) div {2 * total}")).cast("int")
    )
    firsts = rows.groupBy("shard").agg(F.min("row_index").alias("first"))  # n_shards rows
    return rows.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row_index") - F.col("first")).alias("slot")
    )


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assign_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
