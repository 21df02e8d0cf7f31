"""Document features for the quality models: statistics of the text alone, as rates."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import STAT_NAMES, statistics

FEATURES = (
    "log_words", "word_length", "symbol_rate", "upper_rate", "digit_rate", "shout_rate", "bar_rate",
    "punct_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "log_line_words", "wide_rate", "log_longest",
)


def with_statistics(docs: DataFrame, id_col: str, text_col: str, keyed: bool = False) -> DataFrame:
    """(doc_id, STAT_NAMES...) of every row, in one pass over the texts without a shuffle; ``keyed`` adds text_key, the text's hash."""
    names = ["doc_id", *STAT_NAMES, *["text_key"] * keyed]
    schema = ", ".join(f"{x} long" for x in names)

    def count(batches):
        for batch in batches:
            stats = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(stats[:, i]) for i in range(stats.shape[1])), *batch.columns[2:]], names)

    key = [text_key(F.col(text_col)).alias("text_key")] * keyed
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *key).mapInArrow(count, schema)


def text_key(text: Column) -> Column:
    """The hash that tells rows of one id apart. Null text: that of the empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def matrix(stats: pd.DataFrame) -> np.ndarray:
    """FEATURES of rows of statistics; a text without words has rates of 0."""
    s = {k: stats[k].to_numpy(np.float64) for k in STAT_NAMES}
    words, chars, lines = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1), np.maximum(s["n_lines"], 1)
    return np.column_stack([
        np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / words, s["n_upper"] / chars, s["n_digits"] / chars,
        s["n_shouts"] / words, s["n_bars"] / words, s["n_punct"] / words, s["n_dup_lines"] / lines, s["n_repeat_words"] / words,
        s["n_distinct"] / words, np.log1p(words / lines), (s["n_bytes"] - s["n_chars"]) / chars, np.log1p(s["longest_word"]),
    ])


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; null ids: that of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def labelled_sample(stats: DataFrame, labels: DataFrame, label: str, most: int, seed: str) -> pd.DataFrame:
    """Statistics with their label, outside fold 0, of at most ``most`` rows: those with the smallest hashes of their ids, or of more rows about that many.

    Rows with a null id or label are left out; of labels for one id the largest counts.
    """
    wanted = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).alias("label"))
    rows = stats.join(wanted, F.col("doc_id") == F.col("_id")).filter(fold(F.col("doc_id")) != 0).drop("_id")
    # the smallest hashes of n: about the ones below most / n of their range, so that no task sends many more than are taken
    rows = rows.withColumn("_order", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 40)))
    n = rows.count()
    if n > most:
        rows = rows.filter(F.col("_order") < int((1 << 40) * most / n))
    return rows.orderBy("_order", "doc_id", *STAT_NAMES).limit(most).drop("_order").toPandas()
