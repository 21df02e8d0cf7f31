"""Order MinHash fingerprints in Spark SQL functions only (operator 4, native)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import running
from .storage import cut

#: Bits of a packed number that hold a k-mer's place in the text; the place of any k-mer beyond counts as the last.
PLACE_BITS = 24
PLACE = (1 << PLACE_BITS) - 1
#: Bits above the place that hold a numbered k-mer's hash; the part above them is its bin.
HASH_BITS = 32
#: Hex digits of a filled bin in a signature: two for its number, the others for its hash.
DIGITS = 8
#: Stands for a null id in joins, so that they share their partitioning; it sorts before all ids as nulls do.
NO_ID = -(1 << 63)


def settle(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with computed columns that later expressions read as values.

    Without the one-row generator the optimiser would write their expressions into
    the lambdas that use them, to be computed again for every array element.
    """
    names = [f"`{c}`" for c in df.columns if c not in columns]
    made = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("_made")
    return df.select(*names, made).select(*names, *[F.col(f"_made.{k}").alias(k) for k in columns])


def fingerprint(df: DataFrame, texts: Sequence[str], k: int = 3, bins: int = 64, ell: int = 2) -> DataFrame:
    """``df`` with each column of ``texts`` replaced by its Order MinHash signature: for each filled bin its number and a hash, in hex.

    K-mers are runs of ``k`` words (shorter at the end of the text, so a text of one
    word has one). Equal k-mers are numbered by occurrence, and the hash of k-mer and number
    gives a numbered k-mer's bin and its rank there. A bin keeps its ``ell`` smallest,
    puts them back into text order and hashes the tuple; so a signature counts the bins
    in which the same k-mers come in the same order. One hash per k-mer serves
    all bins. Null or empty text: no bin is filled.
    """
    if bins & (bins - 1) or not 1 < bins <= 64:
        raise ValueError("bins must be a power of two from 2 to 64")
    each: Callable[[Callable[[Column], Column]], dict[str, Column]] = lambda f: {c: f(F.col(c)) for c in texts}
    none = F.array().cast("array<bigint>")
    words = lambda t: F.array_remove(F.split(F.coalesce(t, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    df = settle(df, each(lambda t: F.transform(words(t), lambda w: F.xxhash64(w))))

    def kmers(h: Column) -> Column:
        at = lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)])
        return F.sort_array(F.transform(h, lambda x, i: at(x, i).bitwiseAND(~PLACE).bitwiseOR(F.least(i, F.lit(PLACE)).cast("bigint"))))

    df = settle(df, each(kmers))  # by k-mer, then place
    key = lambda x: F.shiftright(x, PLACE_BITS)
    def group_starts(c: str, part: Callable[[Column], Column]) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(c) - 1, F.lit(0)))
        return F.when(F.size(c) > 0, F.filter(places, _changes(c, part))).otherwise(F.array().cast("array<int>"))

    starts = {f"{c}_starts": group_starts(c, key) for c in texts}
    df = settle(df, starts)

    def numbered(c: str) -> Column:
        begins = F.col(f"{c}_starts")
        pack = lambda x, number: F.shiftrightunsigned(F.xxhash64(key(x), number), 64 - HASH_BITS - 6)
        group = lambda s, g: F.transform(
            F.slice(c, s + 1, F.coalesce(F.get(begins, g + 1), F.size(c)) - s),
            lambda x, number: F.shiftleft(pack(x, number), PLACE_BITS).bitwiseOR(x.bitwiseAND(PLACE)),
        )
        return F.sort_array(F.flatten(F.transform(begins, group)))

    df = settle(df, {c: F.coalesce(numbered(c), none) for c in texts}).drop(*starts)
    # the top bits of the 38-bit hash are the bin, so a bin's k-mers stand together, smallest first
    bin_of = lambda x: F.shiftrightunsigned(x, PLACE_BITS + HASH_BITS + 6 - (bins.bit_length() - 1)).bitwiseAND(bins - 1)

    def smallest(c: str) -> Column:
        return F.filter(c, lambda x, i: (i < ell) | (bin_of(F.get(c, F.greatest(i - ell, F.lit(0)))) != bin_of(x)))

    df = settle(df, {c: smallest(c) for c in texts})

    begins = {f"{c}_starts": group_starts(c, bin_of) for c in texts}
    df = settle(df, begins)

    def tuples(c: str) -> Column:
        at = F.col(f"{c}_starts")
        own = lambda s, g: F.slice(c, s + 1, F.coalesce(F.get(at, g + 1), F.size(c)) - s)
        ordered = lambda s, g: F.array_sort(F.transform(own(s, g), lambda x: F.struct(x.bitwiseAND(PLACE).alias("place"), key(x).alias("kmer"))))
        told = lambda s, g: F.concat(
            F.lpad(F.hex(bin_of(F.get(c, s))), 2, "0"),
            F.substring(F.sha2(F.concat_ws(",", F.transform(ordered(s, g), lambda e: e["kmer"].cast("string"))).cast("binary"), 256), 1, DIGITS - 2),
        )
        return F.transform(at, told)

    return settle(df, {c: tuples(c) for c in texts}).drop(*begins)


def _changes(c: str, part: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Whether the element of ``c`` at a place has another ``part`` than the one before it."""
    return lambda i: (i == 0) | (part(F.get(c, i)) != part(F.get(c, F.greatest(i - 1, F.lit(0)))))


def likeness(a: Column, b: Column) -> Column:
    """The part of the bins filled in either signature that are equal; 1 if none is filled."""
    bins = lambda s: F.transform(s, lambda x: F.substring(x, 1, 2))
    filled, equal = F.size(F.array_union(bins(a), bins(b))), F.size(F.array_intersect(a, b))
    return F.when(filled == 0, F.lit(1.0)).otherwise(equal / F.greatest(filled, F.lit(1)))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: bool = False) -> DataFrame:
    """(doc_id, text, n_chars, next_id, edited, hash, next_hash, nth): each text, and the text whose last half is replaced by the start of the next document's.

    The next document is found by global index from per-partition counts, and only the start
    that is needed of its text moves to the document before it. Documents follow each other by id, then text hash. With
    ``every``, each row is a document; rows equal in id and text follow each other, ``nth`` from 1. Else there is one row per
    id: of rows that share an id the one with the smallest text hash stands for it. Null text: empty. Null id: first, and
    an id like any other. A single document is its own next. (id, hash) and (next_id, next_hash) tell texts of one id apart.
    """
    own = F.coalesce(F.col(id_col).cast("long"), F.expr(f"{NO_ID + 1}L - 1L"))
    texts = docs.select(own.alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    if every:
        ids = texts.groupBy("id", "hash").agg(F.min(F.length("text")).alias("n_chars"), F.count(F.lit(1)).cast("int").alias("m"))
    else:
        ids = texts.groupBy("id").agg(F.min(F.struct("hash", F.length("text").alias("n_chars"))).alias("one")).select("id", "one.*", F.lit(1).alias("m"))
    placed = cut(running(ids, [F.col("id"), F.col("hash")]))
    n = max(placed.count(), 1)
    after = placed.select(F.col("row_index").alias("at"), F.col("id").alias("k"), F.col("hash").alias("h"), F.col("m").alias("own_m"))
    pairs = placed.join(after, (F.col("row_index") + 1) % n == F.col("at")).select(
        "k", "h", "own_m", F.col("id").alias("prev_id"), F.col("hash").alias("prev_hash"), F.floor(F.col("n_chars") / 2).cast("int").alias("need")
    )
    # all that follows stays partitioned by id and hash
    joined = texts.join(pairs.hint("merge"), (F.col("id") == F.col("k")) & (F.col("hash") == F.col("h")))
    joined = joined.select("id", "hash", "text", "own_m", "prev_id", "prev_hash", "need").dropDuplicates(["id", "hash"])
    starts = joined.select(
        F.col("prev_id").alias("for_id"), F.col("prev_hash").alias("for_hash"), F.col("id").alias("next_id"), F.col("hash").alias("next_hash"),
        F.substring("text", F.lit(1), F.col("need")).alias("start"),
    )
    both = joined.select("id", "hash", "text", "own_m").join(starts.hint("merge"), (F.col("id") == F.col("for_id")) & (F.col("hash") == F.col("for_hash")))
    if every:  # the last of equal rows has the next text after it, the others have their own
        both = both.withColumn("nth", F.explode(F.sequence(F.lit(1), "own_m")))
    else:
        both = both.withColumn("nth", F.lit(1))
    size, last = F.length("text"), F.col("nth") == F.col("own_m")
    half = F.floor(size / 2).cast("int")
    shown = lambda c: F.when(c != F.expr(f"{NO_ID + 1}L - 1L"), c)
    return both.select(
        shown(F.col("id")).alias("doc_id"), "text", size.cast("long").alias("n_chars"), shown(F.when(last, F.col("next_id")).otherwise(F.col("id"))).alias("next_id"),
        F.concat(F.substring("text", F.lit(1), size - half), F.when(last, F.col("start")).otherwise(F.substring("text", F.lit(1), half))).alias("edited"),
        "hash", F.when(last, F.col("next_hash")).otherwise(F.col("hash")).alias("next_hash"), "nth",
    )


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"), every=True)
    docs = docs.withColumn("edited_sha256", F.unhex(F.sha2(F.col("edited").cast("binary"), 256)))
    prints = fingerprint(docs, ["text", "edited"])
    packed = lambda c: F.unhex(F.array_join(c, "")).alias(c)
    rows = cut(prints.select("doc_id", "hash", "next_id", "next_hash", "nth", "n_chars", "edited_sha256", likeness(F.col("text"), F.col("edited")).alias("near_edited"), packed("text"), packed("edited")))
    following = rows.filter("nth = 1").select(F.col("doc_id").alias("id"), F.col("hash").alias("h"), F.col("text").alias("next_text"))
    signature = lambda c: F.regexp_extract_all(F.hex(c), F.lit(f".{{{DIGITS}}}"), F.lit(0))
    return rows.join(following, F.col("next_id").eqNullSafe(F.col("id")) & (F.col("next_hash") == F.col("h"))).select(
        "doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), F.lower(F.hex("text")).alias("fingerprint"),
        F.lower(F.hex("edited")).alias("edited_fingerprint"), "near_edited", likeness(signature("text"), signature("next_text")).alias("near_next"),
    )
