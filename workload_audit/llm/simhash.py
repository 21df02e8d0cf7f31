"""SimHash near-dedup: pigeonhole blocks of fingerprints, verified by Hamming distance (operator 11)."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import cut
from .textops import LOWER, U64, runs, word_spans

#: Fingerprints link at this many differing bits or fewer.
MOST_BITS = 4
#: Blocks that a fingerprint is cut into; a pair that links has BLOCKS - MOST_BITS of them equal, and is keyed by those.
BLOCKS = 7
#: Fingerprints that are compared with each other at once; larger groups are dealt into several.
GROUP = 4096
SEED = 42
#: Shingles whose bits are counted at once.
STEP = 1 << 18


def block_masks(blocks: int = BLOCKS, most: int = MOST_BITS) -> list[int]:
    """The bits of every choice of ``blocks - most`` of the blocks: fingerprints with up to ``most`` differing bits are equal under one of them."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    own = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(choice) for choice in itertools.combinations(own, blocks - most)]


def simhashes(column: pa.Array, k: int) -> np.ndarray:
    """The fingerprint of each text: bit i is 1 if it is 1 in over half the hashes of its k-word shingles, repeats included."""
    out = np.zeros(len(column), U64)
    for first, end, data, offsets in runs(column):
        data = LOWER[data]
        starts, ends, docs = word_spans(data, offsets)
        if not len(starts):
            continue
        sizes = ends - starts
        # the words of all texts, joined with single spaces
        at = np.cumsum(sizes + 1) - sizes - 1
        joined = np.full(int(sizes.sum()) + len(sizes), 0x20, np.uint8)
        inside = np.arange(int(sizes.sum()))
        before = np.cumsum(sizes) - sizes
        joined[inside + np.repeat(at - before, sizes)] = data[inside + np.repeat(starts - before, sizes)]
        raw, stop = joined.tobytes(), at + sizes
        a = np.flatnonzero(docs[: len(docs) - k + 1] == docs[k - 1 :]) if len(docs) >= k else np.empty(0, np.int64)
        many = np.bincount(docs, minlength=end - first)
        lone = np.flatnonzero((many > 0) & (many < k))  # texts with fewer words: all of them as one
        begin = np.searchsorted(docs, lone)
        owner = np.concatenate([docs[a], lone])
        left, right = np.concatenate([at[a], at[begin]]), np.concatenate([stop[a + k - 1], stop[begin + many[lone] - 1]])
        order = np.argsort(owner, kind="stable")
        owner, left, right = owner[order], left[order], right[order]
        ones = np.zeros((end - first, 64), np.int64)
        for i in range(0, len(owner), STEP):
            part = owner[i : i + STEP]
            spans = zip(left[i : i + STEP].tolist(), right[i : i + STEP].tolist(), strict=True)
            h = np.fromiter((xxhash.xxh64_intdigest(raw[x:y], SEED) for x, y in spans), U64, len(part))
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            ones[part[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
        total = np.bincount(owner, minlength=end - first)
        out[first:end] = np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(U64)[:, 0]
    return out


def fingerprint_table(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fp) of every row, in one pass over the texts."""

    def read(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(simhashes(batch.column(1), k).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(read, "doc_id long, fp long")


def near(values: np.ndarray, one: np.uint64, most: int) -> np.ndarray:
    return np.bitwise_count(values ^ one) <= most


def spanning_links(values: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join all linked fingerprints of a group, fewer than it has members: what has been reached is not compared again."""
    left = values
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            one = reached.pop()
            hit = near(left, one, most)
            if hit.any():
                found, left = left[hit], left[~hit]
                reached.extend(found)
                yield np.full(len(found), one), found


def _links(parts) -> pa.RecordBatch:
    a, b = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, U64) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def _grouped(batches, keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of the stream in pieces that end where a group (its first ``keys`` columns) does."""
    held = None
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        columns = columns if held is None else [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
        if not len(columns[0]):
            continue
        same = np.logical_and.reduce([c == c[-1] for c in columns[:keys]])
        last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if last:
            yield [c[:last] for c in columns]
        held = [c[last:] for c in columns]
    if held is not None:
        yield held


def _bounds(columns: list[np.ndarray]) -> np.ndarray:
    new = np.zeros(len(columns[0]) + 1, bool)
    new[[0, -1]] = True
    for c in columns:
        new[1:-1] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def links_within(rows: DataFrame, most: int) -> DataFrame:
    """Links (a, b) inside the groups (key, part) of rows (key, part, fp)."""

    def compare(batches):
        for key, part, fp in _grouped(batches, 2):
            fp, bounds = fp.view(U64), _bounds([key, part])
            sizes = np.diff(bounds)
            out = []
            pairs = bounds[:-1][sizes == 2]  # most groups, all at once
            hit = np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= most
            out.append((fp[pairs[hit]], fp[pairs[hit] + 1]))
            for i in np.flatnonzero(sizes > 2):
                out += spanning_links(fp[bounds[i] : bounds[i + 1]], most)
            yield _links(out)

    return rows.select("key", "part", "fp").repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(compare, "a long, b long")


def links_across(rows: DataFrame, most: int) -> DataFrame:
    """Links (a, b) between components, as their labels, in the groups (key, i, j) of rows (key, i, j, probe, component, fp): each probe against the others."""

    def compare(batches):
        for key, i, j, probe, component, fp in _grouped(batches, 3):
            fp, bounds, out = fp.view(U64), _bounds([key, i, j]), []
            for a, b in itertools.pairwise(bounds):
                asks = probe[a:b].astype(bool)
                base, of = fp[a:b][~asks], component[a:b][~asks]
                for one, label in zip(fp[a:b][asks], component[a:b][asks], strict=True):
                    met = np.unique(of[near(base, one, most)])
                    met = met[met != label].view(U64)
                    out.append((np.full(len(met), label).view(U64), met))
            yield _links(out)

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(compare, "a long, b long")


def fingerprint_components(fps: DataFrame, most: int = MOST_BITS, blocks: int = BLOCKS, group: int = GROUP) -> DataFrame:
    """(node, component) of each fingerprint of ``fps`` (fp, distinct) that links with another one: exact, without a cap on partners.

    Each fingerprint goes under a key for every choice of ``blocks - most`` of its blocks. Keys of one fingerprint drop out by a grouped
    count. The members of a key with up to ``group`` of them are compared in one place. A larger key is dealt at random into parts of
    about that size; the links found in all of them already join most of what belongs together, so that then only the members
    outside the key's largest component are held against its other parts, in blocks of ``group`` by ``group``.
    """
    masks = F.array(*[F.struct(F.lit(i).alias("c"), F.lit(m - (1 << 64) if m >> 63 else m).cast("long").alias("m")) for i, m in enumerate(block_masks(blocks, most))])
    keyed = fps.select("fp", F.explode(masks).alias("x")).select(F.xxhash64("x.c", F.col("fp").bitwiseAND(F.col("x.m"))).alias("key"), "fp")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = keyed.join(shared, "key").withColumn("parts", F.ceil(F.col("n") / group).cast("int"))
    rows = cut(rows.withColumn("part", F.pmod(F.xxhash64("fp", F.lit(SEED)), F.col("parts")).cast("int")))
    inside = components(links_within(rows, most).distinct())

    large = rows.filter("parts > 1").join(inside.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", "n", "parts", "part", F.coalesce("component", "fp").alias("component"))
    large = cut(large)
    of = large.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
    most_of = of.groupBy("key").agg(F.max(F.struct("m", "component")).alias("top")).select("key", "top.component", "top.m")
    rest = large.join(most_of.withColumnRenamed("component", "top"), "key").filter("n > m").withColumn("asks", F.ceil((F.col("n") - F.col("m")) / group).cast("int"))
    base = rest.select("key", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("i"), F.col("part").alias("j"), F.lit(0).alias("probe"), "component", "fp")
    asks = rest.filter("component <> top").select(
        "key", F.pmod(F.xxhash64("fp", F.lit(SEED + 1)), F.col("asks")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), F.lit(1).alias("probe"), "component", "fp")
    across = cut(links_across(base.unionByName(asks), most).distinct())
    if across.isEmpty():
        return inside
    outer = components(across).select(F.col("node").alias("label"), F.col("component").alias("outer"))
    nodes = inside.unionByName(across.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(inside, "node", "left_anti").select("node", F.col("node").alias("component")))
    return nodes.join(outer, F.col("component") == F.col("label"), "left").select("node", F.coalesce("outer", "component").alias("component"))


def simhash_duplicates(docs: DataFrame, k: int = 4, most: int = MOST_BITS, blocks: int = BLOCKS, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row: groups of documents linked by their SimHash fingerprints.

    Rows with equal fingerprints are one from the start, so that copies are never paired. Null and empty texts and texts without words
    have fingerprint zero, which links like any other. component_id is the smallest id of the component; rows with a null id have their
    fingerprint and their component's smallest id, or null if it has none, and link rows between them. Rows that share an id
    count by their own texts. Whole texts of any length are read, in runs. Ties in a bit (half the hashes) give 0. No rows: no rows.
    Other columns are not read.
    """
    rows = cut(fingerprint_table(docs, k, id_col, text_col))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = fingerprint_components(classes.select("fp"), most, blocks, group).select(F.col("node").alias("fp"), "component")
    classes = cut(classes.join(joined, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")))
    smallest = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    known = classes.select("fp", "component").join(smallest, "component").select("fp", "component_id")
    out = rows.join(known, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
