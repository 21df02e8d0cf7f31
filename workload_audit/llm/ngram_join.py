"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersections (operator 1)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import id_filter
from .components import components
from .frequent import most_frequent
from .storage import cut
from .textops import U64, mix, shingle_sets

#: Two documents link when LINK[1] * intersection >= LINK[0] * union.
LINK = (3, 4)
#: Bits of a document's bitmap.
BITMAP = 2048
#: Documents that are compared with each other at once in the first step; larger groups are dealt into several.
GROUP = 256
#: Groups that are dealt, at most, the largest first; a group beyond these is compared in runs of 4 * GROUP, and tiles tell what that leaves.
MAX_DEALT = 1 << 16
#: Shingles are counted in runs of about this many; a run tells of those in at least RUN_TIMES of its sets.
RUN, RUN_TIMES = 4_000_000, 2
#: A shingle in at least this many sets, by those counts, is common; so many common ones are held at most, the most frequent first (2 MB).
COMMON, MAX_COMMON = 4, 1 << 18


def least_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest intersection with which sets of ``a`` and ``b`` elements link."""
    p, q = LINK
    return -(-p * (a + b) // (p + q))


def probe_length(n: int) -> int:
    """Elements, first in the common order, among which a set has its first one in common with any set that it links with."""
    p, q = LINK
    return n - -(-p * n // q) + 1


def index_length(n: int) -> int:
    """The same for partners at least as large as the set itself: what lies behind an element further on is too little for them."""
    p, q = LINK
    return n - -(-2 * p * n // (p + q)) + 1


def bitmap(own: np.ndarray) -> np.ndarray:
    out = np.zeros(BITMAP, np.uint8)
    out[(own & U64(BITMAP - 1)).astype(np.int64)] = 1
    return np.packbits(out).view(np.uint64)


def may_link(bits_a: np.ndarray, a: np.ndarray, bits_b: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the bitmaps allow an intersection that is large enough: a bit that only one set has stands for an element that only it has."""
    only_a = np.bitwise_count(bits_a & ~bits_b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(bits_b & ~bits_a).sum(axis=-1, dtype=np.int64)
    return np.minimum(a - only_a, b - only_b) >= least_overlap(a, b)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """The intersection of two sorted arrays of distinct numbers."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def links_within(ids: list, sets: list[np.ndarray]) -> Iterator[tuple]:
    """Links that join all linked documents of a small group; documents that are joined already aren't compared."""
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    ids, sets = [ids[i] for i in order], [sets[i] for i in order]
    n = np.array([len(s) for s in sets])
    bits = np.stack([bitmap(s) for s in sets])
    label = np.arange(len(ids))
    for i in range(1, len(ids)):
        low = int(np.searchsorted(n, -(-LINK[0] * n[i] // LINK[1])))
        if low >= i:
            continue
        js = low + np.flatnonzero(may_link(bits[low:i], n[low:i], bits[i], n[i]))
        for j in js:
            if label[i] != label[j] and overlap(sets[i], sets[j]) >= least_overlap(n[i], n[j]):
                yield ids[j], ids[i]
                label[label == label[i]] = label[j]


def _digest(own: np.ndarray) -> tuple[int, int]:
    raw = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, U64).view(np.int64)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def set_table(texts: DataFrame, k: int) -> DataFrame:
    """For each document its set's size, 128-bit digest and two minimal hashes (kind 0); for common shingles their counts (kind 1)."""

    def read(batches):
        run: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()
        size = 0

        def told():
            if not run:
                return
            values, times = np.unique(np.concatenate(run), return_counts=True)
            often = times >= RUN_TIMES
            m = int(often.sum())
            none = pa.nulls(m, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), none, pa.array(times[often].astype(np.int64)), pa.array(_signed(values[often])), none, none, none], names=names)

        names = ["kind", "doc_id", "n", "d1", "d2", "m1", "m2"]
        for batch in batches:
            rows = np.zeros((batch.num_rows, 5), np.int64)
            for i, own in shingle_sets(batch.column(1), k):
                if not len(own):
                    continue
                d1, d2 = _digest(own)
                rows[i] = len(own), d1, d2, *minimal_hashes(own)
                if (d1, d2) not in seen:  # copies count once in a run
                    seen.add((d1, d2))
                    run.append(own)
                    size += len(own)
                if size >= RUN:
                    yield from told()
                    run, seen, size = [], set(), 0
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(rows), np.int32)), batch.column(0), *(pa.array(rows[:, j]) for j in range(5))], names=names)
        yield from told()

    return texts.mapInArrow(read, "kind int, doc_id long, n long, d1 long, d2 long, m1 long, m2 long")


def _wanted_sets(texts: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, bits, own) of the documents in ``wanted`` (and, rarely, others): a scan through a filter of their ids."""
    words = id_filter.build(wanted, "doc_id")

    def read(batches):
        for batch in batches:
            batch = batch.filter(pa.array(id_filter.holds(words, batch.column(2).to_numpy())))
            ids, sizes, bits, sets = [], [], [], []
            for i, own in shingle_sets(batch.column(1), k):
                ids.append(batch.column(0)[i].as_py())
                sizes.append(len(own))
                bits.append(bitmap(own).tobytes())
                sets.append(own.tobytes())
                if len(ids) >= 512:
                    yield _set_batch(ids, sizes, bits, sets)
                    ids, sizes, bits, sets = [], [], [], []
            yield _set_batch(ids, sizes, bits, sets)

    found = texts.filter("doc_id is not null").withColumn("place", id_filter.place(F.col("doc_id")))
    return found.mapInArrow(read, "doc_id long, n long, bits binary, own binary")


def _set_batch(ids, sizes, bits, sets):
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), pa.array(sets, pa.binary())], names=["doc_id", "n", "bits", "own"])


def _group_links(rows: DataFrame) -> DataFrame:
    """Links (as digests) inside the groups (key, deal) of rows (key, deal, d1, d2, own). So many sets as 4 * GROUP are held and compared at once."""

    def compare(batches):
        at, sets, out = None, {}, []
        for batch in batches:
            for key, deal, d1, d2, own in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (key, deal) != at or len(sets) >= 4 * GROUP:
                    if len(sets) > 1:
                        out += links_within(list(sets), list(sets.values()))
                    at, sets = (key, deal), {}
                sets[d1, d2] = np.frombuffer(own, U64)
            yield told(out)
            out = []
        if len(sets) > 1:
            out += links_within(list(sets), list(sets.values()))
        yield told(out)

    def told(links):
        return pa.RecordBatch.from_arrays([pa.array([x[i][j] for x in links], pa.int64()) for i in (0, 1) for j in (0, 1)], names=["a1", "a2", "b1", "b2"])

    return rows.repartition("key", "deal").sortWithinPartitions("key", "deal").mapInArrow(compare, "a1 long, a2 long, b1 long, b2 long")


def _link_batch(links):
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])


def minimal_hashes(own: np.ndarray) -> tuple[int, int]:
    return int(_signed(own[:1])[0]), int(_signed(mix(own ^ U64(0x5851F42D4C957F2D)).min(keepdims=True))[0])


def near_links(texts: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """Links between documents that share a minimal hash, enough of them to join most groups of near copies.

    A scan sends the sets of such documents to their groups, through a filter of the hashes that several sets have. A large group
    is dealt at random into groups of about GROUP; as documents have two minimal hashes, dealt apart, what
    one deal separates the other joins.
    """
    keys = sets.select(F.explode(F.array("m1", F.expr("~m2"))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    often = cut(keys.filter("n > 1"))
    words = id_filter.build(often, "key", hashed=True)
    parts = {r["key"]: -(-r["n"] // GROUP) for r in most_frequent(often, "n", GROUP + 1, MAX_DEALT).collect()}

    def read(batches):
        seen: set[tuple[int, int]] = set()
        names, kinds = ["key", "deal", "d1", "d2", "own"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        told = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)
        for batch in batches:
            rows, size = [], 0
            for _, own in shingle_sets(batch.column(0), k):
                if not len(own):
                    continue
                m1, m2 = minimal_hashes(own)
                wanted = [key for key in (m1, ~m2) if int(words[(key % id_filter.BITS) >> 6]) >> (key % 64) & 1]
                if not wanted:
                    continue
                d1, d2 = whole = _digest(own)
                if whole in seen:
                    continue
                if len(seen) >= 1_000_000:
                    seen = set()
                seen.add(whole)
                data = own.tobytes()
                rows += [(key, (d1 ^ key) % parts.get(key, 1), d1, d2, data) for key in wanted]
                size += len(data)
                if size >= 4 << 20:
                    yield told(rows)
                    rows, size = [], 0
            yield told(rows)

    links = _group_links(texts.select("text").mapInArrow(read, "key long, deal int, d1 long, d2 long, own binary")).distinct()
    one, other = (sets.select(F.col("d1").alias(f"{x}1"), F.col("d2").alias(f"{x}2"), F.col("doc_id").alias(f"{x}_id")) for x in "ab")
    return cut(links.join(one, ["a1", "a2"]).join(other, ["b1", "b2"]).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))


def tile_rows(texts: DataFrame, common: np.ndarray, k: int) -> DataFrame:
    """(shingle, d1, at): the first elements of each set, rare shingles before ``common`` ones and else by hash, and their places in that order.

    Sets that link share one of these.
    """

    def read(batches):
        seen: set[tuple[int, int]] = set()
        held = 0
        for batch in batches:
            parts: list[np.ndarray] = []
            ids, lengths = [], []
            for _, own in shingle_sets(batch.column(0), k):
                if not len(own):
                    continue
                d1, _ = whole = _digest(own)
                if whole in seen:
                    continue
                seen.add(whole)
                held += len(own)
                if held >= RUN:
                    seen, held = set(), 0
                if len(common):
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    often = common[at] == own
                    own = np.concatenate([own[~often], own[often]]) if often.any() else own
                first = own[: probe_length(len(own))]
                parts.append(first)
                ids.append(d1)
                lengths.append(len(first))
                if sum(lengths[-64:]) > 200_000 or len(ids) >= 2000:
                    yield tiles(parts, ids, lengths)
                    parts, ids, lengths = [], [], []
            if ids:
                yield tiles(parts, ids, lengths)

    def tiles(parts, ids, lengths):
        at = np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])
        return pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(parts))), pa.array(np.repeat(np.array(ids, np.int64), lengths)), pa.array(at)], names=["shingle", "d1", "at"])

    return texts.select("text").mapInArrow(read, "shingle long, d1 long, at int")


def candidate_pairs(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of documents of different components that share a tile and can link by what lies behind it.

    A tile is a shingle and a size band; bands are so wide that linked sets are in one band or in neighbouring ones, and a set is also a
    guest in the tile of the next larger band. Tiles of one set, or of one component, drop out before anything is paired.
    A pair counts in the tile of the first element that its sets have in common: there, as many elements as the shorter rest has can
    still be shared, and they must be enough to link. So a pair is passed over where both sets have the same element ahead of the
    tile's (of those in tiles of several sets), as they have met there; sets that are alike over long stretches meet once for each
    stretch, not for each element.
    """
    by_shingle = Window.partitionBy("shingle")
    shared = rows.withColumns({"least": F.min("d1").over(by_shingle), "most": F.max("d1").over(by_shingle)}).filter("least <> most")
    known = sets.select("d1", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    shared = shared.select("shingle", "d1", "at").repartition("d1").distinct().join(known, "d1")
    shared = shared.withColumn("before", F.lag("shingle").over(Window.partitionBy("d1", "doc_id").orderBy("at")))
    # tiles of one component, or in which all have the same element ahead, make no pair
    ends = {"least": F.min("component"), "most": F.max("component"), "low": F.min("before"), "high": F.max("before"), "ahead": F.count("before"), "all": F.count(F.lit(1))}
    shared = shared.withColumns({name: value.over(by_shingle) for name, value in ends.items()}).filter("least <> most and (ahead < all or low <> high)")
    width = float(np.log(LINK[1] / LINK[0]))
    columns = ("doc_id", "n", "at", "before", "component", "band")
    shared = cut(shared.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / width + 1e-9).cast("int")).select("shingle", *columns))
    home = shared.select("shingle", F.col("band").alias("tile"), *[F.col(c).alias(f"a_{c}") for c in columns])
    guests = shared.select("shingle", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("tile"), *[F.col(c).alias(f"b_{c}") for c in columns])
    p, q = LINK
    paired = home.join(guests, ["shingle", "tile"]).filter("a_component <> b_component and (b_band < a_band or a_doc_id < b_doc_id)")
    paired = paired.filter(f"{q} * least(a_n, b_n) >= {p} * greatest(a_n, b_n)")
    paired = paired.filter(f"{p + q} * least(a_n - a_at, b_n - b_at) >= {p} * (a_n + b_n) and not coalesce(a_before = b_before, false)")
    return paired.select(F.least("a_doc_id", "b_doc_id").alias("a"), F.greatest("a_doc_id", "b_doc_id").alias("b")).distinct()


def verified_links(texts: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The pairs that link: first by what their bitmaps allow, then by intersecting their sorted sets."""
    pairs = cut(pairs)
    ends = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    found = cut(_wanted_sets(texts, ends, k).join(ends, "doc_id", "left_semi"))

    def ended(links: DataFrame, column: str) -> DataFrame:
        one, other = (found.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col(column).alias(f"x{x}")) for x in "ab")
        return links.join(one, "a").join(other, "b").select("a", "b", "na", "nb", "xa", "xb")

    def bound(batches):
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            xa, xb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, BITMAP // 64) for i in (4, 5))
            yield batch.filter(pa.array(may_link(xa, na, xb, nb))).select(["a", "b"])

    def exact(batches):
        for batch in batches:
            out = []
            for a, b, na, nb, xa, xb in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if overlap(np.frombuffer(xa, U64), np.frombuffer(xb, U64)) >= least_overlap(na, nb):
                    out.append((a, b))
            yield _link_batch(out)

    likely = ended(pairs, "bits").mapInArrow(bound, "a long, b long")
    return cut(ended(likely, "own").mapInArrow(exact, "a long, b long"))


def near_duplicates(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document: groups of documents linked by the Jaccard likeness of their k-word shingles.

    Exact, without a cap on partners: documents with equal sets are one; most groups of near copies are joined in small dealt groups
    (``near_links``); then all pairs of sets that could still link between components meet in tiles (``candidate_pairs``) and are verified.

    Null or empty texts, or texts without words, have no shingles and link with nothing. Rows with a null id are returned with
    a null component and link with nothing. Rows that share an id share its component; if
    their texts differ, the id links with what any of them links with. No rows: no rows. Other columns are not read.
    """
    texts = _texts(docs, id_col, text_col)
    table = cut(set_table(texts, k))
    every = table.filter("kind = 0")
    sets = cut(every.filter("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("m1").alias("m1"), F.min("m2").alias("m2")))
    counts = table.filter("kind = 1").groupBy("d1").agg(F.sum("n").alias("times"))
    common = most_frequent(counts, "times", COMMON, MAX_COMMON).select("d1").toPandas()["d1"]
    common = np.sort(common.to_numpy(np.int64).view(U64))

    near = near_links(texts, sets, k)
    joined = components(near)
    sets = cut(sets.join(joined.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left"))
    far = verified_links(texts, candidate_pairs(tile_rows(texts, common, k), sets), k)
    # an id with several texts stands for several sets; they count as linked
    same = every.filter("n > 0 and doc_id is not null").join(sets.select("d1", "d2", F.col("doc_id").alias("first")), ["d1", "d2"])
    several = same.groupBy("doc_id").agg(F.min("first").alias("a"), F.max("first").alias("b")).filter("a <> b").select("a", "b")
    final = components(near.unionByName(far).unionByName(several)).select(F.col("node").alias("first"), "component")
    grouped = sets.select("d1", "d2", F.col("doc_id").alias("first")).join(final, "first", "left").select("d1", "d2", F.coalesce("component", "first").alias("component_id"))
    out = every.select("doc_id", "n", "d1", "d2").join(grouped, ["d1", "d2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
