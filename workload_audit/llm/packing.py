"""Best-fit packing of token sequences in bulk-synchronous steps (operator 6)."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import running
from .storage import cut
from .tokens import vocabulary_path, word_ids

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Bytes of texts that are encoded together; a run can be larger by its first text.
RUN_BYTES = 1 << 23


def token_pieces(
    docs: DataFrame, capacity: int = 2048, end_id: int = 0, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The pieces of each document's ids (those of the text, then ``end_id``), of ``capacity`` ids each but the last.

    Null text: only the end id. Texts are encoded whole. Null and repeated ids are kept as they are.
    """
    path = vocabulary or vocabulary_path()

    def cut_up(batches):
        ids = word_ids(path)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            run = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // RUN_BYTES
            bounds = [0, *(np.flatnonzero(np.diff(run)) + 1), len(run)] if len(run) else []
            for a, b in zip(bounds, bounds[1:], strict=False):
                data, ends = ids.encode_all(texts[a:b].to_pylist())
                data = np.insert(data, ends[1:], end_id)
                ends = ends + np.arange(b - a + 1)
                sizes = np.diff(ends)
                n = -(-sizes // capacity)
                doc = np.repeat(np.arange(b - a), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(sizes[doc] - start, capacity)
                at = ends[doc] + start
                crc = [zlib.crc32(data[x:y]) for x, y in zip(at.tolist(), (at + length).tolist(), strict=True)]
                columns = [batch.column(0).take(pa.array(a + doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut_up, PIECES)


def sweep(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Where the pieces of each length go, as rows (length, first rank, pieces per sequence, first sequence, first offset).

    Pieces of one length are alike, and so are sequences with one gap, so a step
    needs only how many there are of each. Lengths come in falling order. In a
    step all pieces of a length look for their successor among the sorted gaps, the smallest
    one that holds them; the lowest ranks take the first gaps (each as many pieces
    as fit, for a gap that still holds one is the best fit again), the next ranks
    the next larger gaps, and ranks that find none open new sequences. Then
    the gaps are updated and the next length follows. This gives the packing of
    best-fit decreasing. There are at most ``capacity`` steps, and each splits
    at most two runs of equal gaps, so the plan's size depends on ``capacity`` alone.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, how many)
    plan: list[tuple[int, int, int, int, int]] = []
    used = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        changed: list[tuple[int, int, int]] = []
        for gap in sorted(g for g in gaps if g >= length):
            each, runs = gap // length, gaps.pop(gap)
            while runs and left:
                first, n = runs.pop()
                full = min(n, left // each)
                some = left - full * each if full < n and left - full * each < each else 0
                if full or some:
                    plan.append((length, rank, each, first, capacity - gap))
                if full:
                    changed.append((gap - each * length, first, full))
                if some:
                    changed.append((gap - some * length, first + full, 1))
                rank, left = rank + full * each + some, left - full * each - some
                if full + bool(some) < n:
                    runs.append((first + full + bool(some), n - full - bool(some)))
            if runs:
                gaps[gap] = runs
            if not left:
                break
        if left:
            each = capacity // length
            full, some = divmod(left, each)
            plan.append((length, rank, each, used, 0))
            if full:
                changed.append((capacity - each * length, used, full))
            if some:
                changed.append((capacity - some * length, used + full, 1))
            used += full + bool(some)
        for gap, first, n in changed:
            if gap:
                gaps.setdefault(gap, []).append((first, n))
    return np.array(plan, np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: best-fit packing into sequences of at most ``capacity`` tokens.

    The pieces are range-sorted by length, and each gets its rank in its length from
    per-partition totals, so a length that many pieces have is not one task.
    The steps of ``sweep`` run on the counts by length (at most ``capacity`` numbers); each
    task then finds the sequences of its pieces by rank. Pieces must have lengths of 1 to ``capacity``. No pieces: no rows.
    """
    pieces = cut(pieces)
    totals = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    if any(not 1 <= r["length"] <= capacity for r in totals):
        raise ValueError(f"a piece's length must be from 1 to {capacity}")
    plan = sweep({r["length"]: r["count"] for r in totals}, capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    keys = plan[:, 0] << 48 | plan[:, 1]
    ranked = running(pieces, [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], group=["length"], index="rank")

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            row = plan[np.searchsorted(keys, length << 48 | rank, "right") - 1]
            turn = rank - row[:, 1]
            rest = [c for c in batch.schema.names if c != "rank"]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(row[:, 3] + turn // row[:, 2]), pa.array(row[:, 4] + turn % row[:, 2] * length)], names=[*rest, "sequence_id", "offset"]
            )

    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    schema = ", ".join(f"`{k}` {v}" for k, v in kinds.items()) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(token_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
