"""Vectorised text work on Arrow string columns: words, hashes, shingles, counts.

All functions work on the UTF-8 bytes of a run of documents at once. Words are
runs of bytes other than 0x20 and 0x09-0x0D, none of which occur inside a
multi-byte character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = U64(0x9DDFEA08EB382D69)
_powers = np.ones(1, U64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``h``."""
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        step = np.full(max(n, 2 * len(_powers)), BASE, U64)
        step[0] = U64(1)
        _powers = np.multiply.accumulate(step)
    return _powers[:n]


def runs(column: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with up to ``most`` bytes; a longer text is a run of its own. Null: empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the words."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | first))
    starts = starts[starts < len(data)]
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | first))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; spans are in order, not empty, and don't overlap."""
    if not len(starts):
        return np.empty(0, U64)
    size = ends - starts
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    within = np.arange(int(size.sum())) - np.repeat(first, size)
    values = (data[within + np.repeat(starts, size)].astype(U64) + U64(1)) * powers(int(size.max()))[within]
    return mix(np.add.reduceat(values, first) + size.astype(U64) * U64(0x9E3779B97F4A7C15))


def windows(words: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows inside a document, and the places of their first words."""
    if len(words) < k:
        return np.empty(0, U64), np.empty(0, np.int64)
    n = len(words) - k + 1
    at = np.flatnonzero(docs[:n] == docs[k - 1 :])
    h = words[at]
    for j in range(1, k):
        h = mix(h * BASE + words[at + j])
    return h, at


def shingle_sets(column: pa.Array, k: int = 5, lower: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes) of each row: its k-word shingles, or the whole of a shorter sequence as one; none without words."""
    for a, b, data, offsets in runs(column):
        data = LOWER[data] if lower else data
        starts, ends, docs = word_spans(data, offsets)
        words = span_hashes(data, starts, ends)
        h, at = windows(words, docs, k)
        bounds = np.searchsorted(docs[at] if len(at) else at, np.arange(b - a + 1))
        w = np.searchsorted(docs, np.arange(b - a + 1))
        for i in range(b - a):
            if bounds[i] < bounds[i + 1]:
                own = np.sort(h[bounds[i] : bounds[i + 1]])
                yield a + i, own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif w[i] < w[i + 1]:
                whole = words[w[i] : w[i + 1]]
                value = whole[:1] + U64(len(whole))
                for x in whole[1:]:
                    value = mix(value * BASE + x)
                yield a + i, mix(value)
            else:
                yield a + i, np.empty(0, U64)


STAT_NAMES = (
    "n_bytes", "n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_upper", "n_digits", "n_shouts", "n_bars", "n_punct", "n_distinct", "longest_word",
)


def _mask(text: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(text)] = True
    return out


_CLASSES = {"n_symbols": _mask(b"#*$%&|<>"), "n_upper": _mask(bytes(range(65, 91))), "n_digits": _mask(b"0123456789"), "n_shouts": _mask(b"!"), "n_bars": _mask(b"|"), "n_punct": _mask(b".,;:!?\"'()-")}
_HEAD = (np.arange(256) & 0xC0) != 0x80  # first bytes of code points


def _per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``STAT_NAMES`` (int64) for each text of ``column``; a null text counts as empty.

    n_dup_lines: lines (split at newlines) that have a word and equal an earlier line of the text.
    n_repeat_words: words inside any 5-word window that occurs twice or more in the text, first ones included.
    """
    out = np.zeros((len(column), len(STAT_NAMES)), np.int64)
    col = {name: out[:, i] for i, name in enumerate(STAT_NAMES)}
    for a, b, data, offsets in runs(column):
        n, head = b - a, _HEAD[data]
        col["n_bytes"][a:b] = np.diff(offsets)
        col["n_chars"][a:b] = _per_doc(head, offsets)
        for name, mask in _CLASSES.items():
            col[name][a:b] = _per_doc(mask[data], offsets)
        col["word_chars"][a:b] = _per_doc(head & ~SPACE[data], offsets)
        starts, ends, docs = word_spans(data, offsets)
        col["n_words"][a:b] = np.bincount(docs, minlength=n)
        np.maximum.at(col["longest_word"][a:b], docs, ends - starts)
        words = span_hashes(data, starts, ends)
        salt = mix(docs.astype(U64) + U64(1))
        own, first = np.unique(words ^ salt, return_index=True)
        col["n_distinct"][a:b] = np.bincount(docs[first], minlength=n)
        h, at = windows(words, docs, 5)
        _, back, times = np.unique(h ^ salt[at], return_inverse=True, return_counts=True)
        again = at[times[back] > 1] if len(at) else at
        edge = np.zeros(len(words) + 6, np.int64)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + 5, -1)
        col["n_repeat_words"][a:b] = np.bincount(docs[np.cumsum(edge)[: len(words)] > 0], minlength=n)
        # lines with a word: from the line's first byte to its newline, compared byte by byte through their hashes
        breaks = np.zeros(len(data) + 1, bool)
        breaks[offsets] = True
        if len(data):
            breaks[1:] |= data == 0x0A
        begin = np.flatnonzero(breaks[:-1])
        stop = np.concatenate([begin[1:], [len(data)]]).astype(np.int64)
        if len(begin):
            newline = data[np.maximum(stop - 1, 0)] == 0x0A
            stop = stop - newline
            ok = stop > begin
            begin, stop = begin[ok], stop[ok]
            seen = np.concatenate([[0], np.cumsum(~SPACE[data], dtype=np.int64)])
            ok = seen[stop] > seen[begin]
            begin, stop = begin[ok], stop[ok]
            owner = np.searchsorted(offsets, begin, "right") - 1
            lines = span_hashes(data, begin, stop) ^ mix(owner.astype(U64) + U64(1))
            _, first = np.unique(lines, return_index=True)
            count = np.bincount(owner, minlength=n)
            col["n_lines"][a:b] = count
            col["n_dup_lines"][a:b] = count - np.bincount(owner[first], minlength=n)
    return out
