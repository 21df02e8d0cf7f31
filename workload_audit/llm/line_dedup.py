"""Line dedup by a segment-partition edit join (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import id_filter
from .components import components
from .features import text_key
from .fingerprints import settle
from .frequent import most_frequent
from .storage import Rounds, cut, unwrapped, wrapped

#: Edits (characters put in, left out or replaced) within which two lines are near copies, and the characters from which lines are compared at all.
MAX_EDITS, MIN_CHARS = 2, 20
#: Lines that share a substring key are compared in blocks of about this many.
BLOCK = 2048
#: Keys are counted in runs of this many lines; a run tells of those that at least RUN_TIMES of its lines have.
RUN, RUN_TIMES = 250_000, 8
#: Hot keys that the scan refines at once, at most, the hottest first. So any other key has less than one in MAX_HOT of all rows; where
#: it has many lines even so, they are told apart by what is refined and dealt in a second step.
MAX_HOT = 1 << 16
#: Bits of a parity's blocks: of lines within two edits, whose parities differ in four bits at most, one block is equal.
PARITY_BLOCKS = (7, 7, 6, 6, 6)
INDEX, PROBE = 1, 2
KEY_MASK = (1 << 40) - 1
#: From this bit on a refined key has the number of its parity block, and a plain key nothing.
REFINED = 56
U64 = np.uint64


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """Starts and lengths of the edits + 1 segments of a line of ``length`` characters; the longer ones are last."""
    size, longer = divmod(length, edits + 1)
    out, at = [], 0
    for i in range(edits + 1):
        own = size + (i > edits - longer)
        out.append((at, own))
        at += own
    return out


def segment_key(part: str, seed: int) -> int:
    """The key of a segment. Its 40 bits keep rows small; keys that meet by chance only make lines meet that then fail to match."""
    return xxhash.xxh3_64_intdigest(part, seed) & KEY_MASK


def signatures(line: str, edits: int) -> Iterator[tuple[int, int]]:
    """(key, roles) of a line: its own segments, and its substrings that can equal a segment of a line as long or up to ``edits`` shorter.

    At most ``edits`` edits leave one of edits + 1 segments as it is. If segment i (from 0) is the first
    such one, i edits at most lie before it and the others after it; so it has moved by no
    more than i places, and by no more than edits - i from where the difference in length would put it.
    """
    for at, end, seed, role in signature_places(len(line), edits):
        yield segment_key(line[at:end], seed), role


@lru_cache(maxsize=4096)
def signature_places(n: int, edits: int) -> list[tuple[int, int, int, int]]:
    """(start, end, seed, roles) of the keys of a line of ``n`` characters."""
    out = []
    for shorter in range(min(edits, n - edits - 1) + 1):
        for i, (start, size) in enumerate(segments(n - shorter, edits)):
            low = max(start - i, start + shorter - (edits - i), 0)
            high = min(start + i, start + shorter + (edits - i), n - size)
            seed = (n - shorter) * 16 + i
            out += [(at, at + size, seed, INDEX | PROBE if not shorter and at == start else PROBE) for at in range(low, high + 1)]
    return out


def parity(line: str) -> int:
    """For 32 classes of characters, whether their number is odd. An edit changes two of them at most."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    return int(np.bitwise_xor.reduce(np.uint32(1) << ((codes * np.uint32(2654435761)) >> np.uint32(27))))


def within(a: str, b: str, edits: int) -> bool:
    """Whether ``edits`` edits at most turn ``a`` into ``b``.

    Bit d of state e says whether i characters of a and i + d - edits of b can be
    matched with e edits; the 2 * edits + 1 diagonals of the band move on together, a character of a at a time.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if max(len(a), len(b)) <= edits:
        return True
    states = [1 << edits]
    for _ in range(edits):
        states.append(states[-1] | states[-1] << 1)
    for i, c in enumerate(a):
        match = 0
        for d in range(2 * edits + 1):
            at = i + d - edits
            if 0 <= at < len(b) and b[at] == c:
                match |= 1 << d
        allowed = (1 << min(2 * edits + 1, max(0, len(b) - i - 1 + edits + 1))) - 1  # not beyond the end of b
        new = [states[0] & match & allowed]
        for e in range(1, edits + 1):
            new.append(((states[e] & match) | states[e - 1] | states[e - 1] >> 1 | new[e - 1] << 1) & allowed)
        states = new
        if not states[-1]:
            return False
    return bool(states[-1] >> (len(b) - len(a) + edits) & 1)


def parity_blocks(edits: int) -> list[tuple[int, int]]:
    """First bit and bits of 2 * edits + 1 blocks of a parity, of which lines within ``edits`` edits have an equal one."""
    sizes = PARITY_BLOCKS if edits == 2 else [32 // (2 * edits + 1) + (i < 32 % (2 * edits + 1)) for i in range(2 * edits + 1)]
    return [(sum(sizes[:i]), size) for i, size in enumerate(sizes)]


def refined(key: int, sign: int, edits: int) -> list[int]:
    """The keys of a line of a hot key: one for each block of its parity ``sign``, so that a line goes to a few groups, however many lines the key has."""
    return [key | (sign >> first & (1 << size) - 1) << 40 | 1 + i << REFINED for i, (first, size) in enumerate(parity_blocks(edits))]


def line_hash(line: str) -> tuple[int, int]:
    whole = xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"))
    return _signed(whole >> 64), _signed(whole & (1 << 64) - 1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _batch(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def occurrences(texts: DataFrame, edits: int, least: int, exact: int) -> DataFrame:
    """Where each line stands (kind 0: h1, h2, doc_id, key, line), and the counts of frequent segment keys (kind 1: h1 is the key, h2 its lines)."""
    names, kinds = ["kind", "h1", "h2", "doc_id", "key", "line"], [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]

    def read(batches):
        keys: list[int] = []
        seen: set[tuple[int, int]] = set()

        def told():
            values, times = np.unique(np.array(keys, U64), return_counts=True)
            often = times >= RUN_TIMES
            return _batch(names, kinds, [(1, k, n, None, None, None) for k, n in zip(values[often].view(np.int64).tolist(), times[often].tolist(), strict=True)])

        for batch in batches:
            rows = []
            for doc, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                for at, line in enumerate((text.as_py() or "").split("\n")):
                    if len(line) >= exact:
                        h1, h2 = line_hash(line)
                        rows.append((0, h1, h2, doc, own, at))
                        if len(line) >= least and (h1, h2) not in seen:
                            seen.add((h1, h2))
                            for i, (start, size) in enumerate(segments(len(line), edits)):
                                keys.append(segment_key(line[start : start + size], len(line) * 16 + i))
                if len(rows) >= 50_000:
                    yield _batch(names, kinds, rows)
                    rows = []
                if len(seen) >= RUN:
                    yield told()
                    keys, seen = [], set()
            yield _batch(names, kinds, rows)
        yield told()

    return texts.mapInArrow(read, "kind int, h1 long, h2 long, doc_id long, key long, line int")


def row_keys(df: DataFrame, doc_id: Column, text: Column, twins: DataFrame | None) -> DataFrame:
    """``df`` with ``_key``, which with the id tells a row: the text's hash, and from the second of the rows in ``twins`` on, which are equal in both, a hash of its number too."""
    keyed = df.withColumns({"_key": text_key(text), "_of": doc_id})
    if twins is None:
        return keyed.drop("_of")
    same = F.col("_of").eqNullSafe(F.col("twin_id")) & (F.col("_key") == F.col("twin_key"))
    # by all that the row holds, so that a second reading numbers them alike
    place = F.row_number().over(Window.partitionBy("_of", "_key").orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    several = keyed.join(twins, same, "left_semi").withColumn("_place", place)
    several = several.withColumn("_key", F.when(F.col("_place") > 1, F.xxhash64("_key", "_place")).otherwise(F.col("_key"))).drop("_place")
    return keyed.join(twins, same, "left_anti").unionByName(several).drop("_of")


def key_rows(texts: DataFrame, hot: set[int], edits: int, least: int) -> DataFrame:
    """(key, line, mark) of each different line: its keys, refined where they are ``hot``, and in ``mark`` its roles (2 bits) and its parity."""
    hottest = np.array(sorted(hot), np.int64)
    hashed = xxhash.xxh3_64_intdigest

    def told(keys, roles, lines, lows, counts):
        line, mark = np.repeat(np.array(lines, np.int64), counts), np.repeat(np.array(lows, np.int64), counts) | np.array(roles, np.int64)
        key = np.array(keys, np.int64)
        dealt = np.isin(key, hottest)
        if dealt.any():
            rows = [(k, x, m) for own, x, m in zip(key[dealt].tolist(), line[dealt].tolist(), mark[dealt].tolist(), strict=True) for k in refined(own, m >> 2, edits)]
            key, line, mark = (np.concatenate([x[~dealt], np.array(more, x.dtype)]) for x, more in zip((key, line, mark), zip(*rows, strict=True), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(line), pa.array(mark)], names=["key", "line", "mark"])

    def read(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keys, roles, lines, lows, counts = [], [], [], [], []
            for text in batch.column(0):
                for line in (text.as_py() or "").split("\n"):
                    if len(line) < least:
                        continue
                    whole = line_hash(line)
                    if whole in seen:
                        continue
                    if len(seen) >= 2 * RUN:
                        seen = set()
                    seen.add(whole)
                    places = signature_places(len(line), edits)
                    lines.append(whole[0])
                    lows.append(parity(line) << 2)
                    counts.append(len(places))
                    keys += [hashed(line[at:end], seed) & KEY_MASK for at, end, seed, _ in places]
                    roles += [role for _, _, _, role in places]
                if len(keys) >= 100_000:
                    yield told(keys, roles, lines, lows, counts)
                    keys, roles, lines, lows, counts = [], [], [], [], []
            yield told(keys, roles, lines, lows, counts)

    return texts.select("text").mapInArrow(read, "key long, line long, mark long")


def pair_rows(rows: DataFrame, edits: int, rounds: Rounds) -> DataFrame:
    """Pairs (a, b) of lines that share a key and whose parities allow ``edits`` edits.

    A key's group of more than 4 * BLOCK rows is not compared at first but passed on, row by row. What is passed on is refined
    by the blocks of the parities, counted, and dealt into parts of about BLOCK lines; each pair of an index part and a probe part is a group of its own.
    """
    first = rounds.keep(_compared(rows, edits, 4 * BLOCK))
    left = first.filter("key is not null").select("key", F.col("a").alias("line"), F.col("b").alias("mark"))
    pairs = first.filter("key is null").select("a", "b")
    if left.isEmpty():
        return pairs.distinct()
    own = [
        F.col("key").bitwiseOR(F.shiftleft(F.shiftright("mark", 2 + at).bitwiseAND(F.lit((1 << size) - 1).cast("long")), 40)).bitwiseOR(F.lit(1 + i << REFINED))
        for i, (at, size) in enumerate(parity_blocks(edits))
    ]
    own = F.when(F.shiftright("key", REFINED) == 0, F.array(*own)).otherwise(F.array("key"))
    # a line that several tasks have seen counts once
    left = rounds.keep(left.distinct().select(F.explode(own).alias("key"), "line", "mark"))
    large = left.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")).filter("parts > 1")
    dealt = left.join(large, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("line"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    one_role = lambda role: F.col("mark").bitwiseAND(F.lit(-4).cast("long")).bitwiseOR(F.lit(role).cast("long"))
    index = F.transform(every, lambda p: F.struct((F.col("own") * F.col("parts") + p).alias("part"), one_role(INDEX).alias("mark")))
    probe = F.transform(every, lambda p: F.struct((p * F.col("parts") + F.col("own")).alias("part"), one_role(PROBE).alias("mark")))
    nothing = F.array().cast("array<struct<part:int,mark:long>>")
    has = lambda role: F.col("mark").bitwiseAND(F.lit(role).cast("long")) != 0
    places = F.concat(F.when(has(INDEX), index).otherwise(nothing), F.when(has(PROBE), probe).otherwise(nothing))
    # groups whose hashes meet by chance only make lines meet that then fail to match
    dealt = dealt.select("key", "line", F.explode(places).alias("to")).select(F.xxhash64("key", "to.part").alias("key"), "line", "to.mark")
    return pairs.unionByName(_compared(dealt, edits, None).select("a", "b")).distinct()


def _compared(rows: DataFrame, edits: int, most: int | None) -> DataFrame:
    """(a, b) of the pairs in the groups (key) of ``rows``, and (line, mark, key) of the rows of groups of more than ``most``."""
    names, kinds = ["a", "b", "key"], [pa.int64()] * 3

    def run_pairs(line: np.ndarray, mark: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        index, probe = np.flatnonzero(mark & INDEX), np.flatnonzero(mark & PROBE)
        bits = (mark >> 2).astype(U64)
        for a in range(0, len(index), 1024):
            for b in range(0, len(probe), 1024):
                x, y = index[a : a + 1024], probe[b : b + 1024]
                near = np.bitwise_count(bits[x][:, None] ^ bits[y][None, :]) <= 2 * edits
                i, j = np.nonzero(near & (line[x][:, None] != line[y][None, :]))
                yield line[x[i]], line[y[j]]

    def told(found):
        if not found:
            return _batch(names, kinds, [])
        a, b = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        both = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.nulls(len(both), pa.int64())], names=names)

    def passed(key, line, mark):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (line, mark, key)], names=names)

    def compare(batches):
        rest: list[np.ndarray] = [np.empty(0, np.int64)] * 3
        passing = None  # the key whose rows are passed on as they come
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(3)]
            if passing is not None and len(columns[0]):
                same = columns[0] == passing
                if same.any():
                    yield passed(*(x[same] for x in columns))
                    columns = [x[~same] for x in columns]
                if len(columns[0]):
                    passing = None
            key, line, mark = (np.concatenate([r, x]) for r, x in zip(rest, columns, strict=True))
            if not len(key):
                continue
            starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
            rest = [x[starts[-1] :] for x in (key, line, mark)]  # the last group may go on in the next batch
            yield from groups(starts, key, line, mark)
            if most and len(rest[0]) > most:
                passing = int(rest[0][0])
                yield passed(*rest)
                rest = [x[:0] for x in rest]
        yield from groups(np.array([0, len(rest[0])]), *rest)

    def groups(starts: np.ndarray, key: np.ndarray, line: np.ndarray, mark: np.ndarray):
        """What all groups but the one at the last start give."""
        size = np.diff(starts)
        two = starts[:-1][size == 2]
        found = []
        if len(two):  # most groups, all at once
            x, y = two, two + 1
            either = ((mark[x] & INDEX) > 0) & ((mark[y] & PROBE) > 0) | ((mark[y] & INDEX) > 0) & ((mark[x] & PROBE) > 0)
            near = np.bitwise_count(((mark[x] ^ mark[y]) >> 2).astype(U64)) <= 2 * edits
            ok = either & near & (line[x] != line[y])
            found.append((line[x[ok]], line[y[ok]]))
        for s, n in zip(starts[:-1][size > 2], size[size > 2], strict=True):
            own = slice(s, s + n)
            if most and n > most:
                yield passed(key[own], line[own], mark[own])
            else:
                found += run_pairs(line[own], mark[own])
        yield told(found)

    return rows.select("key", "line", "mark").repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long, key long")


def line_links(texts: DataFrame, pairs: DataFrame, edits: int, least: int) -> DataFrame:
    """Links (a, b) between lines within ``edits`` edits of each other, each told by both halves of its hash: of the pairs, which have the
    first halves, every line with such a half is compared itself."""
    pairs = cut(pairs)
    ends = cut(pairs.select(F.col("a").alias("h1")).unionByName(pairs.select(F.col("b").alias("h1"))).distinct())

    def verify(batches):
        for batch in batches:
            ok = [within(x, y, edits) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a1", "a2", "b1", "b2"])

    found = cut(wanted_lines(texts, ends, least))
    one, other = (found.select(F.col("h1").alias(f"{x}1"), F.col("h2").alias(f"{x}2"), F.col("content").alias(f"x{x}")) for x in "ab")
    met = pairs.select(F.col("a").alias("a1"), F.col("b").alias("b1")).join(one, "a1").join(other, "b1").select("a1", "a2", "b1", "b2", "xa", "xb")
    linked = met.mapInArrow(verify, "a1 long, a2 long, b1 long, b2 long")
    return cut(linked.select(F.struct(F.col("a1").alias("h1"), F.col("a2").alias("h2")).alias("a"), F.struct(F.col("b1").alias("h1"), F.col("b2").alias("h2")).alias("b")))


def wanted_lines(texts: DataFrame, ends: DataFrame, least: int) -> DataFrame:
    """(h1, h2, content) of the lines in ``ends``, once each: a scan through a filter of their hashes."""
    words = id_filter.build(ends, "h1", hashed=True)

    def read(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            rows = []
            for text in batch.column(0):
                for line in (text.as_py() or "").split("\n"):
                    if len(line) >= least:
                        h1, h2 = whole = line_hash(line)
                        at = h1 % id_filter.BITS
                        if int(words[at >> 6]) >> (at & 63) & 1 and whole not in seen:  # a frequent line once from each task
                            seen = seen if len(seen) < RUN else set()
                            seen.add(whole)
                            rows.append((h1, h2, line))
                if len(rows) >= 5_000:
                    yield _batch(["h1", "h2", "content"], [pa.int64(), pa.int64(), pa.string()], rows)
                    rows = []
            yield _batch(["h1", "h2", "content"], [pa.int64(), pa.int64(), pa.string()], rows)

    found = texts.select("text").mapInArrow(read, "h1 long, h2 long, content string")
    return found.join(ends, "h1", "left_semi").groupBy("h1", "h2").agg(F.min("content").alias("content"))


def dedup_lines(
    docs: DataFrame, edits: int = MAX_EDITS, least: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", apart: bool = False,
    exact: int | None = None,
) -> DataFrame:
    """``docs`` without the lines that repeat an earlier line: all columns, the text shortened, and _lines, _dropped and _near.

    Lines (between newlines) of at least ``least`` characters that are equal or at most ``edits``
    edits apart are linked, and linked lines are one class. The first line of a class, by document id, text hash and place, stays; all
    others go, with their newline. Of shorter lines those of at least ``exact`` characters (``least`` without it) go where they are equal to an earlier one; others always stay. _dropped lists what goes as (line, near, kept_doc, kept_line):
    its place, whether it differs from all equal earlier ones, and where the class's first line is; _lines counts all lines, _near those dropped that aren't exact copies of the first.

    Null text: stays null, 0 lines. Empty text: one empty line. Rows that share an id, null
    included, are told apart by their texts. Rows equal in id and text are one document, whose kept lines stay in each of them; with
    ``apart`` they are documents too, and the first one keeps its lines. Null ids come first. Columns with the
    names of the three added ones are replaced; all others are kept. No rows: no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    twins = None
    if apart:
        equal = texts.groupBy(F.col("doc_id").alias("twin_id"), text_key(F.col("text")).alias("twin_key")).count().filter("count > 1")
        twins = cut(equal.drop("count"))
        twins = None if twins.isEmpty() else twins
    texts = row_keys(texts, F.col("doc_id"), F.col("text"), twins)
    with Rounds(docs.sparkSession) as rounds:
        table = rounds.keep(occurrences(texts, edits, least, least if exact is None else min(exact, least)))
        counts = table.filter("kind = 1").groupBy("h1").agg(F.sum("h2").alias("n"))
        hot = {r["h1"] for r in most_frequent(counts, "n", BLOCK, MAX_HOT).collect()}
        pairs = pair_rows(key_rows(texts, hot, edits, least), edits, rounds)
        links = line_links(texts, pairs, edits, least)
        joined = components(links).select("node.h1", "node.h2", "component")

        places = table.filter("kind = 0").drop("kind")
        lines = places.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "key", "line")).alias("first"))
        lines = lines.join(joined, ["h1", "h2"], "left")
        alone = lines.filter("component is null and n > 1").select("h1", "h2", F.col("first").alias("kept"), F.col("h1").alias("k1"), F.col("h2").alias("k2"))
        classed = lines.filter("component is not null")
        firsts = classed.groupBy("component").agg(F.min(F.struct("first", "h1", "h2")).alias("f"))
        classed = classed.join(firsts, "component").select("h1", "h2", F.col("f.first").alias("kept"), F.col("f.h1").alias("k1"), F.col("f.h2").alias("k2"))
        repeated = cut(alone.unionByName(classed))
        gone = places.join(repeated, ["h1", "h2"]).filter("not (doc_id <=> kept.doc_id and key = kept.key and line = kept.line)")
        near = ((F.col("h1") != F.col("k1")) | (F.col("h2") != F.col("k2"))).alias("near")
        by_doc = cut(gone.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_row")).agg(
            F.array_sort(F.collect_set(F.struct("line", near, F.col("kept.doc_id").alias("kept_doc"), F.col("kept.line").alias("kept_line")))).alias("_dropped")
        ))
    base = docs.select(wrapped(docs), F.col(id_col).cast("long").alias("_at"))
    base = row_keys(base, F.col("_at"), F.col("row")[text_col], twins)
    nothing = F.array().cast("array<struct<line:int,near:boolean,kept_doc:long,kept_line:int>>")
    # rows without a dropped line, most of them, pass as they are; the rest, and a few that share a bit with them, meet their lines
    touched = id_filter.maybe(by_doc.select(id_filter.place(F.col("_id"), F.col("_row")).alias("place")), F.col("_at"), F.col("_key"))
    met = base.filter(touched).join(by_doc, F.col("_at").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_row")), "left")
    text = F.col("row")[text_col]
    whole = settle(met.select("row", F.coalesce("_dropped", nothing).alias("_dropped")), {"_split": F.split(text, "\n", -1)})
    stay = F.array_except(F.sequence(F.lit(0), F.size("_split") - 1), F.transform("_dropped", lambda d: d["line"]))
    kept = F.when(F.size("_dropped") == 0, text).otherwise(F.array_join(F.transform(stay, lambda i: F.get("_split", i)), "\n"))
    near = F.size(F.filter("_dropped", lambda d: d["near"]))
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))

    def shaped(rows: DataFrame, own: Column, lines: Column, dropped: Column, near: Column) -> DataFrame:
        added = {"_lines": F.when(text.isNull(), 0).otherwise(lines), "_dropped": dropped, "_near": near}
        columns = [c for c in docs.columns if c not in added]
        return rows.select(
            *[own.alias(c) if c == text_col else col for c, col in zip(columns, unwrapped(columns), strict=True)], *[c.alias(k) for k, c in added.items()])

    return shaped(whole, kept, F.size("_split"), F.col("_dropped"), near).unionByName(shaped(base.filter(~touched), text, breaks + 1, nothing, F.lit(0)))


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, apart=True, exact=1).select(
        "doc_id", F.col("_lines").alias("n_lines"), F.size("_dropped").alias("n_dropped"), F.col("_near").alias("n_near"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"), F.col("_dropped").alias("dropped"), "text",
    )
