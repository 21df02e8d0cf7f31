"""Source divergence audit: Gustavson row accumulation over a term-major index (operator 13).

How far the word use of each source of a language lies from that of every other source, and which terms it
favours. A source's row of the source-by-source matrix is the product of its term row and the term-major index:
each of its terms adds to a dense accumulator with one place per peer. What the terms of only one of two sources
contribute, where the other one has its constant least share, comes from the sources' counts of counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut
from .textops import LOWER, runs

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: A kept term stands in at least this many documents of its language.
LEAST_DOCS = 10
#: Shares are told in units of one of so many.
UNIT = 1_000_000_000
#: Terms listed of each source.
TOP_TERMS = 10
#: Rows of counts that a task gathers before it passes them on, and numbers that its accumulators or one step hold.
HELD_ROWS, HELD_SUMS, STEP = 400_000, 4_000_000, 1_000_000


def term_runs(column: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(first row, terms, the rows they stand in, from 0) of runs of rows. Terms are runs of letters A-Z, in lower case, and of characters beyond ASCII."""
    for a, _, data, offsets in runs(column):
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = LETTER[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        starts = starts[starts < len(data)]
        ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        letters = LOWER[data[inside[1:-1]]]
        places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(letters))
        yield a, terms, np.searchsorted(offsets, starts, "right") - 1


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _summed(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return out.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term; a null term for each group. Each task sums before it shuffles."""

    def count(batches):
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            langs, lang_names = _codes(batch.column(0))
            sources, source_names = _codes(batch.column(1))
            pairs, group = np.unique(langs * len(source_names) + sources, return_inverse=True)
            lang_of, source_of = lang_names.take(pa.array(pairs // max(len(source_names), 1))), source_names.take(pa.array(pairs % max(len(source_names), 1)))
            zero = pa.array(np.zeros(len(pairs), np.int64))
            held.append(pa.table([lang_of, source_of, pa.nulls(len(pairs), pa.string()), zero, zero], names=["lang", "source", "term", "n", "docs"]))
            for first, terms, rows in term_runs(batch.column(2)):
                ids, names = _codes(terms)
                if not len(ids):
                    continue
                own, times = np.unique(rows * len(names) + ids, return_counts=True)
                key = group[first + own // len(names)] * len(names) + own % len(names)
                order = np.argsort(key, kind="stable")
                key, times = key[order], times[order]
                at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                n, many = np.add.reduceat(times, at), np.diff(np.append(at, len(key)))
                which = key[at]
                held.append(pa.table([lang_of.take(pa.array(which // len(names))), source_of.take(pa.array(which // len(names))),
                                      names.take(pa.array(which % len(names))).cast(pa.string()), pa.array(n.astype(np.int64)), pa.array(many.astype(np.int64))],
                                     names=["lang", "source", "term", "n", "docs"]))
                size += len(which)
                if size > HELD_ROWS:
                    held = [_summed(held)]
                    size = held[0].num_rows
                    if size > HELD_ROWS // 2:
                        yield from held[0].to_batches()
                        held, size = [], 0
        if held:
            yield from _summed(held).to_batches()

    found = docs.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * terms)), by long division in steps of 1000, so that totals up to 9 * 10^15 stay exact."""
    d = f"greatest({total} + 2 * {terms}, 1L)"
    out, rest = f"(({n} + 2) div {d})", f"(({n} + 2) % {d})"
    for _ in range(3):
        out, rest = f"({out} * 1000 + ({rest} * 1000) div {d})", f"(({rest} * 1000) % {d})"
    return F.expr(f"1 + {out}").cast("long")


def apart(p, q):
    """floor((p - q)^2 / (p + q)) of positive shares up to UNIT + 1: the square fits 64 bits."""
    return (p - q) * (p - q) // (p + q)


def _acc_batch(lang: str, rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])]).astype(np.int32)
    values = pa.array(np.concatenate([r[1] for r in rows])) if rows else pa.array([], pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["lang", "g", "acc"])


def corrections(postings: DataFrame) -> DataFrame:
    """(lang, g, acc): what terms shared with each peer change against the baselines, summed over the terms of a task.

    ``postings``: the term-major index, (lang, peers, g[], p[], p0[]) per term. In blocks of index rows each source walks its own
    terms and scatters them, through their index rows, into its accumulator over all peers.
    """

    def block_rows(peers: int, g: np.ndarray, p: np.ndarray, p0: np.ndarray, starts: np.ndarray, held: dict[int, np.ndarray]) -> None:
        sizes = np.diff(starts)
        term = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(g, kind="stable")
        bounds = np.flatnonzero(np.concatenate([[True], g[order][1:] != g[order][:-1], [True]]))
        for k in range(len(bounds) - 1):
            own = order[bounds[k] : bounds[k + 1]]  # this source's postings in the block
            acc = held.setdefault(int(g[own[0]]), np.zeros(peers, np.int64))
            ends = np.cumsum(sizes[term[own]])
            a = 0
            while a < len(own):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STEP, "right")))
                part = own[a:b]
                many = sizes[term[part]]
                within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                to = within + np.repeat(starts[term[part]], many)
                x, x0 = np.repeat(p[part], many), np.repeat(p0[part], many)
                np.add.at(acc, g[to], apart(x, p[to]) - apart(x, p0[to]) - apart(x0, p[to]) + apart(x0, p0[to]))
                a = b

    def scatter(batches):
        held: dict[str, dict[int, np.ndarray]] = {}
        size = 0
        for batch in batches:
            langs, names = _codes(batch.column(0))
            peers = batch.column(1).to_numpy()
            lists = [batch.column(i) for i in (2, 3, 4)]
            offsets = lists[0].offsets.to_numpy().astype(np.int64)
            flat = [x.values.to_numpy() for x in lists]
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + STEP, "right")) - 1)
                for code in np.unique(langs[a:b]):
                    rows = a + np.flatnonzero(langs[a:b] == code)
                    sizes = offsets[rows + 1] - offsets[rows]
                    starts = np.concatenate([[0], np.cumsum(sizes)])
                    at = np.arange(starts[-1]) - np.repeat(starts[:-1], sizes) + np.repeat(offsets[rows], sizes)
                    lang = names[int(code)].as_py()
                    own = held.setdefault(lang, {})
                    before = len(own)
                    block_rows(int(peers[rows[0]]), flat[0][at].astype(np.int64), flat[1][at], flat[2][at], starts, own)
                    size += (len(own) - before) * int(peers[rows[0]])
                if size > HELD_SUMS:
                    for lang, accs in held.items():
                        yield _acc_batch(lang, list(accs.items()))
                    held, size = {}, 0
                a = b
        for lang, accs in held.items():
            yield _acc_batch(lang, list(accs.items()))

    return postings.mapInArrow(scatter, "lang string, g int, acc array<long>")


def baselines(rows: DataFrame) -> DataFrame:
    """(lang, g, acc): for each peer, what the source's terms contribute where the peer has its least share, less what they would if the source had it too.

    ``rows``: (lang, g, p0, p[], m[], p0s[]) with the source's distinct shares, how many terms have each, and the peers' least shares.
    """

    def fill(batches):
        for batch in batches:
            for lang, g, p0, p, m, p0s in zip(*(batch.column(i) for i in range(6)), strict=True):
                peers = p0s.values.to_numpy()
                acc = np.zeros(len(peers), np.int64)
                terms = 0
                for share_, many in zip(p.as_py() or [], m.as_py() or [], strict=True):
                    acc += many * apart(share_, peers)
                    terms += many
                yield _acc_batch(lang.as_py(), [(g.as_py(), acc - terms * apart(p0.as_py(), peers))])

    return rows.mapInArrow(fill, "lang string, g int, acc array<long>")


def summed(parts: DataFrame) -> DataFrame:
    """One accumulator per (lang, g): the tasks' accumulators, added as they stream by."""

    def add(batches):
        at, acc = None, None
        for batch in batches:
            done = []
            for lang, g, part in zip(*(batch.column(i) for i in range(3)), strict=True):
                key = (lang.as_py(), g.as_py())
                values = part.values.to_numpy()
                if key != at:
                    if at is not None:
                        done.append((at, acc))
                    at, acc = key, values.copy()
                else:
                    acc = acc + values
            for (lang, g), values in done:
                yield _acc_batch(lang, [(g, values)])
        if at is not None:
            yield _acc_batch(at[0], [(at[1], acc)])

    return parts.repartition("lang", "g").sortWithinPartitions("lang", "g").mapInArrow(add, "lang string, g int, acc array<long>")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): how far sources of a language lie apart (part ``pair``) and the terms they favour (part ``term``).

    Exact in integers. Null text, lang or source: the empty text or name. A language without a kept term has pairs of value 0 and no
    terms; a language with one source has no pairs; no rows: no rows. Texts are read in runs and tables of counts are passed on as they
    fill, so that very long texts and large vocabularies take bounded memory. Repeated rows count as often as they stand there. Equal values rank by the
    item's UTF-8 bytes. Other columns are not read. The result has a row for each pair of sources of a language, and
    a task holds at most a few rows of it.
    """
    base = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = cut(term_counts(base))
    terms = counts.filter("term is not null")
    kept = terms.groupBy("lang", "term").agg(F.sum("docs").alias("d"), F.sum("n").alias("total")).filter(F.col("d") >= least_docs)
    used = cut(terms.join(kept.drop("d"), ["lang", "term"]).select("lang", "source", "term", "n", "total"))
    langs = used.groupBy("lang", "term").agg(F.max("total").alias("total")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("all"))
    sums = used.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    groups = counts.filter("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["own", "v", "all"])
    number = Window.partitionBy("lang").orderBy("source")  # one row per source, as a row of the result has one place for each
    groups = cut(groups.withColumns({"g": F.row_number().over(number) - 1, "p0": share("0", "own", "v")}))

    rows = used.join(groups, ["lang", "source"]).withColumns({"p": share("n", "own", "v"), "q": share("total", "`all`", "v")})
    rows = cut(rows.select("lang", "source", "term", "g", "p0", "p", "q"))
    value = F.expr("((p - q) * (p - q)) div (p + q)")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    favoured = rows.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value"))
    favoured = favoured.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    peers = groups.groupBy("lang").agg(F.expr("transform(array_sort(collect_list(struct(g, p0))), x -> x.p0)").alias("p0s"))
    postings = rows.groupBy("lang", "term").agg(F.collect_list(F.struct("g", "p", "p0")).alias("x")).filter("size(x) > 1")
    postings = postings.join(peers.select("lang", F.size("p0s").alias("peers")), "lang").select("lang", "peers", "x.g", "x.p", "x.p0")
    levels = rows.groupBy("lang", "g", "p").agg(F.count(F.lit(1)).alias("m")).groupBy("lang", "g").agg(F.collect_list(F.struct("p", "m")).alias("x"))
    least = groups.select("lang", "g", "p0").join(levels, ["lang", "g"], "left").join(peers, "lang").select("lang", "g", "p0", F.col("x.p").alias("p"), F.col("x.m").alias("m"), "p0s")
    at_least = cut(baselines(least))
    spread = lambda frame: frame.select("lang", "g", F.posexplode("acc").alias("h", "value"))
    one = spread(at_least)
    parts = spread(summed(corrections(postings))).unionByName(one).unionByName(one.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "value"))
    totals = parts.filter("g <> h").groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    a = groups.select("lang", "g", "source", F.col("p0").alias("p"), "v")
    b = groups.select("lang", F.col("g").alias("h"), F.col("source").alias("item"), F.col("p0").alias("q"))
    pairs = totals.join(a, ["lang", "g"]).join(b, ["lang", "h"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + F.col("v") * value).alias("value"))
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(favoured)


def op13_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))
