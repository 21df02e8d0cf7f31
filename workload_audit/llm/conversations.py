"""Conversation structure repair over a suffix-shared automaton of role and fault signatures (operator 12).

A conversation is a word: one symbol per row, made of the role's initial and the row's fault. Words are cut into segments, sorted
by their reversals and read as one automaton from the end: what two words have in common at their ends is one chain of nodes. Each
node holds, for each state of the role grammar, the least cost of repairing what follows and the first edit of the best audit.
"""

from __future__ import annotations

import functools
import hashlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import running
from .storage import cut

SPACES = " \t\n\x0b\x0c\r"
#: Symbols: sound, truncated and undue (blank or duplicate) rows, each with a role that starts with s, u, a or something else.
ROLES, SYMBOLS = "suao", "suaoSUAO0123"
SOUND, TRUNCATED, UNDUE = range(3)
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 2, 3, 2, 1  # costs of the edits, and of a truncated row that stays
FAR = 1 << 40
#: States of (s?(ua)+)?: nothing yet, after s, after u, after a; the role that each takes next; the state after it.
STATES = 4
NEXT_ROLE, NEXT_STATE = "uuau", (2, 2, 3, 2)
#: What is left to pay at the end of a conversation in each state: inserted rows up to the next a.
FINAL = (0, 2 * INSERT, INSERT, 0)
NAMES = {"u": "user", "a": "assistant"}
#: Rows of a segment.
SEGMENT = 1024


# -- rows ---------------------------------------------------------------------------------------------------------------


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after the damage that crc32 of ``conv_id:turn`` says; dropped rows are gone. Nulls in id and turn stay."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.translate(told("text"), ".!?", "")).otherwise(told("text"))
    role = F.when(code == 4, "user").otherwise(told("role"))
    return rows.filter(code != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(code == 3, 2).otherwise(1).alias("copies"))


def _hashes() -> list[Column]:
    return [F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit("second"), "text", "role").alias("h2")]


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, h1, h2, m, at, blank, short, again, own, later): equal rows of a conversation as one, with their place and symbols.

    Rows stand in the order of turn (nulls first), then of the hashes; ``own`` is the symbol of the first of equal rows, ``later`` that of
    its repeats. Places come from a range partitioning, and whether the same role and text stand earlier from a
    grouped minimum of places, so a conversation of any length is spread over tasks.
    """
    first = F.substring("role", 1, 1)
    role = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    text = F.rtrim(F.col("text"), F.lit(SPACES))
    narrow = rows.select("conv_id", "turn", *_hashes(), role.alias("role"), (text == "").alias("blank"), (~F.substring(text, -1, 1).isin(".", "!", "?")).alias("short"), "copies")
    equal = narrow.groupBy("conv_id", "turn", "h1", "h2").agg(F.sum("copies").alias("m"), F.max("role").alias("role"), F.max("blank").alias("blank"), F.max("short").alias("short"))
    placed = cut(running(equal, [F.col(c) for c in ("turn", "h1", "h2")], {"at": F.col("m")}, ["conv_id"]).drop("row_index"))
    firsts = placed.groupBy(F.col("conv_id").alias("_c"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).agg(F.min("at").alias("_first"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    marked = placed.join(firsts, same).withColumn("again", F.col("at") > F.col("_first")).drop("_c", "_h1", "_h2", "_first")
    symbol = lambda kind: F.substring(F.lit(SYMBOLS), 4 * kind + F.col("role") + 1, F.lit(1))
    kind = F.when(F.col("blank") | F.col("again"), UNDUE).when(F.col("short"), TRUNCATED).otherwise(SOUND)
    return marked.withColumns({"own": symbol(kind), "later": symbol(F.lit(UNDUE))})


def segments(marked: DataFrame, segment: int) -> DataFrame:
    """(conv_id, seg, rows, word): at most ``segment`` symbols of a conversation, and the rows that they stand for."""
    spread = marked.withColumn("seg", F.explode(F.expr(f"sequence(at div {segment}, (at + m - 1) div {segment})")))
    low, high = F.greatest(F.col("at"), F.col("seg") * segment), F.least(F.col("at") + F.col("m"), (F.col("seg") + 1) * segment)
    piece = F.when(low == F.col("at"), F.concat("own", F.expr("repeat(later, cast(n - 1 as int))"))).otherwise(F.expr("repeat(later, cast(n as int))"))
    spread = spread.withColumn("n", high - low).withColumn("piece", piece)
    row = F.struct(low.alias("at"), "turn", "h1", "h2", "piece", (low == F.col("at")).alias("head"))
    out = spread.withColumn("row", row).groupBy("conv_id", "seg").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return out.withColumn("word", F.expr("concat_ws('', rows.piece)"))


# -- the automaton ------------------------------------------------------------------------------------------------------


@functools.lru_cache(1 << 16)
def before(symbol: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], str]:
    """For each state: the least cost of the symbol and all that follows, and the edit it starts with; equal costs take the first letter of D, I, K, R.

    ``after``: the costs of what follows the symbol. In a state each edit leads to one place, so the first letter decides which of the cheapest audits is least.
    """
    kind, role = divmod(SYMBOLS.index(symbol), 4)
    extra = CUT_SHORT if kind == TRUNCATED else 0
    options: list[dict[str, int]] = []
    for q in range(STATES):
        known = {"D": DELETE + after[q]}
        if kind != UNDUE:
            known["R"] = REROLE + extra + after[NEXT_STATE[q]]
            to = kept_state(q, ROLES[role])
            if to is not None:
                known["K"] = KEEP + extra + after[to]
        options.append(known)
    best = [min(x.values()) for x in options]
    for _ in range(2):  # an inserted row leads to another state at the same place; more than two in a row cost more than they save
        best = [min(best[q], INSERT + best[NEXT_STATE[q]]) for q in range(STATES)]
    for q in range(STATES):
        options[q]["I"] = INSERT + best[NEXT_STATE[q]]
    return tuple(best), "".join(min(e for e, cost in options[q].items() if cost == best[q]) for q in range(STATES))


def kept_state(q: int, initial: str) -> int | None:
    """The state after a row with this initial is kept in state ``q``; None: the grammar forbids it there."""
    if initial == "s":
        return 1 if q == 0 else None
    return NEXT_STATE[q] if initial == NEXT_ROLE[q] else None


class Automaton:
    """The nodes of the current word's suffixes, each made once; a word that ends alike goes on from the node where it parts."""

    def __init__(self, end: tuple[int, ...]):
        self.word, self.costs, self.edits = "", [end], [""]

    def read(self, reversed_word: str) -> None:
        shared = 0
        for x, y in zip(self.word, reversed_word, strict=False):
            if x != y:
                break
            shared += 1
        del self.costs[shared + 1 :], self.edits[shared + 1 :]
        for symbol in reversed_word[shared:]:
            costs, edits = before(symbol, self.costs[-1])
            self.costs.append(costs)
            self.edits.append(edits)
        self.word = reversed_word

    def audit(self, q: int) -> tuple[str, int]:
        """The best audit from state ``q``, and the state in which it leaves the word."""
        out, depth = [], len(self.word)
        while depth:
            edit = self.edits[depth][q]
            out.append(edit)
            if edit != "I":
                symbol = self.word[depth - 1]
                depth -= 1
                q = q if edit == "D" else NEXT_STATE[q] if edit == "R" else kept_state(q, ROLES[SYMBOLS.index(symbol) % 4])
            else:
                q = NEXT_STATE[q]
        return "".join(out), q


def _by_suffix(frame: DataFrame) -> DataFrame:
    """Segments with like ends side by side; ties, which may be many, are spread by a hash."""
    keyed = frame.withColumns({"back": F.reverse("word"), "tie": F.xxhash64("conv_id", "seg")})
    spread = keyed.repartitionByRange("end", F.substring("back", 1, 64), "tie")
    return spread.sortWithinPartitions("end", "back").drop("tie")


def matrices(inner: DataFrame) -> DataFrame:
    """(conv_id, seg, costs): the least costs of a segment from each state to each state, for segments that others follow."""

    def solve(batches):
        units = [Automaton(tuple(0 if e == q else FAR for e in range(STATES))) for q in range(STATES)]
        for batch in batches:
            out = []
            for word in batch.column(2).to_pylist():
                for unit in units:
                    unit.read(word)
                out.append([unit.costs[-1][q] for unit in units for q in range(STATES)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["conv_id", "seg", "costs"])

    frame = _by_suffix(inner.select("conv_id", "seg", "word").withColumn("end", F.lit("")))
    kind = frame.schema["conv_id"].dataType.simpleString()
    return frame.select("conv_id", "seg", "back").mapInArrow(solve, f"conv_id {kind}, seg long, costs array<long>")


def exits(costs: DataFrame) -> DataFrame:
    """(conv_id, seg, end, ahead): what each state at a segment's end still has to pay, less the least of these, which is ``ahead``.

    A conversation's segments stream by from its end, one row of 16 numbers each.
    """

    def chain(batches):
        at, cost = None, np.array(FINAL)
        for batch in batches:
            ends, ahead = [], []
            for conv, own in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (conv,) != at:
                    at, cost = (conv,), np.array(FINAL)
                ends.append(_told(cost - cost.min()))
                ahead.append(int(cost.min()))
                cost = (np.array(own, np.int64).reshape(STATES, STATES) + cost[:, None]).min(axis=0)  # [state at the end, at the start]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ends, pa.string()), pa.array(ahead, pa.int64())], names=["conv_id", "seg", "end", "ahead"])

    kind = costs.schema["conv_id"].dataType.simpleString()
    spread = costs.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("seg"))
    return spread.mapInArrow(chain, f"conv_id {kind}, seg long, end string, ahead long")


def _told(costs) -> str:
    return ",".join(map(str, costs))


def with_exits(pieces: DataFrame) -> DataFrame:
    """Segments with what follows them: the end of the conversation, or for those of longer conversations the costs of what comes after."""
    longer = cut(pieces.filter("seg > 0").select(F.col("conv_id").alias("_c")).distinct())
    long = F.col("conv_id").eqNullSafe(F.col("_c"))
    alone = pieces.join(longer, long, "left_anti").withColumns({"end": F.lit(_told(FINAL)), "ahead": F.expr("0L")})
    inner = cut(pieces.join(longer, long, "left_semi"))
    after = exits(matrices(inner)).select(F.col("conv_id").alias("_c"), F.col("seg").alias("_s"), "end", "ahead")
    return alone.unionByName(inner.join(after, long & (F.col("seg") == F.col("_s"))).drop("_c", "_s"))


def solved(words: DataFrame) -> DataFrame:
    """``words`` with the cost and the audit of each state in which a segment may start, and the state in which it ends; the first starts in state 0."""

    def solve(batches):
        end, automaton = None, None
        for batch in batches:
            costs, audits, states = [], [], []
            for stop, ahead, seg, word in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if stop != end:
                    end, automaton = stop, Automaton(tuple(map(int, stop.split(","))))
                automaton.read(word)
                starts = range(STATES) if seg else range(1)
                told = [automaton.audit(q) for q in starts]
                costs.append([automaton.costs[-1][q] + ahead for q in starts])
                audits.append([x[0] for x in told])
                states.append([x[1] for x in told])
            yield pa.RecordBatch.from_arrays(
                [pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string())), pa.array(states, pa.list_(pa.int32())), *batch.columns[2:]],
                names=["costs", "audits", "states", "seg", "back", "conv_id", "rows"],
            )

    frame = _by_suffix(words).select("end", "ahead", "seg", "back", "conv_id", "rows")
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema}
    schema = f"costs array<long>, audits array<string>, states array<int>, seg long, back string, conv_id {kinds['conv_id']}, rows {kinds['rows']}"
    return frame.mapInArrow(solve, schema)


# -- conversations ------------------------------------------------------------------------------------------------------

LEGAL = {"su", "ua", "au"}


class Repair:
    """One conversation while its segments and texts stream by in order."""

    def __init__(self):
        self.q, self.cost, self.illegal, self.last = 0, 0, 0, ""
        self.audit: list[str] = []
        self.edits: deque[tuple[str, str]] = deque()  # of each row that is the first of equal ones: inserted roles before it, and its role ("": deleted, "=": its own)
        self.inserted, self.key, self.sha, self.lines = "", None, hashlib.sha256(), 0

    def line(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def add_segment(self, seg: int, costs, audits, states, word: str, rows) -> None:
        if not seg:
            self.cost = costs[0]
        audit = iter(audits[self.q if seg else 0])
        self.audit.append(audits[self.q if seg else 0])
        symbols = iter(word)
        for row in rows:
            for k in range(len(row["piece"])):
                initial = ROLES[SYMBOLS.index(next(symbols)) % 4]
                self.illegal += bool(self.last) and self.last + initial not in LEGAL
                self.last = initial
                while (edit := next(audit)) == "I":
                    self.inserted += NEXT_ROLE[self.q]
                    self.q = NEXT_STATE[self.q]
                role = ""
                if edit == "K":
                    role, self.q = "=", kept_state(self.q, initial)
                elif edit == "R":
                    role, self.q = NEXT_ROLE[self.q], NEXT_STATE[self.q]
                if k == 0 and row["head"]:
                    self.edits.append((self.inserted if role else "", role))
                    self.inserted = "" if role else self.inserted

    def add_text(self, key, role: str, text: str) -> None:
        if key == self.key:  # one of equal rows: a duplicate
            return
        self.key = key
        inserted, new = self.edits.popleft()
        for x in inserted:
            self.line(NAMES[x], "")
        if new:
            self.line(role if new == "=" else NAMES[new], text)

    def end(self) -> tuple[int, int, str, str]:
        while FINAL[self.q]:
            self.inserted += NEXT_ROLE[self.q]
            self.audit.append("I")
            self.q = NEXT_STATE[self.q]
        for x in self.inserted:
            self.line(NAMES[x], "")
        return self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def repaired(solutions: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv_id, illegal, cost, audit, repaired_sha256): each conversation's segments pick their audits in turn, and its texts stream through the hash.

    SHA-256 reads a text from its start to its end, so one task reads a conversation, row by row; it holds the audit and a segment or two.
    """
    kinds = {f.name: f.dataType.simpleString() for f in solutions.schema}
    first = F.col("rows")[0]
    told = solutions.select("conv_id", first["turn"].alias("turn"), first["h1"].alias("h1"), first["h2"].alias("h2"), F.lit(0).alias("kind"), "seg", "costs", "audits", "states", F.reverse("back").alias("word"), "rows", F.lit("").alias("role"), F.lit("").alias("text"))
    none = lambda name: F.lit(None).cast(kinds[name]).alias(name)
    texts = rows.select("conv_id", "turn", *_hashes(), F.lit(1).alias("kind"), F.expr("0L").alias("seg"), none("costs"), none("audits"), none("states"), F.lit("").alias("word"), none("rows"), "role", "text")

    def run(batches):
        at, repair = None, Repair()
        names = ["conv_id", "illegal", "cost", "audit", "repaired_sha256"]
        schema = None

        def told(done):
            return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate([schema, pa.int64(), pa.int64(), pa.string(), pa.string()])], names=names)

        for batch in batches:
            schema, done = batch.schema.field(0).type, []
            for conv, turn, h1, h2, kind, seg, costs, audits, states, word, own, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (conv,) != at:
                    if at is not None:
                        done.append((at[0], *repair.end()))
                    at, repair = (conv,), Repair()
                if kind:
                    repair.add_text((turn, h1, h2), role, text)
                else:
                    repair.add_segment(seg, costs, audits, states, word, own)
            yield told(done)
        if at is not None:
            yield told([(at[0], *repair.end())])

    stream = told.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "h1", "h2", "kind", "seg")
    return stream.mapInArrow(run, f"conv_id {kinds['conv_id']}, illegal long, cost long, audit string, repaired_sha256 string")


def repair_conversations(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation after its damage.

    A null id is a conversation of its own; a null turn comes first and counts in no gap; a null role or text is one space, so such a
    row's role is in no grammar and such a text is blank. Rows of equal turns stand in the order of a hash of role and text; equal rows are
    duplicates after the first. A conversation without rows after damage has zeros, an empty audit and the hash of nothing. Very long texts
    are hashed as they stream by; conversations of any length are solved in segments of ``segment`` rows. No rows: no rows. Other columns are not read.
    """
    rows = damage(conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")))
    marked = cut(signatures(rows))
    turns = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    one = lambda c: F.sum(c).cast("long")
    stats = marked.groupBy("conv_id").agg(
        F.coalesce(turns, F.lit(0)).cast("long").alias("gaps"), one(F.when(F.col("blank"), F.col("m")).otherwise(0)).alias("blank"),
        one(F.when(~F.col("blank"), F.col("m") - F.when(F.col("again"), 0).otherwise(1)).otherwise(0)).alias("duplicate"),
        one((~F.col("blank") & ~F.col("again") & F.col("short")).cast("int")).alias("truncated"),
    )
    fixed = repaired(solved(with_exits(cut(segments(marked, segment)))), rows)
    every = conversations.select(F.col("conv_id").alias("_id")).distinct()
    out = every.join(stats, F.col("_id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").join(fixed, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(F.col("_id").alias("conv_id"), *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
