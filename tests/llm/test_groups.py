"""SimHash groups, conversation repair and the divergence of sources against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from workload_audit.llm import conversations as C
from workload_audit.llm.conversations import repair_conversations
from workload_audit.llm.divergence import divergence
from workload_audit.llm.simhash import block_masks, fingerprint_components, simhash_duplicates


def _linked(fps, most=4):
    values = np.array(fps, np.uint64)
    links = [(i, int(j)) for i in range(len(fps)) for j in i + 1 + np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= most)]
    return brute.components(len(fps), links)


def test_simhash_is_brute_force(edge_docs, rows, no_docs):
    got = Counter(map(tuple, simhash_duplicates(edge_docs).collect()))
    fps = [brute.simhash(t) for _, t, *_ in rows]
    ids = brute.smallest_ids([i for i, *_ in rows], _linked(fps))
    assert got == Counter((i, f"{fp:016x}", c) for (i, *_), fp, c in zip(rows, fps, ids, strict=True))
    assert simhash_duplicates(no_docs).count() == 0


def test_every_pair_of_few_bits_shares_a_key():
    masks, rng = block_masks(), random.Random(3)
    assert all(m.bit_count() in (27, 28) for m in masks) and len(masks) == 35
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


@pytest.mark.parametrize("group", [4, 16, 4096])
def test_large_groups_of_like_fingerprints_are_split_and_stay_whole(spark, small, group):
    """Clusters around a centre, chains of four bits, and single ones near a cluster, with keys far larger than a group."""
    rng = random.Random(7)

    def flipped(x, n):
        for bit in rng.sample(range(64), n):
            x ^= 1 << bit
        return x

    fps = {0, 1, (1 << 64) - 1}
    for _ in range(3):
        centre = rng.getrandbits(64)
        fps |= {flipped(centre, rng.randint(0, 3)) for _ in range(60)} | {flipped(centre, rng.randint(5, 9)) for _ in range(40)}
    x = rng.getrandbits(64)
    for _ in range(30):
        x = flipped(x, 4)
        fps.add(x)
    fps = sorted(fps | {rng.getrandbits(64) for _ in range(50)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    got = {r["node"]: r["component"] for r in fingerprint_components(frame, group=group).collect()}
    groups = lambda labels: {frozenset(i for i, x in enumerate(labels) if x == y) for y in set(labels)}
    assert groups([got.get(x, ("alone", x)) for x in signed]) == groups(_linked(fps))


def _conversations(seed: int, n: int):
    rng, rows = random.Random(seed), []
    texts = ["Yes.", "no", "", "  \n", "Why? ", "ok!", "Yes.", "中文。", "é.\x1c", None]
    for conv in [*range(n), None]:
        for turn in range(rng.randint(1, 14)):
            turn = None if rng.random() < 0.05 else turn + (rng.random() < 0.1) * 3
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "Users", None]), rng.choice(texts)))
    rows += rows[:5]
    return rows


@pytest.mark.parametrize("segment", [1024, 3])
def test_repairs_are_brute_force(spark, small, segment):
    given = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows = given + [(None if c is None else c + 1000, *r) for c, *r in _conversations(11, 120)]
    # a long conversation, one row many times, and one that loses all its rows
    rows += [(5000, t, ("user", "assistant")[t % 2], f"line {t}.") for t in range(2500)] + [(5001, 7, "user", "again.")] * 40
    gone = next(i for i in range(6000, 7000) if brute.damaged([(i, 0, "user", "x")])[i] == [])
    rows.append((gone, 0, "user", "x"))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"at": F.lit(1), "seg": F.lit("x"), "kind": F.lit(None).cast("int")}).repartition(5)
    got = {r[0]: tuple(r)[1:] for r in repair_conversations(frame, segment).collect()}
    want = {conv: brute.repair(own) for conv, own in brute.damaged(rows).items()}
    assert got == want
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", brute.sha256(""))
    assert repair_conversations(frame.limit(0)).count() == 0


def test_nodes_of_a_common_end_are_made_once():
    made = []
    step = C.before

    def counting(symbol, after):
        made.append(symbol)
        return step(symbol, after)

    C.before, automaton = counting, C.Automaton(C.FINAL)
    try:
        for word in sorted(w[::-1] for w in ("suaua", "uaua", "aua", "suaUa", "uaUa")):
            automaton.read(word)
    finally:
        C.before = step
    assert len(made) == 9  # a, u, then Ua: a u s and Uau s share the last symbol


def test_divergence_is_brute_force(spark, small, rows, edge_docs, no_docs):
    for least, top in ((10, 10), (2, 3)):
        got = Counter(map(tuple, divergence(edge_docs, least, top).collect()))
        assert got == Counter(brute.divergence([(lang, source, t) for _, t, lang, source in rows], least, top))
    assert divergence(no_docs).count() == 0
    lone = spark.createDataFrame([("x", "one", None), ("x", "two", "a b c")], "lang string, source string, text string")
    assert sorted(map(tuple, divergence(lone).collect())) == [("x", "one", "pair", "two", 0, 1), ("x", "two", "pair", "one", 0, 1)]


def test_shares_stay_exact_at_large_totals(spark):
    from workload_audit.llm.divergence import share

    cases = [(0, 0, 1), (5, 17, 3), (10**12, 9 * 10**14, 10**9), (7, 8 * 10**15, 10**6), (8 * 10**15, 8 * 10**15, 1)]
    frame = spark.createDataFrame(cases, "n long, own long, v long")
    got = [r[0] for r in frame.select(share("n", "own", "v")).collect()]
    assert got == [1 + 10**9 * (n + 2) // (t + 2 * v) for n, t, v in cases]
