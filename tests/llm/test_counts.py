"""Operators that judge or place each document by itself: secrets, quality, shards, mixing."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm import brute
from workload_audit.llm.features import FEATURES
from workload_audit.llm.mixing import mix, take, tilt
from workload_audit.llm.quality_ranking import fit_ranking, rank_quality
from workload_audit.llm.quality_rules import FALLING, fit_trees, quality_rules
from workload_audit.llm.secret_scan import RULES, Rule, find_secrets, read_ledger, scan_versions
from workload_audit.llm.sharding import assign_shards
from workload_audit.llm.storage import run_path


def test_secrets_against_regexes_and_ledger_growth(spark, rows, edge_docs, no_docs):
    path = run_path(spark, "ledger")
    versions = edge_docs.select(edge_docs.doc_id.alias("path"), "text")
    half = versions.filter("path % 2 = 0")
    first = scan_versions(half, path, first=True)
    seen = first.count()
    assert seen == 3 * len({brute.sha256(t or "") for i, t, *_ in rows if i is not None and i % 2 == 0})
    ledger = scan_versions(versions, path)
    got = Counter(map(tuple, find_secrets(edge_docs, ledger).select("doc_id", "n_assign", "n_access", "n_hex", "spans").collect()))
    assert got == Counter((i, *brute.secrets(t)) for i, t, *_ in rows)
    blobs = len({brute.sha256(t or "") for _, t, *_ in rows})
    assert ledger.count() == 3 * blobs
    # nothing is unseen now, so nothing is scanned; a new rule is scanned over every blob, and only it
    assert scan_versions(versions, path).count() == 3 * blobs
    more = (*RULES, Rule("word", 1, r"two", 0, 3))
    assert scan_versions(versions, path, more).count() == 4 * blobs
    found = find_secrets(edge_docs, read_ledger(spark, path), more).filter("doc_id = 1006").first()
    assert found["n_word"] == 1 and found["spans"] == "word:4:7"
    assert scan_versions(no_docs.select(no_docs.doc_id.alias("path"), "text"), run_path(spark, "ledger"), first=True).count() == 0


def test_secrets_of_equal_rows_are_found_once(spark, small):
    """A row that stands twice, two rows without an id and one text, and a file that went back to an earlier content."""
    two = lambda k: f"token = abcdefgh{k} then password: 0123456789{k} and AKIAABCDEFGHIJKLMNO{k} AKIAABCDEFGHIJKLMNX{k} {'deadbeef' * 4} {'0badcafe' * 4}"
    versions = [(1, two(1)), (1, two(1)), (None, two(2)), (None, two(2)), (2, two(3)), (2, "other"), (2, two(3)), (3, two(3)), (None, None), (None, None)]
    frame = spark.createDataFrame(versions, "doc_id long, text string").repartition(3)
    ledger = scan_versions(frame.select(frame.doc_id.alias("path"), "text"), run_path(spark, "ledger"), first=True)
    got = Counter(map(tuple, find_secrets(frame, ledger).select("doc_id", "n_assign", "n_access", "n_hex", "spans").collect()))
    assert got == Counter((i, *brute.secrets(t)) for i, t in versions)
    assert all(r[1:4] == (2, 2, 2) for r in got if r[4])
    assert ledger.count() == 3 * len({brute.sha256(t or "") for _, t in versions})


def test_rules_statistics_and_verdicts(rows, edge_docs, no_docs, labels):
    got = quality_rules(edge_docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = Counter()
    for i, text, *_ in rows:
        s = brute.statistics(text)
        want[(i, *s, s[0] < 10 or 100 * s[4] > 20 * s[0])] += 1
    assert Counter(tuple(r)[:7] for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    right = [r["kept"] == bool(quality[r["doc_id"]]) for r in got if r["doc_id"] in quality and not r["base_failed"]]
    assert np.mean(right) > 0.95
    assert quality_rules(no_docs, labels).count() == 0


def test_trees_are_monotone_and_learn():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, len(FEATURES)))
    sign = [-int(f in FALLING) for f in FEATURES]
    down, free = sign.index(-1), sign.index(0)
    y = ((x[:, free] ** 2 - x[:, down] + rng.normal(scale=0.5, size=3000)) > 0.5).astype(float)
    trees = fit_trees(x[:2000], y[:2000], sign)
    assert np.mean((trees.score(x[2000:]) > 0.5) == y[2000:]) > 0.8
    for j in (k for k, s in enumerate(sign) if s):
        grid = np.repeat(x[:50], 40, axis=0)
        grid[:, j] = np.tile(np.linspace(-4, 4, 40), 50)
        assert (np.diff(trees.score(grid).reshape(50, 40), axis=1) <= 1e-12).all()
    assert len(set(fit_trees(x, np.ones(len(x)), sign).score(x))) == 1
    assert len(fit_trees(x[:0], y[:0], sign).score(x)) == len(x)


def test_ranking_scores(spark, rows, edge_docs, no_docs, labels):
    got = rank_quality(edge_docs, labels).collect()
    assert len(got) == len(rows)
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)
    held = [(r["score"], quality[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in quality]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    same = defaultdict(set)
    texts = Counter((i, t) for i, t, *_ in rows)
    for i, t in texts:
        if i in (1003, 1004):
            same[t].update(r["score"] for r in got if r["doc_id"] == i)
    assert all(len(s) == 1 for s in same.values())
    assert rank_quality(no_docs, labels).count() == 0
    assert len({r["score"] for r in rank_quality(edge_docs, labels.limit(0)).collect()}) == 1


def test_ranking_cut_is_the_quantile_of_bad_rows():
    rng = np.random.default_rng(1)
    y = (rng.random(1000) < 0.8).astype(float)
    x = np.column_stack([y + rng.normal(scale=0.3, size=1000), rng.normal(size=1000)])
    model = fit_ranking(x, y)
    assert ((model.score(x) < 0.3).sum()) == (y == 0).sum()
    assert np.corrcoef(model.raw(x), y)[0, 1] > 0.7


def test_shards(rows, edge_docs, no_docs):
    got = assign_shards(edge_docs, 16).collect()
    want = Counter((i, len((t or "").encode()) + 1, brute.crc(t)) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    shards = defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r)
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    last = None
    for s in sorted(shards):
        own = sorted(shards[s], key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 16) <= largest
        ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in own]
        assert ids == sorted(ids) and (last is None or last <= ids[0])
        last = ids[-1]
    assert assign_shards(no_docs).count() == 0


def test_mix_meets_targets(rows, edge_docs, no_docs):
    plan = mix(edge_docs).collect()
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len(brute.WORD.findall(t or ""))
    want = brute.targets(dict(size))
    taken = Counter()
    for r in plan:
        assert 0 <= r["copies"] <= 2 and r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9)
        taken[r["source"]] += r["copies"] * r["size"]
    smallest = {s: min([r["size"] for r in plan if r["source"] == s and r["size"]], default=0) for s in size}
    for s in size:
        own = [r["size"] for r in plan if r["source"] == s and r["size"]]
        # whole copies of a document that is a large part of its source can miss by up to half of it
        large = max(own, default=0)
        assert abs(taken[s] - want[s]) <= max(0.03 * want[s], 3 * smallest[s], 0.5 * large if large > 0.2 * want[s] else 0)
    assert sorted(map(tuple, plan), key=str) == sorted(map(tuple, mix(edge_docs).collect()), key=str)
    copied = take(edge_docs, mix(edge_docs))
    assert copied.columns == edge_docs.columns and copied.count() == sum(r["copies"] for r in plan)
    assert mix(no_docs).count() == 0


def test_tilt_keeps_priors_in_proportion(spark):
    cells = spark.createDataFrame([("a", 1.0, 100.0, 250.0), ("a", 0.5, 300.0, 250.0), (None, 1.0, 10.0, 20.0), ("b", 1.0, 0.0, 0.0)], "source string, prior double, size double, target double")
    duals = {r["source"]: r["dual"] for r in tilt(cells).collect()}
    assert np.exp(duals["a"]) == pytest.approx(1.0, rel=1e-6)
    assert min(2, np.exp(duals[None])) == pytest.approx(2.0, rel=1e-6)
    assert np.exp(duals["b"]) < 1e-12


def test_rates_keep_the_priors_proportions(spark, small):
    """Equal priors would give all documents of a source one rate; here each size has its own, up to the cap, and targets are still met."""
    rng = np.random.default_rng(5)
    sizes = [int(n) for n in np.concatenate([rng.integers(1, 60, 900), rng.integers(64, 900, 700), rng.integers(2048, 4000, 40)])]
    rows = [(i, " ".join(["w"] * n), f"s{i % 3}") for i, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    plan = mix(docs).collect()
    words = Counter()
    for i, _, s in rows:
        words[s] += sizes[i]
    want = brute.targets(dict(words))
    taken = Counter()
    for r in plan:
        taken[r["source"]] += r["copies"] * r["size"]
    for s in want:
        assert taken[s] == pytest.approx(want[s], rel=0.01)
        own = [r for r in plan if r["source"] == s]
        rate = {name: np.mean([r["copies"] for r in own if low <= r["size"] <= high]) for name, low, high in (("short", 1, 63), ("middle", 64, 2047), ("long", 2048, 10**9))}
        if rate["middle"] < 1.9:
            assert rate["short"] == pytest.approx(0.5 * rate["middle"], rel=0.15) and rate["long"] == pytest.approx(0.7 * rate["middle"], rel=0.35)
        else:  # at the cap: all sizes, or only those with the largest prior
            assert rate["short"] < 2 or want[s] == 2 * words[s]
    assert any(np.mean([r["copies"] for r in plan if r["source"] == s and 64 <= r["size"] <= 2047]) < 1.9 for s in want)
