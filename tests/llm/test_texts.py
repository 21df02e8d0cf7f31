"""Operators that compare or cut texts: n-gram join, fingerprints, packing, line dedup, language identification, pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tests.llm import brute
from workload_audit.llm.components import components
from workload_audit.llm.fingerprints import fingerprint, likeness, with_next
from workload_audit.llm.language_id import declared_language, fit_text_model, identify, page_text
from workload_audit.llm.line_dedup import dedup_lines, parity, signatures, within
from workload_audit.llm.ngram_join import bitmap, index_length, least_overlap, links_within, may_link, near_duplicates, overlap, probe_length
from workload_audit.llm.packing import pack, sweep, token_pieces
from workload_audit.llm.storage import Rounds
from workload_audit.llm.textops import shingle_sets
from workload_audit.llm.tokens import WordIds, vocabulary_path


def _linked(sets):
    return [(a, b) for b in range(len(sets)) for a in range(b) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]


def test_near_duplicates_against_all_pairs(rows, edge_docs, no_docs):
    got = Counter(map(tuple, near_duplicates(edge_docs).collect()))
    sets = [brute.shingles(t) for _, t, *_ in rows]
    with_id = [k for k, r in enumerate(rows) if r[0] is not None]
    ids = [rows[k][0] for k in with_id]
    links = _linked([sets[k] for k in with_id]) + [(a, b) for b in range(len(ids)) for a in range(b) if ids[a] == ids[b]]
    root = brute.components(len(ids), links)
    least = defaultdict(lambda: 10**9)
    for k, r in enumerate(root):
        least[r] = min(least[r], ids[k])
    want = Counter((rows[k][0], len(sets[k]), least[root[n]]) for n, k in enumerate(with_id))
    want.update((None, len(sets[k]), None) for k, r in enumerate(rows) if r[0] is None)
    assert got == want
    assert near_duplicates(no_docs).count() == 0


def test_many_near_copies_and_a_shared_passage(spark, small):
    """A chain of copies that differ more and more, and unlike documents that share a passage."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(120)]
    texts = []
    for _ in range(350):
        copy = list(base)
        for at in rng.sample(range(120), rng.randint(1, 5)):
            copy[at] = word()
        texts.append(copy)
    passage = [word() for _ in range(60)]
    texts += [[word() for _ in range(rng.randint(5, 60))] + passage + [word() for _ in range(rng.randint(5, 60))] for _ in range(350)]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sets = [brute.shingles(t) for _, t in docs]
    root = brute.components(len(docs), _linked(sets))
    assert [got[i] for i in range(len(docs))] == root


def test_join_bounds():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        pool = np.unique(rng.integers(0, 2**63, 90).astype(np.uint64))
        a = np.sort(rng.choice(pool, min(n, len(pool)), False))
        drop = int(rng.integers(0, max(1, n // 3)))
        b = np.unique(np.concatenate([a[drop:], rng.choice(pool, int(rng.integers(0, 8)))]))
        if not len(b):
            continue
        both = len(set(a.tolist()) & set(b.tolist()))
        assert overlap(a, b) == both
        links = 100 * both >= 75 * (len(a) + len(b) - both)
        assert links == (both >= least_overlap(len(a), len(b)))
        if links:
            assert may_link(bitmap(a), np.int64(len(a)), bitmap(b), np.int64(len(b)))
            x, y = (a, b) if len(a) <= len(b) else (b, a)
            assert set(x[: index_length(len(x))].tolist()) & set(y[: probe_length(len(y))].tolist())
            assert list(links_within([7, 9], [a, b]))


def test_shingle_sets_equal_sets_of_words(rows):
    texts = [t for _, t, *_ in rows]
    sets = dict(shingle_sets(pa.array(texts, pa.string())))
    plain = [brute.shingles(t) for t in texts]
    assert [len(sets[i]) for i in range(len(texts))] == [len(p) for p in plain]
    for a in range(0, len(texts), 7):
        for b in range(a, min(a + 40, len(texts))):
            assert overlap(sets[a], sets[b]) == len(plain[a] & plain[b]) if len(sets[a]) and len(sets[b]) else True


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 600)] + [(700, i) for i in range(701, 800)]
    got = dict(map(tuple, components(spark.createDataFrame([*links, (5, None)], "a long, b long")).collect()))
    root = brute.components(800, links)
    assert got == {i: root[i] for i in {x for a, b in links if a != b for x in (a, b)}}


def test_order_minhash(spark, rows, edge_docs, no_docs):
    docs = with_next(edge_docs)
    assert docs.count() == len({r[0] for r in rows})
    one = {}
    for i, t, *_ in rows:
        one.setdefault(i, t or "")
    got = {r["doc_id"]: r for r in docs.collect()}
    ids = sorted(one, key=lambda i: -1 if i is None else i)
    for a, b in zip(ids, ids[1:] + ids[:1], strict=True):
        if a is None:  # which of the two texts without an id stands for it is left to their hashes
            continue
        text, following = one[a], got[b]["text"]
        half = len(text) // 2
        assert got[a]["edited"] == text[: len(text) - half] + following[:half] and got[a]["n_chars"] == len(text)
    signed = {r["doc_id"]: r for r in fingerprint(docs, ["text", "edited"]).collect()}
    by_text = defaultdict(set)
    for i in ids:
        by_text[got[i]["text"]].add(tuple(signed[i]["text"]))
        if got[i]["edited"] == got[i]["text"]:
            assert signed[i]["edited"] == signed[i]["text"]
    assert all(len(s) == 1 for s in by_text.values())
    assert with_next(no_docs).count() == 0


def test_every_row_has_its_fingerprint(spark, small, tmp_path):
    """Rows that share an id, or have none, are documents of their own; equal rows too."""
    from workload_audit.llm.fingerprints import op4_fingerprints

    texts = [(1, "one two three four five six"), (1, "seven eight nine ten eleven"), (None, "no id here at all"), (None, "no id here either, but more"),
             (None, None), (None, ""), (3, "twice the same as it stands"), (3, "twice the same as it stands"), (3, "twice the same as it stands"), (2, "alone")]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = op4_fingerprints(spark, str(tmp_path)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, (xxhash.xxh64_intdigest((r[1] or "").encode(), 42) + 2**63) % 2**64)
    order = sorted(texts, key=key)
    want = Counter()
    for (i, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        text, half = text or "", len(text or "") // 2
        want[(i, len(text), brute.sha256(text[: len(text) - half] + (following or "")[:half]))] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out) == want
    assert Counter(r["near_next"] for r in out if r["doc_id"] == 3)[1.0] == 2


def test_order_minhash_is_brute_force_and_sees_order(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(40)}" for _ in range(200)]
    frame = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[100:] + words[:100])), (3, " ".join(words[:-3] + ["x", "y", "z"])), (4, "solo"), (5, "")], "doc_id long, text string")
    signed = {r["doc_id"]: r["text"] for r in fingerprint(frame, ["text"], k=2, bins=16, ell=2).collect()}
    kept = len(set(signed[1]) & set(signed[3])) / 16
    moved = len(set(signed[1]) & set(signed[2])) / 16
    assert kept > 0.6 and moved < kept and len(signed[4]) == 1 and signed[5] == []
    # occurrence numbers: the same words a second time are other k-mers
    again = spark.createDataFrame([(1, "a b"), (2, "a b a b a b a b")], "doc_id long, text string")
    sizes = {r["doc_id"]: len(r["text"]) for r in fingerprint(again, ["text"], k=1, bins=64, ell=1).collect()}
    assert sizes[2] > sizes[1]
    a, b = (spark.range(1).selectExpr(f"array({','.join(repr(x) for x in s)}) AS s") for s in (["00a", "01b"], ["00a", "02c"]))
    both = a.crossJoin(b.withColumnRenamed("s", "t"))
    assert both.select(likeness(both["s"], both["t"])).first()[0] == pytest.approx(1 / 3)


def test_word_ids_equal_encode(rows):
    ids = WordIds(vocabulary_path())
    whole = lambda t: ids.tokenizer.encode(t, add_special_tokens=False).ids
    for _, text, *_ in rows[:60] + rows[-4:]:
        assert np.frombuffer(ids.encode(text or ""), "<u4").tolist() == whole(text or "")
    rng = random.Random(6)
    letters = [*"abAB zZ  \n\t'́  é éÉİſßΣς<|endoftext|>019٣中文😀\x1c\x85.,;-_'s't're", "<|endoftext|>", "'LL", "ẛ̣"]
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(ids.encode(text), "<u4").tolist() == whole(text), repr(text)


def test_parts_of_words_are_computed_once(monkeypatch):
    ids = WordIds(vocabulary_path())
    whole = lambda t: ids.tokenizer.encode(t, add_special_tokens=False).ids
    asked: Counter = Counter()
    compute = ids.compute
    monkeypatch.setattr(ids, "compute", lambda word: asked.update([word]) or compute(word))
    cases = [w + end for w in ("there", "There", "THERE", "déjà", "DÉJÀ") for end in ("", ".", ",", "...", "'s", "'LL.", "7", "77,")]
    text = " ".join(cases * 3) + "\n" + "\t".join(cases)
    assert np.frombuffer(ids.encode(text), "<u4").tolist() == whole(text)
    assert asked == Counter(["there", "déjà", ".", ",", "...", "'s", "'ll", "7"])


def test_texts_encoded_together():
    ids = WordIds(vocabulary_path())
    whole = lambda t: ids.tokenizer.encode(t, add_special_tokens=False).ids
    rng = random.Random(7)
    letters = [*"abAB Z  \n\t''sdḿé×÷ÀÞßÿİſ0١中😀\x00\x7f\r.,-", "'re", "'VE", "'ll", "Ｋ", "H̱", "<|endoftext|>", "<|ENDOFTEXT|>", " <|startoftext|>"]
    for _ in range(500):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 6))]
        data, ends = ids.encode_all(texts)
        assert [data[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [whole(t) for t in texts], texts


def test_pieces_of_several_runs(spark, small):
    the = WordIds(vocabulary_path()).tokenizer.encode("the", add_special_tokens=False).ids
    words = [0, 2_300_000, 3, 2047, 2048, 1_200_000, 1, 5]  # more bytes than are encoded together, in one batch
    docs = spark.createDataFrame([(i, "The " * n if n else None) for i, n in enumerate(words)], "doc_id long, text string").coalesce(1)
    want = Counter()
    for i, n in enumerate(words):
        ids = np.array([*the * n, 0], "<u4")
        want.update((i, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048])) for k, a in enumerate(range(0, len(ids), 2048)))
    assert Counter(map(tuple, token_pieces(docs).collect())) == want


def test_pieces_and_packing(rows, edge_docs, no_docs):
    tokenizer = WordIds(vocabulary_path()).tokenizer
    want = Counter()
    for i, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[(i, k // 2048, k, len(part), zlib.crc32(part.tobytes()))] += 1
    got = pack(token_pieces(edge_docs)).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    gaps: list[int] = []
    for length in sorted((r["length"] for r in got), reverse=True):
        fits = [(g, k) for k, g in enumerate(gaps) if g >= length]
        if fits:
            gaps[min(fits)[1]] -= length
        else:
            gaps.append(2048 - length)
    assert len(sequences) == len(gaps)
    assert pack(token_pieces(no_docs)).count() == 0


def test_sweep_is_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([7, 16, 50])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 200))]
        plan = sweep(Counter(lengths), capacity)
        gaps: list[int] = []
        for length in sorted(lengths, reverse=True):
            fits = [(g, k) for k, g in enumerate(gaps) if g >= length]
            if fits:
                gaps[min(fits)[1]] -= length
            else:
                gaps.append(capacity - length)
        used, ranks = defaultdict(int), Counter()
        for length in lengths:
            own = plan[(plan[:, 0] == length) & (plan[:, 1] <= ranks[length])]
            row = own[own[:, 1].argmax()]
            used[row[3] + (ranks[length] - row[1]) // row[2]] += length
            ranks[length] += 1
        assert len(used) == len(gaps) and sorted(used.values()) == sorted(capacity - g for g in gaps)


def test_edit_join_units():
    rng = random.Random(5)
    for _ in range(4000):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 10))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = [rng.choice("abc")] * rng.randint(0, 1)
        a, b = "".join(a), "".join(b)
        for t in (1, 2, 3):
            near = brute.edit_distance(a, b) <= t
            assert within(a, b, t) == near, (a, b, t)
            if near and min(len(a), len(b)) > t:
                x, y = sorted((a, b), key=len)
                assert {k for k, r in signatures(x, t) if r & 1} & {k for k, r in signatures(y, t) if r & 2}
                assert (parity(a) ^ parity(b)).bit_count() <= 2 * t


def _kept(rows, edits, least):
    """Texts without repeated lines, by comparing all lines."""
    places = defaultdict(list)
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            if len(line) >= least:
                places[line].append((-1 if i is None else i, k))
    lines = list(places)
    close = [(a, b) for b in range(len(lines)) for a in range(b) if abs(len(lines[a]) - len(lines[b])) <= edits
             and (parity(lines[a]) ^ parity(lines[b])).bit_count() <= 2 * edits and within(lines[a], lines[b], edits)]
    root, gone = brute.components(len(lines), close), set()
    classes = defaultdict(list)
    for k, line in enumerate(lines):
        classes[root[k]] += places[line]
    for own in classes.values():
        gone |= {p for p in own if p != min(own)}
    return Counter((i, None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (-1 if i is None else i, k) not in gone)) for i, text in rows)


def test_line_dedup_against_all_pairs(rows, edge_docs, no_docs):
    got = dedup_lines(edge_docs)
    assert got.columns == [*(c for c in edge_docs.columns if c != "_dropped"), "_lines", "_dropped", "_near"]
    out = got.select("doc_id", "text", "_lines", "_dropped").collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == _kept([(i, t) for i, t, *_ in rows], 2, 20)
    assert Counter((r["doc_id"], r["_lines"]) for r in out) == Counter((i, 0 if t is None else t.count("\n") + 1) for i, t, *_ in rows)
    assert dedup_lines(no_docs).count() == 0


def test_line_dedup_tells_rows_of_one_id_apart(spark, small):
    """A repeat in one row takes nothing from others of its id, and goes also where it stands at the kept line's place."""
    line = lambda k: f"line {k} " + "".join(random.Random(k).choices("abcdefgh", k=30))
    texts = [(None, [1, 2, 3]), (None, [1, 4, 5]), (None, [6, 7, 2]), (7, [8, 9, 3]), (7, [8, 10, 11]), (7, [12, 9, 13]), (8, [14, 15]), (9, []), (None, [])]
    docs = [(i, "\n".join(map(line, own))) for i, own in texts] + [(None, None)]
    out = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    left = Counter(x for r in out for x in (r["text"] or "").split("\n") if x)
    assert left == Counter(line(k) for k in {k for _, own in texts for k in own})
    assert Counter((r["doc_id"], r["_lines"]) for r in out) == Counter((i, 0 if t is None else t.count("\n") + 1) for i, t in docs)
    twice = [*docs, docs[0], docs[3], docs[3], docs[6]]
    out = dedup_lines(spark.createDataFrame(twice, "doc_id long, text string").repartition(3), apart=True).collect()
    assert Counter(x for r in out for x in (r["text"] or "").split("\n") if x) == left
    assert len(out) == len(twice) and all(len(r["_dropped"]) + len((r["text"] or "").split("\n")) == r["_lines"] for r in out if r["text"])


def test_short_lines_go_where_they_are_equal(spark, small):
    """Short lines have no near copies, but exact ones; empty lines stay."""
    docs = [(1, "short\n\nshorts\n}"), (2, "short\n\nown\nshort"), (None, "}\na line of more than twenty characters"), (3, "shorts\na line of more than twenty characterz\n")]
    out = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), exact=1).collect()
    want = {1: "short\n\nshorts", 2: "\nown", None: "}\na line of more than twenty characters", 3: ""}
    assert {r["doc_id"]: r["text"] for r in out} == want
    assert {r["doc_id"]: (len(r["_dropped"]), r["_near"]) for r in out} == {1: (1, 0), 2: (2, 0), None: (0, 0), 3: (2, 1)}


@pytest.mark.parametrize("block, hot", [(128, 1 << 16), (32, 0)])
def test_line_dedup_with_many_variants(spark, small, monkeypatch, block, hot):
    """Lines with common segments, more than a block of them, some within two edits and most not; hot keys told by the scan, or only when they meet."""
    from workload_audit.llm import line_dedup

    monkeypatch.setattr(line_dedup, "BLOCK", block)
    monkeypatch.setattr(line_dedup, "MAX_HOT", hot)
    rng = random.Random(9)
    base = "the quick brown fox jumps over the lazy dog and runs far away from here"
    lines = [base]
    for _ in range(600):
        line = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            at = rng.randint(30, len(line) - 1)
            line[at : at + rng.randint(0, 1)] = [rng.choice("XYZWQ")]
        lines.append("".join(line) if rng.random() < 0.3 else base[:24] + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(47)))
    rows = [(i, "\n".join(lines[i * 10 : i * 10 + 10])) for i in range(61)]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text").collect()
    assert Counter(map(tuple, out)) == _kept(rows, 2, 20)


@pytest.mark.parametrize("block", [1 << 11, 16])
def test_pairs_of_large_groups_are_all_pairs(spark, small, monkeypatch, block):
    """A group that is passed on, refined and dealt gives the pairs that comparing it at once gives; rows of one line from several tasks count once."""
    from workload_audit.llm import line_dedup

    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = random.Random(block)
    rows = [(key, line, sum(1 << rng.randrange(32) for _ in range(3)) << 2 | rng.choice([2, 3])) for key, n in ((5, 400), (6, 90), (7, 2)) for line in range(key * 1000, key * 1000 + n)]
    frame = spark.createDataFrame(rows + rows[:300], "key long, line long, mark long").repartition(5)
    with Rounds(spark) as rounds:
        got = sorted(map(tuple, line_dedup.pair_rows(frame, 2, rounds).collect()))
    alike = lambda x, y: x[0] == y[0] and x[2] & 1 | y[2] & 1 and ((x[2] ^ y[2]) >> 2).bit_count() <= 4
    assert got == sorted((x[1], y[1]) for n, x in enumerate(rows) for y in rows[n + 1 :] if alike(x, y))


def test_language_of_pages(spark, rows, edge_docs, no_docs):
    languages, model = fit_text_model(edge_docs)
    assert languages == sorted({r[2] for r in rows if r[1] is not None and r[2] is not None})
    pages = [(k, f"https://u@{'www' if k % 3 else 'hot'}.{lang}site.{lang}:80/x?y=1", f'<html lang="{lang if k % 5 else "en"}"><head><title>t</title></head><script>x</script><p>{text[:400]}</p></html>', "clash")
             for k, (_, text, lang, _) in enumerate(rows[:200])]
    truth = {k: r[2] for k, r in enumerate(rows[:200])}
    pages += [(900, "https://www.frsite.fr/a", None, "c"), (901, None, "", "c"), (902, "no url", "<p></p>", "c"), (None, "https://www.frsite.fr/a", "<html lang=xx>", "c"), (0, *pages[0][1:])]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, parts string")
    got = identify(frame, languages, model).collect()
    assert Counter(r["page_id"] for r in got) == Counter(p[0] for p in pages)
    lang = {r["page_id"]: r["lang"] for r in got}
    assert np.mean([lang[k] == truth[k] for k in truth]) > 0.98
    assert lang[900] == "fr" and all(0 <= r["confidence"] <= 1 for r in got)
    hosts = {r["page_id"]: r["host"] for r in got}
    assert hosts[900] == "www.frsite.fr" and hosts[901] == "" and hosts[902] == "" and hosts[0].startswith("hot.")
    assert identify(frame.limit(0), languages, model).count() == 0
    empty, nothing = fit_text_model(no_docs)
    assert empty == [] and {r["lang"] for r in identify(frame, empty, nothing).collect()} == {None}


def test_page_parts():
    page = "<!DOCTYPE html><html class=a LANG = 'fr-CA'><head><title>T</title></head><body><nav>menu</nav><!-- c --><p>a &amp; b</p><script>x<y</script></body></html>"
    assert page_text(page) == "a & b" and declared_language(page) == "fr"
    assert page_text(None) == "" and declared_language("<p lang=de>") == ""


def test_pipeline(spark, small):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    columns, kept = docs.columns, []
    for name, stage in P.STAGES:
        path = P.run_path(spark, "test-pipeline")
        stage(spark, docs, small).write.parquet(path)
        out = spark.read.parquet(path)
        if name != "best-fit packing":
            assert out.columns == columns
        kept.append(out.collect())
        docs = out
    accepted, deduped, joined, mixed, packed = kept
    left = {r["doc_id"] for r in accepted}
    assert np.mean([(i in left) == bool(q) for i, q in quality.items()]) > 0.95
    want = {i: t for (i, t) in _kept([(r["doc_id"], r["text"]) for r in accepted], 2, 20)}
    assert {r["doc_id"]: r["text"] for r in deduped} == {i: t for i, t in want.items() if t or not before[i]}
    assert all(r["n_chars"] == len(r["text"]) for r in deduped if r["text"] != before[r["doc_id"]])
    order = sorted(deduped, key=lambda r: r["doc_id"])
    root = brute.components(len(order), _linked([brute.shingles(r["text"]) for r in order]))
    assert sorted(r["doc_id"] for r in joined) == [r["doc_id"] for k, r in enumerate(order) if root[k] == k]
    copies = Counter(r["doc_id"] for r in mixed)
    assert set(copies.values()) <= {1, 2} and set(copies) <= {r["doc_id"] for r in joined}
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == copies


def test_pipeline_decides_by_row(spark, small, rows, edge_docs):
    """Rows without an id or with a shared one are judged, and joined, each by its own text."""
    import corpus_pipeline as P

    from pyspark.sql import functions as F
    from workload_audit.llm.quality_ranking import rank_quality

    labels = spark.read.parquet(f"{small}/labels.parquet")
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    good, bad = ([r[1] for r in rows if quality.get(r[0]) == q] for q in (1, 0))
    near = good[3] + " and a word more"
    extra = [(None, good[0]), (None, bad[0]), (None, good[1]), (2000, good[2]), (2000, bad[1]), (2000, good[4]), (None, near), (None, good[3]), (2001, good[5]), (2001, good[5])]
    more = spark.createDataFrame(extra, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    docs = edge_docs.unionByName(more, allowMissingColumns=True)
    every = [(i, t) for i, t, *_ in rows] + extra
    # the same rows under ids of their own, the labelled ones kept
    own = [(i if i in quality else 5000 + k, t) for k, (i, t) in enumerate(every)]
    verdict = {r["doc_id"]: r["predicted"] for r in rank_quality(spark.createDataFrame(own, "doc_id long, text string"), labels).collect()}
    want = Counter(every[k] for k, (i, _) in enumerate(own) if verdict[i])
    accepted = P.quality_classifier(spark, docs, small)
    assert accepted.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in accepted.collect()) == want
    assert want[(None, good[0])] and not want[(None, bad[0])] and want[(2000, good[2])] and not want[(2000, bad[1])]

    joined = P.ngram_join(spark, docs, small)
    assert joined.columns == docs.columns
    order = sorted(every, key=lambda r: (r[0] is None, r[0] or 0))
    root = brute.components(len(order), _linked([brute.shingles(t) for _, t in order]))
    left = Counter((r["doc_id"], r["text"]) for r in joined.collect())
    assert Counter(i for i, _ in left.elements()) == Counter(order[k][0] for k, r in enumerate(root) if r == k)
    kept = [brute.shingles(t) for _, t in left.elements()]
    assert not _linked(kept)
