"""Plain, slow versions of the operators' contracts."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RULES = {
    "assign": (re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}


def secrets(text: str | None) -> tuple[int, int, int, str]:
    spans, counts = [], Counter()
    for rank, (kind, (pattern, group, least)) in enumerate(RULES.items()):
        for m in pattern.finditer(text or ""):
            if len(m[group]) >= least:
                spans.append((m.start(), rank, m.end(), kind))
                counts[kind] += 1
    joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
    return counts["assign"], counts["access"], counts["hex"], joined


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            covered.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def shingles(text: str | None, k: int = 5) -> frozenset:
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def components(n: int, links) -> list[int]:
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def targets(sizes: dict) -> dict:
    """Words each source shall have, by the resharing rule."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, out, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        left, w = total - sum(out.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 2 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / w for s in free}
        out |= {s: 2.0 * sizes[s] for s in over}
        free -= set(over)
    return out


def crc(text: str | None) -> int:
    return zlib.crc32((text or "").encode())


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def simhash(text: str | None, k: int = 4) -> int:
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def smallest_ids(ids, roots) -> list:
    least: dict = {}
    for i, r in zip(ids, roots, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [least.get(r) for r in roots]


def damaged(rows):
    """{conv: [(turn, role, text)]} after the damage, in order; every conversation has its entry."""
    out: dict = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        told = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        code = zlib.crc32(f"{told[0]}:{told[1]}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", told[3]) if code == 2 else told[3]
        own += [(turn, "user" if code == 4 else told[2], text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def row_hash(role: str, text: str) -> int:
    """Spark's hash of two strings, which orders rows of equal turns."""
    h = 42
    for part in (role, text):
        h = xxhash.xxh64_intdigest(part.encode(), seed=h)
    return h - (1 << 64) if h >> 63 else h


def repair(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit and hash of one conversation's rows after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, row_hash(r[1], r[2])))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    grammar = re.compile("(s?(ua)+)?")
    # the least (cost, audit) for each pair of rows read and roles given so far; what has been given only matters by its last role
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def inserted(best):
        for _ in range(3):
            for last, (cost, audit, lines) in list(best.items()):
                for role in after[last]:
                    if role != "s":
                        new = (cost + 2, audit + "I", (*lines, ({"u": "user", "a": "assistant"}[role], "")))
                        best[role] = min(best.get(role, new), new, key=lambda x: x[:2])
        return best

    for (_, role, text), fault in zip(rows, faults, strict=True):
        now: dict = {}
        for last, (cost, audit, lines) in inserted(best).items():
            options = [(last, cost + 3, "D", lines)]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if role[:1] and role[:1] in after[last]:
                    options.append((role[:1], cost + extra, "K", (*lines, (role, text))))
                options += [(x, cost + 2 + extra, "R", (*lines, ({"u": "user", "a": "assistant"}[x], text))) for x in after[last] if x != "s"]
            for to, price, edit, out in options:
                new = (price, audit + edit, out)
                now[to] = min(now.get(to, new), new, key=lambda x: x[:2])
        best = now
    ends = [x for last, x in inserted(best).items() if last in ("", "a")]
    cost, audit, lines = min(ends, key=lambda x: x[:2])
    assert grammar.fullmatch("".join(role[:1] for role, _ in lines))
    count = Counter(faults)
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha256("\n".join(f"{r}:{t}" for r, t in lines))


def divergence(rows, least=10, top=10):
    """{(lang, source, part, item, value, rank)} of (lang, source, text) rows."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, docs, groups = {}, {}, set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = term.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        counts.setdefault((lang, source), Counter()).update(words)
        docs.setdefault(lang, Counter()).update(set(words))
    out = set()
    for lang in docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        own = {s: counts[lang, s] for x, s in groups if x == lang}
        whole = sum(own.values(), Counter())

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        p = {s: shares(c) for s, c in own.items()}
        q = shares(whole)
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(sum(far(p[s][t], p[x][t]) for t in kept), x) for x in own if x != s]
            terms = [(far(p[s][t], q[t]), t) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])}
    return out
