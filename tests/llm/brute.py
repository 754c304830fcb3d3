"""Plain versions of the operators, for small inputs."""
from __future__ import annotations

import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def quality_base(text):
    text = text or ""
    w = words(text)
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": dup, "n_repeat_words": len(covered),
            "base_failed": len(w) < 10 or 100 * len(covered) > 20 * len(w)}


def simhash(text, shingle=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    if not w:
        return 0
    grams = [w[i:i + shingle] for i in range(len(w) - shingle + 1)] or [w]
    hs = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(ids, prints, radius=2):
    """id -> least id reachable over links of at most ``radius`` bits."""
    by = defaultdict(list)
    for i, p in zip(ids, prints):
        by[p].append(i)
    keys, out, left = list(by), {}, set(by)
    for k in keys:
        if k not in left:
            continue
        left.discard(k)
        group, queue = [k], [k]
        while queue:
            x = queue.pop()
            near = [y for y in left if (x ^ y).bit_count() <= radius]
            left -= set(near)
            group += near
            queue += near
        known = [i for p in group for i in by[p] if i is not None]
        for p in group:
            for i in by[p]:
                out[i, p] = min(known) if known else None
    return out


def line_dedup(docs, min_words=50):
    """docs: (id, text) in corpus order -> kept text per document, by looking
    at every run of every length."""
    lines = [(t or "").split("\n") if t is not None else [] for _, t in docs]
    first = {}
    for d, ls in enumerate(lines):
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                first.setdefault(tuple(ls[a:b]), (d, a))
    out = []
    for d, ls in enumerate(lines):
        gone = set()
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                if sum(len(words(x)) for x in ls[a:b]) >= min_words and first[tuple(ls[a:b])] < (d, a):
                    gone.update(range(a, b))
        out.append(None if docs[d][1] is None else "\n".join(x for i, x in enumerate(ls) if i not in gone))
    return out


def maximal_runs(docs, min_words=50):
    """docs: (id, text) in corpus order -> {(id, start, lines, first id, first
    start)}: every minimal run against its earliest occurrence, grown line by
    line to both sides."""
    lines = [t.split("\n") if t is not None else [] for _, t in docs]
    first, out = {}, set()
    for d, ls in enumerate(lines):
        n = [len(words(x)) for x in ls]
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                total = sum(n[a:b])
                if total < min_words or total - n[a] >= min_words and total - n[b - 1] >= min_words:
                    continue
                e, c = first.setdefault(tuple(ls[a:b]), (d, a))
                if (e, c) == (d, a):
                    continue
                x, y, other = a, b, lines[e]
                while c - (a - x) > 0 and x > 0 and ls[x - 1] == other[c - (a - x) - 1]:
                    x -= 1
                while y < len(ls) and c + y - a < len(other) and ls[y] == other[c + y - a]:
                    y += 1
                out.add((docs[d][0], x, y - x, docs[e][0], c - (a - x)))
    return out


def mix(docs, weights=(3, 1, 2), share=150, cap=2):
    """docs: (id, text, source) -> words taken per document, by dealing whole
    documents out one at a time while that brings the source nearer its target;
    a source with one document only is cut at the word."""
    import hashlib
    from fractions import Fraction
    size = [len(words(t)) for _, t, _ in docs]
    names = sorted({s for *_, s in docs}, key=lambda s: (s is None, (s or "").encode()))
    total = {n: sum(k for k, (*_, s) in zip(size, docs) if s == n) for n in names}
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    goal, open_, left = {}, list(names), Fraction(sum(size) * share, 100)
    while open_:
        each = left / sum(weight[n] for n in open_)
        full = [n for n in open_ if cap * total[n] <= each * weight[n]]
        if not full:
            goal |= {n: each * weight[n] for n in open_}
            break
        for n in full:
            goal[n] = Fraction(cap * total[n])
            left -= goal[n]
            open_.remove(n)
    taken = [0] * len(docs)
    for n in names:
        mine = [i for i, (*_, s) in enumerate(docs) if s == n]
        mine.sort(key=lambda i: hashlib.md5(f"mix|{'' if docs[i][0] is None else docs[i][0]}|{docs[i][1] or ''}".encode()).hexdigest())
        rest = int(goal[n] + Fraction(1, 2))
        one = sum(size[i] > 0 for i in mine) == 1
        while rest > 0 and total[n]:
            for i in mine:
                k = min(size[i], rest) if one else size[i]
                if rest <= 0 or 2 * rest < k:
                    rest = 0
                    break
                taken[i] += k
                rest -= k
    return goal, taken


def quality_kept(text, limits, dup_lines=0.20):
    """The full verdict of the quality rules."""
    base = quality_base(text)
    if base["base_failed"]:
        return False
    text = text or ""
    w = words(text)
    chars = sum(map(len, w))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += len(line) * (line in seen)
            seen.add(line)
    if dup > dup_lines * chars:
        return False
    for n, most in limits.items():
        grams = Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
        covered = {j for i in range(len(w) - n + 1) if grams[tuple(w[i:i + n])] > 1 for j in range(i, i + n)}
        if sum(len(w[j]) for j in covered) > most * chars:
            return False
    return True


def pipeline(docs, limits):
    """docs: (id, text, source) -> (id, text) of every copy in the mix."""
    docs = sorted([d for d in docs if quality_kept(d[1], limits)], key=lambda d: d[0])
    cut = line_dedup([d[:2] for d in docs])
    docs = [(i, c, s) for (i, t, s), c in zip(docs, cut) if c == t or words(c)]
    comp = components([d[0] for d in docs], [simhash(d[1]) for d in docs])
    keep = set(comp.values())
    docs = [d for d in docs if d[0] in keep]
    out = []
    for (i, t, _), k in zip(docs, mix(docs)[1]):
        n = len(words(t))
        out += [(i, t)] * (k // n if n else 0)
        if n and k % n:
            out.append((i, t[:list(WORD.finditer(t))[k % n - 1].end()]))
    return out


def shingle_set(text, shingle=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    return {tuple(w[i:i + shingle]) for i in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set())


def jaccard_components(rows, percent=85):
    """(id, set size, least id reachable) per row (id, text), in order."""
    sets = [shingle_set(t) for _, t in rows]
    group = [None] * len(rows)
    for s in range(len(rows)):
        if group[s] is not None or not sets[s]:
            continue
        group[s], queue = s, [s]
        while queue:
            x = queue.pop()
            for y in range(len(rows)):
                if group[y] is None and sets[y]:
                    both = len(sets[x] & sets[y])
                    if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                        group[y] = s
                        queue.append(y)
    least = {}
    for (i, _), g in zip(rows, group):
        if g is not None and i is not None:
            least[g] = min(i, least.get(g, i))
    return [(i, len(s), i if g is None else least.get(g)) for (i, _), s, g in zip(rows, sets, group)]


def kmeans(rows, k=40, rounds=5, dim=64, scale=256, seed="2"):
    """rows: (id, vector, ...) -> (id, cluster, distance, cluster inertia,
    inertia, digest of the centroid), measuring every pair in every round."""
    import hashlib
    import math
    kept = [(r[0], [math.floor(scale * x) for x in r[1]]) for r in rows
            if r[1] is not None and len(r[1]) == dim and all(x is not None and math.isfinite(x) for x in r[1])]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    first = sorted(kept, key=lambda r: (digest(f"{seed}:{'' if r[0] is None else r[0]}"), r[1]))[:k]
    mids = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(mids))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        mids = [[sum(col) // len(g) for col in zip(*g)] if (g := groups.get(j)) else c for j, c in enumerate(mids)]
    got = [(i, *nearest(v)) for i, v in kept]
    per = Counter()
    for _, d, j in got:
        per[j] += d
    return [(i, j, d, per[j], sum(per.values()), digest(",".join(map(str, mids[j])))) for i, d, j in got]


def divergence(rows, least=30, add=5, unit=10 ** 9, top=50):
    """rows: (id, text, lang, source) -> (lang, source, part, item, value, rank)."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = {c: c + 32 for c in range(65, 91)}
    docs = [(term.findall((t or "").translate(lower)), lang or "", src or "") for _, t, lang, src in rows]
    count, had = defaultdict(Counter), defaultdict(Counter)
    for terms, lang, src in docs:
        count[lang, src].update(terms)
        count[lang, None].update(terms)
        had[lang].update(set(terms))
    out = []
    for lang in {lang for _, lang, _ in docs}:
        kept = [t for t, n in had[lang].items() if n >= least]
        sources = sorted({s for _, x, s in docs if x == lang})
        total = {s: sum(count[lang, s][t] for t in kept) for s in [*sources, None]}
        p = {s: {t: 1 + unit * (count[lang, s][t] + add) // (total[s] + add * len(kept)) for t in kept} for s in [*sources, None]}
        for s in sources:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            over = [(p[None][t] - p[s][t], t.encode()) for t in kept if count[lang, s][t] and p[s][t] > p[None][t]]
            for part, got in (("pair", pair), ("term", sorted(over)[:top])):
                out += [(lang, s, part, i.decode(), -v, k) for k, (v, i) in enumerate(sorted(got), 1)]
    return out
