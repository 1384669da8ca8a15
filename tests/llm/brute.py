"""Plain single-process versions of the operators, straight from their definitions."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def fold(word):
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile("(" + "|".join(map(fold, ("password", "passwd", "secret", "token"))) + "|" + fold("api") + "_?" + fold("key")
                    + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def spelled(spans):
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)


def simhash(text, n=4):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = list(ids)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if linked(a, b):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


def without_repeats(docs, size=50):
    """docs: {doc_id: text} -> {doc_id: (n_words, n_removed, sha of what is left)}."""
    first = {}
    w = {d: words(t) for d, t in docs.items()}
    for d in sorted(w):
        for i in range(len(w[d]) - size + 1):
            first.setdefault(tuple(w[d][i:i + size]), d)
    out = {}
    for d, ws in w.items():
        gone = {j for i in range(len(ws) - size + 1) if first[tuple(ws[i:i + size])] < d for j in range(i, i + size)}
        out[d] = (len(ws), len(gone), sha(" ".join(x for j, x in enumerate(ws) if j not in gone)))
    return out


def targets(sizes, cap=3.0):
    """sizes: {source: size} -> {source: target}, by resharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > cap * sizes[s]}
        if not over:
            return {**out, **{s: left * weight[s] / total for s in open_}}
        out |= {s: cap * sizes[s] for s in over}
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def groups(pairs):
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return out


def best_matches(docs, items, k=50):
    """docs: [(key, text)], items: [(item, text)] -> {place of item: [(rank, key, score)]}."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = {c: c + 32 for c in range(65, 91)}
    tf = [Counter(term.findall((t or "").translate(low))) for _, t in docs]
    n = [sum(c.values()) for c in tf]
    many, total = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in tf for t in c)
    out = {}
    for place, (_, text) in enumerate(items):
        scored = []
        for (key, _), c, size in zip(docs, tf, n):
            m = 100 - 50 + 50 * size * many // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m))
                    for t in set(term.findall((text or "").translate(low))) if t in c)
            if s > 0:
                scored.append((-s, key is None, key))
        out[place] = [(i + 1, key, -s) for i, (s, _, key) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def phrases(docs, least=10, cover=50, top=2000):
    """docs: [(lang, text)] -> {lang: [(rank, phrase, a, l, r, n, score)]}."""
    counts = defaultdict(Counter)
    low = {c: c + 32 for c in range(65, 91)}
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            counts[lang or "und" if lang is None else lang].update(tuple(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = {}
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        most = Counter()
        for p, a in f.items():
            if len(p) == 3 and a >= least:
                for q in (p[:2], p[1:]):
                    most[q] = max(most[q], a)
        rows = []
        for p, a in f.items():
            if len(p) > 1 and a >= least and not (most[p] and 100 * most[p] >= cover * a):
                score, _, left, right = min((10 ** 6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        out[lang] = [(i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return {k: v for k, v in out.items() if v}


def tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(v, m):
    """Combined p-value of three tests on symbols 0 to m - 1."""
    n = len(v)
    chi = sum(c * c for c in Counter(v).values()) * m / n - n
    free = m - 1
    z = ((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    turns = sum((a >= m / 2) != (b >= m / 2) for a, b in zip(v, v[1:]))
    runs = (turns - (n - 1) / 2) / (math.sqrt(n - 1) / 2)
    mid = (m - 1) / 2
    lag = sum((a - mid) * (b - mid) for a, b in zip(v, v[1:])) / (math.sqrt(n - 1) * (m * m - 1) / 12)
    x = -sum(math.log(max(p, 1e-12)) for p in (tail(z), 2 * tail(abs(runs)), 2 * tail(abs(lag))))
    return math.exp(-x) * (1 + x + x * x / 2)


def candidates(text):
    """(start, end, bin, p) of every run of key characters with letters, digits and an alphabet."""
    from pluvian.llm.secrets import ALPHABETS
    out = []
    for t in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text or ""):
        name, letters = next(((n, a) for n, a in ALPHABETS if set(t[0]) <= set(a)), (None, None))
        if name and re.search("[0-9]", t[0]) and re.search("[A-Za-z]", t[0]):
            out.append((t.start(), t.end(), f"{name}:{math.floor(2 * math.log2(len(t[0])))}", battery([letters.index(c) for c in t[0]], len(letters))))
    return out


def all_spans(texts, rate=0.1, steps=50):
    """Base spans, and random ones that pass their bin's cutoff and overlap no base span."""
    maybe = [candidates(t) for t in texts]
    cells = defaultdict(Counter)
    for c in maybe:
        for _, _, bin_, p in c:
            cells[bin_][min(int(p * steps), steps - 1)] += 1
    cutoff = {}
    for bin_, n in cells.items():
        random = 2 * sum(k for c, k in n.items() if c >= steps // 2)
        for c in sorted(n):
            taken = sum(k for d, k in n.items() if d >= c)
            if max(0.0, taken - random * (1 - c / steps)) <= rate * taken:
                cutoff[bin_] = c / steps
                break
    out = {}
    for d, (text, c) in enumerate(zip(texts, maybe)):
        base = base_spans(text)
        more = [(a, 3, z) for a, z, b, p in c if b in cutoff and p >= cutoff[b] and not any(s < z and a < e for s, _, e in base)]
        out[d] = sorted(base + more)
    return out
