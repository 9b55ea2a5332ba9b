"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def sort_id(i):
    return (i is None, i if i is not None else 0)


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(SPACE.sub(" ", t or "").encode()).hexdigest()].append(i)
    out = []
    for h, ids in groups.items():
        ids.sort(key=sort_id)
        out += [(i, ids[0], len(ids), k == 0, h) for k, i in enumerate(ids)]
    return out


def fingerprint(text, width=3):
    w = words(lower(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def linked(values, budget=2):
    """Least member of each value's component."""
    values, label = sorted(set(values)), {}
    for v in values:
        if v in label:
            continue
        label[v], todo = v, [v]
        while todo:
            x = todo.pop()
            for y in values:
                if y not in label and (x ^ y).bit_count() <= budget:
                    label[y] = v
                    todo.append(y)
    return label


def simhash(rows, budget=2):
    f = [(i, fingerprint(t)) for i, t in rows]
    label = linked([x for _, x in f], budget)
    least = {}
    for i, x in f:
        if i is not None:
            least[label[x]] = min(i, least.get(label[x], i))
    return [(i, f"{x:016x}", least.get(label[x])) for i, x in f]


def fingerprint_tables(text, width=5, tables=16):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    width = min(width, len(w))
    shingles = [" ".join(w[k : k + width]).encode() for k in range(len(w) - width + 1)] if w else []
    out = []
    for t in range(tables):
        count = [0] * 64
        for s in shingles:
            h = xxhash.xxh64_intdigest(s, 42)
            if t:
                h = (h + t * 0x9E3779B97F4A7C15) % 2**64
                h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                h = (h ^ h >> 27) * 0x94D049BB133111EB % 2**64
                h ^= h >> 31
            for b in range(64):
                count[b] += h >> b & 1
        out.append(sum((2 * c > len(shingles)) << b for b, c in enumerate(count)))
    return out


def near(rows, budget=4):
    f = [(i, fingerprint_tables(t)) for i, t in rows]
    label = list(range(len(f)))
    for x in range(len(f)):
        for y in range(x):
            if label[x] != label[y] and any((p ^ q).bit_count() <= budget for p, q in zip(f[x][1], f[y][1])):
                old, new = label[x], label[y]
                label = [new if v == old else v for v in label]
    least = {}
    for v, (i, _) in zip(label, f):
        least[v] = min(i, least.get(v, i))
    return [(i, least[v]) for v, (i, _) in zip(label, f)]


def substring(rows, window=50):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, (2,)), sort_id(i))
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < sort_id(i):
                gone.update(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def discounts(n):
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0), k) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


def kneser_ney(rows, order):
    tok = lambda t: [*words(lower(t)), "</s>"]
    train = [tok(t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    raw = Counter(w for t in train for w in t)
    count = {n: Counter() for n in range(1, order + 1)}
    for t in train:
        t = ["<s>", *t]
        for j in range(1, len(t)):
            n = min(order, j + 1)
            count[n][tuple(t[j - n + 1 : j + 1])] += 1
    for n in range(order - 1, 0, -1):
        for g in count[n + 1]:
            count[n][g[1:]] += 1
    d = {n: discounts([sum(c == k for c in count[n].values()) for k in (1, 2, 3, 4)]) for n in count}
    ctx = {n: defaultdict(lambda: [0, 0, 0, 0]) for n in count}
    for n in count:
        for g, c in count[n].items():
            x = ctx[n][g[:-1]]
            x[0] += c
            x[min(c, 3)] += 1
    n_all, v = sum(raw.values()), len(raw)

    def p(w, h):
        low = p(w, h[1:]) if h else 1 / (v + 1)
        x, n = ctx[len(h) + 1].get(h), len(h) + 1
        if not x:
            return low
        c = count[n][(*h, w)]
        return max(c - [0, *d[n]][min(c, 3)], 0) / x[0] + sum(d[n][k] * x[k + 1] for k in range(3)) / x[0] * low

    out = {}
    for i, t in rows:
        t = tok(t)
        base = sum(math.log10((raw[w] + 0.1) / (n_all + 0.1 * (v + 1))) for w in t)
        s = ["<s>", *t]
        score = sum(math.log10(p(s[j], tuple(s[max(0, j - order + 1) : j]))) for j in range(1, len(s)))
        out[i, len(t), sum(raw[w] > 0 for w in t), n_all] = (base, score)
    return out


def archive(rows, min_bytes=100):
    groups = defaultdict(list)
    for i, h in rows:
        groups[h or ""].append(i)
    out = []
    for h, ids in groups.items():
        raw = h.encode()
        least = min((i for i in ids if i is not None), default=None)
        for i in ids:
            again = len(raw) >= min_bytes and least is not None and i != least
            out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", least if again else None))
    return out


def merge_pieces(pieces, text):
    """Merging by definition: the best adjacent pair first, the leftmost of equals."""
    ids = {p: (i, score) for i, (p, score, kind) in enumerate(pieces) if kind == 1}
    symbols = list("\u2581" + text.replace(" ", "\u2581")) if text else []
    while True:
        pairs = [(-ids[a + b][1], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in ids]
        if not pairs:
            return [ids[s][0] for s in symbols]
        k = min(pairs)[1]
        symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]


def overlaps(docs, items, short_items, min_tokens=6, stretch=13, similarity=0.8):
    """Every item laid against every document at every shift."""
    cut = lambda t: re.findall(r"\w+", (t or "").lower())
    out = []
    for d, text in docs:
        t = cut(text)
        for i, x in items:
            x = cut(x)
            n = min(stretch, len(x)) if len(x) >= min_tokens else len(x)
            least = math.ceil(similarity * n - 1e-9) if len(x) >= min_tokens else n
            best = None
            for shift in range(n - len(x), len(t) - n + 1) if n and (short_items or len(x) >= min_tokens) else ():
                lo, hi = max(0, -shift), min(len(x), len(t) - shift)
                same = [x[k] == t[k + shift] for k in range(lo, hi)]
                if any(sum(same[k : k + n]) >= least for k in range(len(same) - n + 1)) and sum(same) > (best[0] if best else 0):
                    best = sum(same), sum(same) / len(x), max(0, shift)
            if best:
                out.append((d, i, *best))
    return out


def languages(rows, samples, block):
    """Phrases by searching the samples; (language, score) by id."""
    flat = lambda t: re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in (t or "").lower()))
    samples = {k: flat(t) for k, t in sorted(samples.items())}

    def phrases(text, sample):
        n = i = 0
        while i < len(text):
            j = i + 1
            while j < len(text) and text[i : j + 1] in sample:
                j += 1
            n, i = n + 1, j
        return n

    out = {}
    for i, t in rows:
        t = flat(t)
        if not t.strip():
            out[i] = ("und", 0.0)
            continue
        bits = [sum(phrases(t[k : k + block], s) for k in range(0, len(t), block)) * math.log2(max(2, len(s))) / len(t) for s in samples.values()]
        least = min(bits)
        out[i] = (list(samples)[bits.index(least)], max(0.0, 1 - least / ((sum(bits) - least) / (len(bits) - 1))))
    return out
