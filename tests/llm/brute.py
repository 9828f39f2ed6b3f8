"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = " \t\n\x0b\x0c\r"


def lower(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring_dedup(docs, window=20):
    first, out = {}, []
    rows = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0))
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, ((math.inf,), 0)), ((i if i is not None else -math.inf,), k))
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < ((i if i is not None else -math.inf,), k):
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def line_dedup(docs, least):
    held = Counter()
    lines = [(i, (t or "").split("\n")) for i, t in docs]
    key = lambda x: lower(x.strip(SPACES))
    for _, own in lines:
        held.update({key(x) for x in own})
    out = []
    for i, own in lines:
        kept = [x for x in own if not (key(x) and held[key(x)] >= least)]
        out.append((i, len(own), len(own) - len(kept), sha("\n".join(kept))))
    return out


def exact_dedup(docs):
    groups = defaultdict(list)
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in docs]
    for i, t in norm:
        groups[t].append(i)
    best = {t: min((i for i in g if i is not None), default=None) for t, g in groups.items()}
    return [(i, best[t], len(groups[t]), i == best[t], sha(t)) for i, t in norm]


def fingerprint(text):
    w = WORD.findall(lower(text or ""))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if h and 2 * sum(x >> k & 1 for x in h) > len(h))


def linked(prints, bits=3):
    """prints: id -> fingerprint; id -> smallest id reachable."""
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def contaminated(docs, items, threshold=0.8):
    def shingles(t):
        w = WORD.findall((t or "").lower())
        return {" ".join(w[k : k + 5]) for k in range(len(w) - 4)}

    out = set()
    known = [(j, shingles(t)) for j, t in items]
    for i, t in docs:
        own = shingles(t)
        out |= {(i, j, len(s), len(s & own)) for j, s in known if s and i is not None and len(s & own) >= threshold * len(s) - 1e-9}
    return out


def discounts(counts):
    n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    plain = [0.5, 1.0, 1.5]
    if min(n) <= 0:
        return [0, *plain]
    y = n[0] / (n[0] + 2 * n[1])
    made = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return [0, *(d if 0 < d <= k else p for k, (d, p) in enumerate(zip(made, plain, strict=True), 1))]


def tokens(text):
    return [*WORD.findall(lower(text or "")), None]


class Bigrams:
    def __init__(self, texts):
        lists = [tokens(t) for t in texts]
        self.c = Counter(w for t in lists for w in t)
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.pairs = Counter(p for t in lists for p in zip(["<start>", *t[:-1]], t, strict=True))
        self.cont = Counter(w for _, w in self.pairs)
        self.d, self.e = discounts(self.pairs.values()), discounts(self.cont.values())
        self.total, self.given = Counter(), Counter()
        for (a, _), k in self.pairs.items():
            self.total[a] += k
            self.given[a] += self.d[min(k, 3)]
        self.left = sum(self.e[min(k, 3)] for k in self.cont.values()) / len(self.pairs) if self.pairs else 1.0

    def p(self, a, w):
        low = (self.cont[w] - self.e[min(self.cont[w], 3)]) / max(1, len(self.pairs)) + self.left / (self.v + 1)
        if not self.total[a]:
            return low
        k = self.pairs.get((a, w), 0)
        return max(k - self.d[min(k, 3)], 0) / self.total[a] + self.given[a] / self.total[a] * low

    def score(self, text):
        t = tokens(text)
        base = sum(math.log10((self.c[w] + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in t)
        return len(t), sum(self.c[w] > 0 for w in t), base, sum(math.log10(self.p(a, w)) for a, w in zip(["<start>", *t[:-1]], t, strict=True))


def crc_fold(i):
    return zlib.crc32(str(i).encode()) % 5


def toxicity_score(text, field, features):
    """A document's score by forward-backward over its whole chain, token by token, and the regression."""
    words = [w.encode() for w in WORD.findall(text or "")]
    e = [math.exp(max(-30, min(30, sum(field.weights.get(f, 0) for f in features(w))))) for w in words]
    m, p = field.moves, []
    if words:
        fore = [(1.0, field.start * e[0])]
        for x in e[1:]:
            a, b = fore[-1]
            one, two = a * m[0][0] + b * m[1][0], (a * m[0][1] + b * m[1][1]) * x
            fore.append((one / (one + two), two / (one + two)))
        back = [(1.0, 1.0)]
        for x in e[:0:-1]:
            a, b = back[-1]
            one, two = m[0][0] * a + m[0][1] * x * b, m[1][0] * a + m[1][1] * x * b
            back.append((one / (one + two), two / (one + two)))
        p = [f[1] * b[1] / (f[0] * b[0] + f[1] * b[1]) for f, b in zip(fore, back[::-1], strict=True)]
    x = [1, max(p, default=0), math.log1p(sum(p)), math.sqrt(sum(p) / max(1, len(p)))]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, field.regression, strict=True)))), x
