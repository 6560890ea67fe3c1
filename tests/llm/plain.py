"""Plain single-process versions of the operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash


def clusters(items, linked):
    """{item: smallest item reachable}; ``items`` in ascending order."""
    parent = {x: x for x in items}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(items):
        for b in items[:i]:
            if linked(a, b):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {x: top(x) for x in items}


def simhash(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def line_runs(docs, m, line_words=None):
    """docs: (id, text) in order, ids distinct; the texts without later copies of m-line runs, and
    with ``line_words`` without later copies of lines of so many words."""
    seen, long, out = set(), set(), {}
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        if text is None:
            out[i] = None
            continue
        lines = text.split("\n")
        at = [n for n, x in enumerate(lines) if x.strip(" \t\r\f\v")]
        gone, new = set(), []
        for p in range(len(at) - m + 1):
            w = tuple(lines[n] for n in at[p:p + m])
            if w in seen:
                gone.update(at[p:p + m])
            seen.add(w)
        for n in at:
            if line_words is not None and len(re.split(r"[ \t\r\f\v]+", lines[n].strip(" \t\r\f\v"))) >= line_words:
                if lines[n] in long:
                    gone.add(n)
                long.add(lines[n])
        out[i] = "\n".join(x for n, x in enumerate(lines) if n not in gone)
    return out


def bench_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contamination(docs, items, window):
    """[(id, n_words, n_hit, sorted items)]"""
    windows = defaultdict(set)
    for item, text in items:
        w = bench_words(text)
        for i in range(max(len(w) - window + 1, 1) if w else 0):
            windows[tuple(w[i:i + window])].add("null" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for i, text in docs:
        w = bench_words(text)
        hit, found = set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                got = windows.get(tuple(w[a:a + n]))
                if got:
                    hit.update(range(a, a + n))
                    found |= got
        out.append((i, len(w), len(hit), sorted(found)))
    return out


def base_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if wins[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


class KneserNey:
    """Interpolated modified Kneser-Ney by the textbook formula, characters, order 5."""

    def __init__(self, texts, order=5):
        self.order = order
        self.c = {order: Counter()}
        for t in texts:
            s = self.pad(t)
            for i in range(order - 1, len(s)):
                self.c[order][s[i - order + 1:i + 1]] += 1
        for k in range(order - 1, 0, -1):
            self.c[k] = Counter(g[1:] for g in self.c[k + 1])
        self.d, self.ctx = {}, {}
        for k, c in self.c.items():
            n = Counter(c.values())
            if all(n[i] for i in (1, 2, 3, 4)):
                y = n[1] / (n[1] + 2 * n[2])
                self.d[k] = [0] + [max(0.05, min(float(i), i - (i + 1) * y * n[i + 1] / n[i])) for i in (1, 2, 3)]
            else:
                self.d[k] = [0, 0.5, 1.0, 1.5]
            self.ctx[k] = defaultdict(list)
            for g, v in c.items():
                self.ctx[k][g[:-1]].append(v)
        self.v = len(self.c[1]) + 1

    def pad(self, t):
        return "\x02" * (self.order - 1) + " ".join((t or "").split()) + "\x03"

    def p(self, g):
        if not g:
            return 1 / self.v
        k, h = len(g), g[:-1]
        low = self.p(g[1:])
        values = self.ctx[k].get(h)
        if not values:
            return low
        own = self.c[k].get(g, 0)
        gamma = sum(self.d[k][min(x, 3)] for x in values) / sum(values)
        return max(own - self.d[k][min(own, 3)], 0) / sum(values) + gamma * low

    def mean_nll(self, t):
        s = self.pad(t)
        n = range(self.order - 1, len(s))
        return -sum(math.log(self.p(s[i - self.order + 1:i + 1])) for i in n) / len(n)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()
