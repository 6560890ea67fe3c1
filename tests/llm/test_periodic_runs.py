"""Periodic runs (12) against a search that tries every lag at every word."""

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm.periodic_runs import Search, Words, periodic_runs, strongest

SCHEMA = "doc_id long, text string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_runs(w, exponent=4, least=6):
    found = {}
    for p in range(1, len(w) // exponent + 1):
        i = p
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - p]:
                j += 1
            n = j - i + p
            if j > i and n >= max(least, exponent * p):
                found.setdefault((i - p, n), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in found.items())


def collapsed(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def text(rng):
    """Words with blocks repeated in blocks, whole and cut short, over a small or large vocabulary."""
    letters = rng.choice(["ab", "abc", "abcdefghijklmnop"])
    out = []
    while len(out) < rng.choice([0, 5, 30, 90]):
        block = [rng.choice(letters) for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13]))]
        if rng.random() < 0.3:
            block = block * rng.randint(2, 4) + block[:rng.randint(0, len(block))]
        out += block * rng.choice([1, 1, 4, 5]) + block[:rng.randint(0, len(block))]
        if rng.random() < 0.4:
            out.append(rng.choice("xyz"))
    return rng.choice(["", " ", "\n"]) + rng.choice([" ", "  ", "\t\n"]).join(out) + rng.choice(["", "\r\n"])


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("exponent,least", [(4, 6), (4, 23), (6, 6), (5, 40)])
def test_search_is_the_plain_one(seed, exponent, least):
    rng = random.Random(seed)
    texts = [text(rng) for _ in range(40)] + [None, "", "  ", "a " * 6, "a " * 5]
    rng.shuffle(texts)
    words = Words(pa.array(["x x x x x x", *texts]).slice(1))
    got = {}
    for s, n, p in Search(words.ids, words.rows, exponent, least).all():
        row = max(i for i in range(len(texts)) if words.rows[i] <= s)
        got.setdefault(row, []).append((s - words.rows[row], n, p))
    for i, x in enumerate(texts):
        assert sorted(got.get(i, [])) == plain_runs(words_of(x), exponent, least), repr(x)


def test_small_steps(monkeypatch):
    from quarry.llm import periodic_runs as module
    monkeypatch.setattr(module, "PAIRS", 7)
    rng = random.Random(5)
    for _ in range(60):
        w = words_of(text(rng)) + ["a", "b", "a", "a", "c", "d", "e", "f", "g"] * rng.randint(0, 9)
        words = Words(pa.array([" ".join(w)]))
        assert Search(words.ids, words.rows, 4, 6).all() == plain_runs(w)


def test_long_texts_stay_cheap():
    rng = random.Random(1)
    vocabulary = ["the", "of"] * 100 + [str(i) for i in range(3000)]
    prose = rng.choices(vocabulary, k=300_000)
    block = [rng.choice("abcdefgh") for _ in range(1001)]
    for w, most in ((["a"] * 400_000, 1), (["a", "b"] * 200_000, 1), (block * 300, 1), (prose, 0), ((["a"] * 999 + ["b"]) * 300, 301)):
        t0 = time.process_time()
        words = Words(pa.array([" ".join(w)]))
        runs = Search(words.ids, words.rows, 4, 6).all()
        assert len(runs) == most and time.process_time() - t0 < 20


def rows_of(df):
    return [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed, r.best and tuple(r.best)) for r in df.collect()]


def test_operator(spark):
    rng = random.Random(9)
    docs = [(i, text(rng)) for i in range(100)] + [(500, None), (501, ""), (None, "a " * 9), (None, "a " * 9), (7, "b c " * 5)]
    docs.append((502, "long " * 30_000 + " ".join(map(str, range(200_000)))))          # over one slice
    df = spark.createDataFrame(docs, SCHEMA).repartition(3).withColumns({c: F.lit(1) for c in ("runs", "n_words", "best", "collapsed")})
    got = rows_of(periodic_runs(df).withColumn("best", strongest("runs")))
    want = []
    for i, x in docs:
        w = words_of(x)
        runs = plain_runs(w) if len(w) < 10_000 else [(0, 30_000, 1)]
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
        want.append((i, len(w), runs, collapsed(w, runs), best))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(df, min_exponent=2)


def test_query(spark):
    from quarry.llm.queries import QUERIES
    from quarry.sources.tables import load
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, sf).collect()}
    with_runs = 0
    for i, x in load(spark, sf, "documents").select("doc_id", "text").collect():
        w, h = words_of(x), zlib.crc32(str(i).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (j - a) % p] for j in range(a, n)]
        runs = plain_runs(w)
        with_runs += bool(runs)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
        r = got.pop(i)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(best or (None,) * 3))
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
    assert not got and with_runs >= 10
