"""Line runs (2), SimHash (5) and unit dedup (7) against plain versions."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import components, simhash
from quarry.llm.key_streams import pack_numbers, pack_sorted
from quarry.llm.line_runs import line_dedup, repeated_runs
from quarry.llm.simhash import one_per_component
from quarry.llm.unit_dedup import KEPT, PLACES, _kept_places, _unpacked, passage_dedup, unit_dedup, units
from tests.llm import plain

SCHEMA = "doc_id long, text string"


def texts(seed, n=60):
    rng = random.Random(seed)
    lines = ["alpha beta gamma delta one", "b", "c d e f g h", "", " ", "x y z w v u", "ü ñ"]
    docs = [(i, "\n".join(rng.choice(lines + [f"only {i} {rng.random()} here now"]) for _ in range(rng.randint(0, 12))))
            for i in range(n)]
    return [*docs, (n, None), (n + 1, ""), (n + 2, docs[3][1]), (n + 3, "b\n" * 40)]


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_line_runs_match_plain(spark, m):
    docs = texts(m)
    out = line_dedup(spark.createDataFrame(docs, SCHEMA).repartition(5), m).collect()
    assert {r.doc_id: r.text for r in out} == plain.line_runs(docs, m)


def test_line_runs_edges(spark):
    two = "one line here\nanother line"
    rows = [(None, two, "k", 1), (7, two, "k", 2), (7, two, "k", 2), (7, "other", "k", 3), (8, None, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __x string, pos int")
    out = sorted(line_dedup(df, 2).collect(), key=str)
    assert df.columns == line_dedup(df, 2).columns
    # the row without an id comes first and stays; rows that repeat id and text get the same result
    assert sorted((str(r.doc_id), str(r.text)) for r in out) == sorted(
        [("None", two), ("7", ""), ("7", ""), ("7", "other"), ("8", "None")])
    assert line_dedup(df.limit(0), 2).collect() == []


def test_long_single_lines(spark):
    passage, short = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(49))
    docs = [(1, f"a\n{passage}\nb\n{short}"), (2, f"c\n{passage}\nd\n{short}\ne"), (3, passage), (4, short), (5, f"{passage}\nb"),
            (6, f"f\n\n{passage}\n{passage}\n"), (None, f" {passage}")]
    df = spark.createDataFrame(docs, SCHEMA)
    out = {r.doc_id: (r.text, r.gone) for r in line_dedup(df, 2, counts=("n", "gone"), line_words=50).collect()}
    assert out == {1: (docs[0][1], 0), 2: (f"c\nd\n{short}\ne", 1), 3: ("", 1), 4: (short, 0), 5: ("", 2), 6: ("f\n\n", 2),
                   None: (f" {passage}", 0)}
    assert {r.doc_id: r.text for r in line_dedup(df, 2).collect()} == plain.line_runs(docs, 2)


def test_maximal_runs(spark):
    body = [f"line number {i}" for i in range(20)]
    docs = [(1, "\n".join(body)), (2, "\n".join(["front", *body[4:15], "back"]))]
    _, runs = repeated_runs(spark.createDataFrame(docs, SCHEMA), 2)
    assert [(r.id, r.pos, r.n_lines, r.first_id, r.first_pos) for r in runs.collect()] == [(2, 1, 11, 1, 4)]


def test_simhash_fingerprints(spark):
    docs = [(1, None), (2, ""), (3, "One"), (4, "one two"), (5, "A b\tc\nd \x0b e"), (6, "x " * 70000), (7, "é è ü x")]
    got = {r.doc_id: r.fp % 2 ** 64 for r in simhash.fingerprints(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == {i: plain.simhash(t) for i, t in docs}


def near(spark, docs, **kw):
    return {r.doc_id: (int(r.fingerprint, 16), r.component_id)
            for r in simhash.near_duplicates(spark.createDataFrame(docs, SCHEMA), **kw).collect()}


def test_near_duplicates_match_plain(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    docs, n = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(400)]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append((n, " ".join(copy)))
            n += 1
    docs += [(n, None), (n + 1, ""), (n + 2, " \n")]
    got = near(spark, docs)
    fp = {i: plain.simhash(t) for i, t in docs}
    want = plain.clusters(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    assert got == {i: (fp[i], want[i]) for i in fp}
    assert len(set(want.values())) < len(docs) - 10


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "q r s t"), (6, None)],
                               "doc_id long, text string").withColumns({"fp": F.lit(1), "part": F.lit("x")})
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 5), (5, 5), (5, 5), (6, 6)], key=str)
    assert simhash.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("distance,block", [(3, 4096), (3, 7), (5, 16), (0, 50)])
def test_links_connect_what_brute_force_connects(spark, distance, block):
    rng = random.Random(distance * 100 + block)
    fps = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 40])):
            fps.add(x)
            x ^= 1 << rng.randrange(64)          # chains of links
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    found = simhash.links(df, distance, sample=64, block=block)
    lab = {r.node % 2 ** 64: r.label for r in components.connected_components(found, "a", "b").collect()}
    want = plain.clusters(fps, lambda a, b: (a ^ b).bit_count() <= distance)
    groups = {}
    for x in fps:
        groups.setdefault(lab.get(x, ("alone", x)), set()).add(x)
    wanted = {}
    for x, t in want.items():
        wanted.setdefault(t, set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_plan_covers_the_distance():
    rng = np.random.default_rng(0)
    sample = rng.integers(0, 2 ** 63, 500).astype(np.uint64)
    for n in (10, 10 ** 6, 10 ** 10):
        for d in (0, 1, 3, 6):
            parts = simhash.plan(sample, n, d)
            # any spread of d differing bits over the parts stays within the threshold of one
            assert sum(t + 1 for _, t in parts) == d + 1 or (len(parts) == 1 and parts[0][1] == d)
            bits = [b for g, _ in parts for b in g]
            assert len(bits) == len(set(bits))
    assert simhash.allocate([[0, 5, 50], [0, 1, 2], [0, 9, 99]], -1) == [-1, 1, -1]


def test_components_long_chain(spark):
    df = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components.connected_components(df, "a", "b").filter("label <> 0").count() == 0
    assert components.connected_components(df.limit(0), "a", "b").count() == 0


def test_units():
    assert [(a, b) for a, b, _, n in units("ab\n\nc") if n] == [(0, 3), (4, 5)]
    assert [(a, b) for a, b, _, n in units("a b\nc\n\n \nd\n", "paragraph") if n] == [(0, 9), (9, 11)]
    assert units(None) == units("") == []
    # normalisation: case of ASCII letters and white space
    assert units("A  b\tÉ")[0][2] == units(" a b É \n")[0][2] != units("a b é")[0][2]


def test_unit_dedup_matches_plain(spark):
    docs = texts(9)
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in docs], "doc_id long, text string, start string, removed int")
    got = {r.doc_id: r for r in unit_dedup(df.repartition(4), min_words=5).collect()}
    seen, n = {}, 0
    for i, t in docs:
        lines, at, left, gone = (t or "").split("\n"), 0, [], []
        for x in lines:
            key = " ".join(x.lower().split())
            if len(key.split()) >= 5 and key in seen:
                gone.append((at, min(at + len(x) + 1, len(t)), *seen[key]))
            else:
                left.append(x)
                seen.setdefault(key, (i, at))
            at += len(x) + 1
        assert got[i].text == (t if t is None else "\n".join(left))
        assert [tuple(s) for s in got[i].removed] == gone
        n += len(gone)
    assert n > 5 and got[0].start == "s"


def test_unit_dedup_edges(spark):
    one = "these are five words here"
    df = spark.createDataFrame([(None, one), (3, one), (3, one), (4, None)], SCHEMA)
    got = sorted(((r.doc_id, r.text, len(r.removed)) for r in unit_dedup(df).collect()), key=str)
    assert got == sorted([(None, "", 1), (3, one, 0), (3, "", 1), (4, None, 0)], key=str)
    assert unit_dedup(df.limit(0)).collect() == []


def plain_passages(docs, words, one_in):
    """docs: (id, text), ids distinct. {id: (removed spans, text left)}."""
    lower = {c: c + 32 for c in range(65, 91)}
    found = []
    for i, text in docs:
        tok = [(m.group().translate(lower), m.start()) for m in re.finditer(r"[^ \t\n\x0b\x0c\r]+", text or "")]
        for k in range(len(tok) - words + 1):
            if hashlib.md5(tok[k][0].encode()).digest()[0] * one_in < 256:
                stop = tok[k + words][1] if k + words < len(tok) else len(text)
                found.append((i is None, i, tok[k][1], stop, tuple(w for w, _ in tok[k:k + words])))
    kept, removed = {}, {i: [] for i, _ in docs}
    for _, i, start, stop, unit in sorted(found, key=lambda u: (u[0], u[1] or 0, u[2])):
        at = kept.setdefault(unit, (i, start, stop))
        if at[:2] != (i, start) and not (at[0] == i and start < at[2]):
            removed[i].append((start, stop, at[0], at[1]))
    out = {}
    for i, text in docs:
        gone = {p for a, b, *_ in removed[i] for p in range(a, b)}
        out[i] = sorted(removed[i]), None if text is None else "".join(c for p, c in enumerate(text) if p not in gone)
    return out


@pytest.mark.parametrize("words,one_in", [(4, 2), (6, 1), (20, 8)])
def test_passages_match_plain(spark, words, one_in):
    rng = random.Random(words)
    names = [f"w{i}" for i in range(60)] + ["É", "Ab", "ab", "🙂x"]
    shared = [[rng.choice(names) for _ in range(60)] for _ in range(4)]

    def text():
        out = []
        while rng.random() < 0.8:
            out += rng.choice(shared) if rng.random() < 0.3 else [rng.choice(names) for _ in range(rng.randint(1, 60))]
        return rng.choice(["", " \n"]) + rng.choice([" ", "\n", " \t"]).join(out) + rng.choice(["", "\n", "  "])

    docs = [(i, text()) for i in range(150)] + [(200, None), (201, ""), (None, " ".join(shared[0])), (202, "a " * 300), (203, "b " * 90 + "A " * 40)]
    docs += [(300 + i, " ".join(shared[1])) for i in range(100)] + [(500, " ".join(f"x{i}" for i in range(400_000)) + " " + " ".join(shared[2]))]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    for c in ("__row", "__rank", "__text", "__spans", "__from", "__to", "removed", "digest"):
        df = df.withColumn(c, F.lit(f"own {c}"))
    rows = passage_dedup(df, words, one_in).collect()
    want = plain_passages(docs, words, one_in)
    assert len(rows) == len(docs)
    for r in rows:
        assert ([tuple(x) for x in r.removed], r.text) == want[r.doc_id]
        assert r["__row"] == "own __row" and r["__text"] == "own __text" and r["__spans"] == "own __spans" and r["digest"] == "own digest"
    assert any(x for x, _ in want.values())


def test_passages_edges(spark):
    same = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, same), (1, same), (None, same), (None, None)], "doc_id long, text string")
    rows = passage_dedup(df, words=10, one_in=1).collect()
    assert sorted(len(r.text or "") for r in rows) == [0, 0, 0, len(same)]
    assert passage_dedup(df.limit(0)).collect() == []


@pytest.mark.parametrize("names", [["__id", "__th", "__lines", "__gone"], ["__row", "__rank", "__text", "__spans", "__from", "__to"]])
def test_columns_of_any_name_survive(spark, names):
    rows = [(i, t) for i, t in enumerate(["a b c d e\nf g h i j", "x\na b c d e\nf g h i j", None, ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in names:
        df = df.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    for out in (line_dedup(df), unit_dedup(df), one_per_component(df)):
        got = out.collect()
        assert got and set(df.columns) <= set(out.columns)
        assert all(r[c] == f"{c}{r.doc_id}" for r in got for c in names)
    assert next(r.text for r in line_dedup(df).collect() if r.doc_id == 1) == "x"


def test_every_copied_passage_is_found_by_default(spark):
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(words[20 * i:20 * i + 20])) for i in range(20)]
    docs += [(100 + i, f"a{i} {text} b{i}") for i, text in docs]
    rows = {r.doc_id: r.text for r in passage_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(rows[i] == docs[i][1] and rows[100 + i] == f"a{i} b{i}" for i in range(20))


def test_query_starts_at_every_word(spark, tmp_path):
    from quarry.llm.queries import QUERIES
    words = [w for w in (f"w{i}" for i in range(200)) if hashlib.md5(w.encode()).digest()[0] >= 32][:25]
    docs = [(1, "one " + " ".join(words)), (2, "two " + " ".join(words) + " end"), (3, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in QUERIES["op7_unit_dedup"](spark, str(tmp_path)).collect()}
    assert rows[1].text == docs[0][1] and rows[1].n_removed == 0 and rows[3].text is None
    assert rows[2].text == "two end" and rows[2].n_removed == 6 and rows[2].removed.startswith("4:1:4,")


def test_kept_places_tell_digests_with_one_key_apart():
    def pack(block, *entries):      # key, check, n, rank, none, doc, start, size
        cols = dict(zip(PLACES, zip(*entries)))
        return {"range": 0, "block": block} | {c: (pack_sorted if c == "key" else pack_numbers)(np.array(v, np.uint64)) for c, v in cols.items()}

    rows = [pack(5, (7, 1, 1, 8, 0, 0, 3, 9), (7, 2, 1, 8, 0, 0, 4, 9), (9, 1, 2, 3, 0, 1, 6, 2)),
            pack(6, (7, 2, 1, 2, 0, 4, 5, 9), (8, 1, 1, 8, 0, 0, 1, 1))]
    got = {r["block"]: r for r in _kept_places(pa.Table.from_pylist(rows)).to_pylist()}
    assert set(got) == {5}
    x, _ = _unpacked(pa.array([got[5]]), KEPT)
    assert {c: v.tolist() for c, v in x.items()} == {
        "key": [7, 9], "check": [2, 1], "rank": [1, -2], "none": [0, 0], "start": [5, 6], "doc": [0, 2], "stop": [0, 8]}
