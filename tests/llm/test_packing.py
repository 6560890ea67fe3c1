"""Best-fit packing (13) against the tokenizers library and a packer that places piece by piece."""

import random
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm.byte_bpe import BatchEncoder
from quarry.llm.packing import pack, plan_slots, sequences

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return t


def strings(seed, n, alphabet, most):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_batch_encoder_is_the_library(library):
    odd = list("a bX  \n\n\t\r\x0b\x1c\x00\x85  　  é,.'s1 2<|>語🙂") + ["<|endoftext|>", "the ", "'ll ", " \n", "\nß"]
    texts = [*strings(1, 6000, odd, 14), "x" * 100_000, " " * 3000 + "a", "\n" * 999 + "b", "", " ", "\n", " a", "a "]
    for entries in (10, 10 ** 6):
        enc = BatchEncoder(BPE, entries)
        for a in range(0, len(texts), 700):
            part = [None, *texts[a:a + 700]]
            for column in (pa.array(part), pa.array(["zz", *part], pa.large_string()).slice(1)):
                ids, rows = enc.encode(column)
                assert rows[0] == rows[1] == 0 and rows[-1] == len(ids)
                for x, i, j in zip(part[1:], rows[1:-1], rows[2:], strict=True):
                    assert ids[i:j].tolist() == library.encode(x, add_special_tokens=False).ids, repr(x)
    assert BatchEncoder(BPE).encode(pa.array([], pa.string()))[1].tolist() == [0]


def one_by_one(lengths, size):
    """Sequences that best fit by falling length needs, placing each piece by itself."""
    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect_left(rooms, x)
        if i == len(rooms):
            n, room = n + 1, size
        else:
            room = rooms.pop(i)
        insort(rooms, room - x)
    return n


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    size = rng.choice([1, 2, 7, 10, 64, 300])
    most = rng.randint(1, size)
    hist = {x: rng.choice([1, 2, 5, 100, 1000]) for x in rng.sample(range(1, most + 1), rng.randint(1, most))}
    plan = plan_slots(hist, size)
    slots, filled = {}, Counter()
    for n, rows in plan.groupby("length"):
        ends = [*rows["rank"][1:], hist[n]]
        assert rows["rank"].iloc[0] == 0
        for r, end in zip(rows.itertuples(), ends):
            for t in range(end - r.rank):
                key = (r.sequence + t // r.each, r.offset + t % r.each * n)
                assert key not in slots
                slots[key] = n
    for (s, at), n in sorted(slots.items()):
        assert at == filled[s]
        filled[s] += n
    assert max(filled.values()) <= size and Counter(slots.values()) == Counter(hist)
    lengths = [x for x, n in hist.items() for _ in range(n)]
    assert len(filled) == one_by_one(lengths, size)
    assert sorted(filled) == list(range(len(filled)))


def test_plan_size_does_not_follow_the_counts():
    hist = {x: 1 + x * 7919 % 1000 for x in range(1, 2049)}
    small = len(plan_slots(hist, 2048))
    assert len(plan_slots({x: n * 10 ** 9 for x, n in hist.items()}, 2048)) < 3 * small < 60_000


def check(library, docs, rows, size):
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, []).append(r)
    for i, x in docs:
        ids = library.encode(x or "", add_special_tokens=False).ids + [0]
        mine = sorted(of[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(-(-len(ids) // size)))
        at = 0
        for r in mine:
            assert r.start == at and (r.length == size or r.piece == 0)
            assert bytes(r.ids) == np.array(ids[at:at + r.length], "<u4").tobytes()
            assert r.crc == zlib.crc32(bytes(r.ids))
            at += r.length
        assert at == len(ids)
    at = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= size and len(at) == one_by_one([r.length for r in rows], size)


@pytest.mark.parametrize("parts", [1, 7])
def test_pack(spark, library, parts):
    docs = [(i, x) for i, x in enumerate(strings(3, 400, list("the quick\n bröwn.  "), 300))]
    docs += [(1000, None), (1001, ""), (1002, "word " * 30_000), (-5, "ab " * 63), (-6, "y" * 5_000)]
    docs += [(2000 + i, "one hot text") for i in range(500)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts) \
        .withColumns({c: F.lit("clash") for c in ("ids", "part", "nth", "length", "slot", "before", "sequence_id")})
    out = pack(df, BPE, size=64, columns=["ids", F.crc32("ids").alias("crc")])
    rows = out.collect()
    check(library, docs, rows, 64)
    whole = {r.sequence_id: bytes(r.ids) for r in sequences(out).collect()}
    for r in rows:
        assert whole[r.sequence_id][4 * r.offset:4 * (r.offset + r.length)] == bytes(r.ids)


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b"), (None, "a b"), (1, "a b"), (1, "c"), (None, None)]
    out = pack(spark.createDataFrame(rows, "doc_id long, text string"), BPE, size=8).collect()
    assert sorted((r.doc_id or 0, r.length) for r in out) == [(0, 1), (0, 3), (0, 3), (1, 2), (1, 3)]
    assert len({(r.sequence_id, r.offset) for r in out}) == 5 and len({r.sequence_id for r in out}) == 2
    empty = pack(spark.createDataFrame([], "doc_id long, text string"), BPE)
    assert empty.count() == 0 and sequences(empty).count() == 0


def test_query(spark, library):
    from quarry.llm.queries import QUERIES
    from quarry.sources.tables import load
    sf = "/root/testdata/sf0.001"
    rows = QUERIES["op13_best_fit_packing"](spark, sf).collect()
    docs = [(r.doc_id, r.text) for r in load(spark, sf, "documents").select("doc_id", "text").collect()]
    lengths = []
    by = {(r.doc_id, r.piece): r for r in rows}
    for i, x in docs:
        ids, at, piece = library.encode(x or "", add_special_tokens=False).ids + [0], 0, 0
        while at < len(ids):
            r = by.pop((i, piece))
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes()))
            lengths.append(r.length)
            at, piece = at + r.length, piece + 1
    assert not by and len({r.sequence_id for r in rows}) == one_by_one(lengths, 2048)
