"""Token files (4) and SentencePiece (9) against the libraries."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm.common import fresh_path
from quarry.llm.sentencepiece_codec import Codec, Lattice, Pieces, decode, encode
from quarry.llm.token_files import CachedEncoder, find_documents, read_token_files, token_digests, write_token_files

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"


def strings(seed, n, alphabet, most=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_cached_encoder_is_the_library():
    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    texts = strings(1, 4000, list("a bX  \n\t\x1c\x85  é,.'s1 2<|>\r語🙂") + ["<|endoftext|>", "the ", "'ll "], 14)
    for entries in (10, 10 ** 6):
        enc = CachedEncoder(BPE, entries)
        for a in range(0, len(texts), 500):
            got = enc.encode_bytes([None, *texts[a:a + 500]])
            assert got[0] == b""
            for x, ids in zip(texts[a:a + 500], got[1:]):
                assert np.frombuffer(ids, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_token_files_round_trip(spark):
    t = Tokenizer.from_file(BPE)
    docs = [(i, x) for i, x in enumerate(strings(2, 300, list("the quick\n bröwn.  "), 200))]
    docs += [(1000, None), (1001, ""), (-5, "word " * 30000)]
    random.Random(0).shuffle(docs)
    df = spark.createDataFrame(docs, SCHEMA).withColumns({"ids": F.lit("clash"), "part": F.lit(0)})
    path = fresh_path(spark, "test-tokens")
    write_token_files(df, path, BPE, end_id=2)
    got = token_digests(read_token_files(spark, path)).orderBy("doc_id").collect()
    at = 0
    for r, (i, x) in zip(got, sorted(docs), strict=True):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        assert tuple(r) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    found = find_documents(spark, path, [1000, -5]).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_tokens == len(r.ids)) for r in found] == [(-5, True), (1000, True)] and found[1].ids == [2]
    # the id filter reaches the files
    plan = spark.read.orc(path).filter("doc_id = 1000")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,1000)]" in plan


def test_token_files_edges(spark):
    path = fresh_path(spark, "test-tokens")
    write_token_files(spark.createDataFrame([(None, "b"), (1, "a"), (1, "a"), (1, "c")], SCHEMA), path, BPE)
    rows = token_digests(read_token_files(spark, path)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 1, 1] and [r.start for r in rows] == [0, 2, 4, 6]
    path = fresh_path(spark, "test-tokens")
    write_token_files(spark.createDataFrame([], SCHEMA), path, BPE)
    assert token_digests(read_token_files(spark, path)).collect() == []


def test_codec_is_the_library():
    c, sp = Codec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = strings(3, 3000, list("abcdethionsr  \n\té,.'s1 2<>xÀ梦🙂한0\x00") + ["tion", "the ", "<s>", "<0x0A>"], 40)
    texts += ["a" + " " * n + "b" for n in range(70)] + [" " * n for n in range(70)]
    texts += ["".join(random.Random(4).choice("etaoinshr") for _ in range(5000)), "é" * 3000]
    for x in texts:
        ids = np.frombuffer(c.encode_bytes(x), "<i4").tolist()
        assert ids == sp.encode(x), repr(x)
        assert c.decode(ids) == x


def test_streaming_window_is_bounded():
    pieces, _ = Pieces.load(PIECES)
    lattice, ids, widest = Lattice(pieces), [], 0
    text = "".join(random.Random(5).choice("etaoinshr ") for _ in range(4000)).replace(" ", "▁")
    for c in text:
        ids += lattice.push(c)
        widest = max(widest, len(lattice.text))
    whole = Lattice(pieces)
    assert ids + lattice.finish() == whole.push(text) + whole.finish()
    assert widest <= 8 * pieces.longest


@pytest.mark.parametrize("seed", range(4))
def test_unigram_is_the_best_of_all_segmentations(seed):
    rng = random.Random(seed)
    vocab = {"".join(p): (i, -rng.random() * 5) for i, p in enumerate(
        p for n in (1, 2, 3) for p in itertools.product("ab", repeat=n) if n == 1 or rng.random() < 0.6)}
    pieces = Pieces(vocab, [], bpe=False)
    names = {i: p for p, (i, _) in vocab.items()}
    for _ in range(30):
        s = "".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))
        best = max(sum(vocab[p][1] for p in cut) for cut in segmentations(s) if all(p in vocab for p in cut))
        lattice = Lattice(pieces)
        ids = lattice.push(s) + lattice.finish()
        assert "".join(names[i] for i in ids) == s
        assert abs(sum(vocab[names[i]][1] for i in ids) - best) < 1e-9


def segmentations(s):
    if not s:
        yield []
    for n in range(1, len(s) + 1):
        for rest in segmentations(s[n:]):
            yield [s[:n], *rest]


def test_encode_decode_frames(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = [(1, None), (2, ""), (2, "two  words "), (None, "x" * 50000), (4, "é\n")]
    df = spark.createDataFrame(docs, SCHEMA).withColumns({"ids": F.lit("clash"), "__x": F.lit(1)})
    ids = encode(df, PIECES, keep=("doc_id", "__x"))
    rows = decode(ids, PIECES, keep=("doc_id", "__x", "ids")).collect()
    assert sorted(((r.doc_id, r.text, list(r.ids)) for r in rows), key=str) == sorted(
        ((i, t or "", sp.encode(t or "")) for i, t in docs), key=str)
    assert encode(df.limit(0), PIECES).collect() == []
    odd = spark.createDataFrame([(1, None), (2, [1, 2, 99999, -1]), (3, [3 + 0xC3])], "doc_id long, ids array<int>")
    assert [r.text for r in decode(odd, PIECES).orderBy("doc_id").collect()] == ["", "", "�"]
