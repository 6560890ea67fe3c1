"""Chat examples (1), the pipeline, and the queries' SQL twins."""

import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import chat_examples, quality_mil, queries
from quarry.llm.common import materialize
from quarry.sources.tables import load
from tests.llm import plain
from tests.oracle_check import TABLES, close, rows_key

SCHEMA = "conv_id long, turn long, role string, text string"
SF = "/root/testdata/sf0.001"


def conversations(seed):
    rng = random.Random(seed)
    parts = ["hello ", "<|im_end|>", "\n", "&lt;|", "&amp;", "<|im_start|>assistant\n", "é<", "|>", "&", "語"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a\nb", "<|x|>&#10;"]),
             rng.choice([None, "", "".join(rng.choice(parts) for _ in range(6))]))
            for c in range(12) for t in range(rng.randint(1, 9))]
    rows += [(99, t, ["user", "assistant"][t % 2], f"turn {t} <|im_end|>") for t in range(700)]
    return rows + [(None, None, "assistant", "x"), (None, 1, "user", "y"), rows[0], rows[0]]


def order(r):
    return (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")


def test_digests_match_plain(spark):
    rows = conversations(1)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"segment": F.lit(1), "block": F.lit("x")}).repartition(7)
    got = {r.conv_id: r for r in chat_examples.digests(materialize(chat_examples.format_turns(df), "t")).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort(key=order)
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (
            len(turns), plain.sha(text), len(loss), plain.sha(loss))


def test_each_reply_is_an_example(spark):
    rows = conversations(2)
    formatted = materialize(chat_examples.format_turns(spark.createDataFrame(rows, SCHEMA)), "t")
    chosen = chat_examples.examples(formatted).filter("conv_id < 12 or target in (1, 699)")
    got = {(r.conv_id, r.target): r for r in chat_examples.render_examples(formatted, chosen).collect()}
    esc = lambda s: (s or "").replace("&", "&amp;").replace("<|", "&lt;|")
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    n = 0
    for c, turns in groups.items():
        turns.sort(key=order)
        segs = ["<|im_start|>" + esc(r[2]).replace("\n", "&#10;") + "\n" + esc(r[3]) + "<|im_end|>\n" for r in turns]
        for i, r in enumerate(turns):
            if r[2] == "assistant" and (c, i) in got:
                x = got[c, i]
                assert x.text == "".join(segs[:i + 1])[:-len("<|im_end|>\n")]
                assert x.text[x.loss_from:x.loss_to] == esc(r[3]) and x.loss_to == len(x.text)
                n += 1
    assert n == len(got) > 5


def test_a_lost_or_doubled_example_shows(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "bb"), (1, 2, "user", "c"), (1, 3, "assistant", "dd"), (None, 0, "assistant", "x")]
    formatted = materialize(chat_examples.format_turns(spark.createDataFrame(rows, SCHEMA)), "t")
    every = chat_examples.examples(formatted)
    read = lambda e: {r.conv_id: (r.n_turns, r.loss_chars, r.n_examples, r.loss_sha256) for r in chat_examples.digests(formatted, e).collect()}
    whole = read(every)
    assert whole[1][:3] == (4, 4, 2) and whole[None][:3] == (1, 1, 1)
    lost, doubled = read(every.filter("not (conv_id <=> 1 and target = 1)")), read(every.unionByName(every.filter("target = 3")))
    assert lost[1][:3] == (4, 2, 1) and doubled[1][:3] == (4, 6, 3) and lost[None] == doubled[None] == whole[None]
    assert len({lost[1][3], doubled[1][3], whole[1][3]}) == 3


def test_chat_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert chat_examples.digests(chat_examples.format_turns(df)).collect() == []


def test_pipeline_matches_plain(spark):
    docs = {r.doc_id: r for r in load(spark, SF, "documents").collect()}
    got, frame = [], load(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        frame = materialize(stage(spark, frame, SF), "test-stage")
        got.append({r.doc_id: r for r in frame.collect()})
    # 1: the classifier's own scores, one document at a time
    labels = load(spark, SF, "labels").filter(~quality_mil.held_out(F.col("doc_id"))).select("doc_id", "quality")
    model = quality_mil.fit(load(spark, SF, "documents"), labels)
    keep = {i: r.text for i, r in docs.items() if model.score(quality_mil.bag(r.text), np.array([0]))[0] >= 0.5}
    assert {i: r.text for i, r in got[0].items()} == keep
    # 2
    keep = plain.line_runs(list(keep.items()), 2, 50)
    assert {i: r.text for i, r in got[1].items()} == keep and all(r.n_chars == len(keep[i]) for i, r in got[1].items())
    # 3
    fp = {i: plain.simhash(t) for i, t in keep.items()}
    groups = plain.clusters(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    keep = {i: t for i, t in keep.items() if groups[i] == i}
    assert {i: r.text for i, r in got[2].items()} == keep
    # 4
    items = [(r.item_id, r.text) for r in load(spark, SF, "benchmark").collect()]
    keep = {i: keep[i] for i, _, hit, _ in plain.contamination(list(keep.items()), items, 10) if not hit}
    assert {i: r.text for i, r in got[3].items()} == keep
    assert set(got[3]) < set(got[2]) < set(got[1]) == set(got[0]) < set(docs)
    # 5
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {i: list(r.ids) for i, r in got[4].items()} == {i: sp.encode(t) for i, t in keep.items()}
    for g in got[:4]:
        assert all(r.asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"} for r in g.values())


def test_pipeline_stages_on_odd_rows(spark):
    schema = load(spark, SF, "documents").schema
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "long words " * 20000, "xx", None, 5)]
    for _, stage in corpus_pipeline.STAGES:
        for frame in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
            out = stage(spark, frame.withColumns({"row": F.lit("x"), "part": F.lit(1)}), SF).collect()
            assert len(out) <= (len(rows) if frame.count() else 0)


def test_near_dups_and_decontamination_judge_rows(spark):
    rng = random.Random(5)
    word = lambda: f"{rng.choice('bcdfg')}{rng.randint(0, 9999)}"
    a, b, c, d, e = ([word() for _ in range(300)] for _ in range(5))
    near = lambda w: next(t for t in (" ".join([*w[:i], "changed", *w[i + 1:]]) for i in range(300))
                          if (plain.simhash(t) ^ plain.simhash(" ".join(w))).bit_count() <= 3)
    a, b, c, d, e, like_b, like_e = *map(" ".join, (a, b, c, d, e)), near(b), near(e)
    rows = [(3, like_b), (5, a), (5, b), (None, c), (None, d), (None, e), (None, like_e), (7, c), (8, a), (8, a)]
    schema = load(spark, SF, "documents").schema
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema).repartition(3)
    out = [(r.doc_id, r.text) for r in corpus_pipeline.near_dups(spark, frame, SF).collect()]
    of_e = [x for x in out if x in ((None, e), (None, like_e))]
    assert len(of_e) == 1 and sorted(map(str, set(out) - set(of_e))) == sorted(map(str, [(3, like_b), (5, a), (None, d), (7, c)]))
    assert len(out) == 5
    leak = a + " " + load(spark, SF, "benchmark").filter("text is not null").orderBy("item_id").first().text
    rows = [(None, leak), (None, c), (None, d), (5, leak), (5, b), (None, None)]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], schema)
    out = [(r.doc_id, r.text) for r in corpus_pipeline.decontaminate(spark, frame, SF).collect()]
    assert sorted(map(str, out)) == sorted(map(str, [(None, c), (None, d), (5, b), (None, None)]))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_twins(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(queries.ORACLE[name])
    cols, want = [d[0] for d in cur.description], cur.fetchall()
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert close(rows_key(df.collect(), df.columns), rows_key(want, cols)) and want
