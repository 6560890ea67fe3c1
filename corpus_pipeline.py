"""Corpus pipeline: STAGES applied in order to ``documents``, each written as Parquet and read
again as the next stage's input.

Quality classifier, line dedup, SimHash near-dedup, benchmark decontamination, SentencePiece
encoding. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import free_names, materialize
from quarry.llm.decontaminate import contamination
from quarry.llm.line_runs import line_dedup
from quarry.llm.quality_mil import fit, held_out, score
from quarry.llm.queries import tokenizer_file
from quarry.llm.sentencepiece_codec import encode
from quarry.llm.simhash import one_per_component
from quarry.sources.tables import load


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5 go."""
    labels = load(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))).select("doc_id", "quality")
    model = fit(docs, labels, "quality")
    name, = free_names(docs.columns, "score")
    return score(docs, model, keep=tuple(docs.columns), score_col=name).filter(F.col(name) >= 0.5).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of two or more lines, and of single lines of 50 or more words, are deleted
    from the texts; no document goes."""
    return line_dedup(docs, min_lines=2, line_words=50).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate rows the one with the smallest id (null is last) stays, once."""
    return one_per_component(docs, k=3, distance=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold ten consecutive words of a benchmark item go; other rows of their id stay."""
    # the text alone decides, so its hash names the rows
    th, = free_names(docs.columns, "th")
    keyed = docs.withColumn(th, F.xxhash64("text"))
    found = contamination(keyed, load(spark, sf_dir, "benchmark"), window=10, doc_col=th)
    bad = found.filter("contaminated").select(F.col("doc_id").alias(th)).distinct()
    return keyed.join(bad, th, "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the SentencePiece ids of every whole text."""
    ids = encode(docs, tokenizer_file("piece_bpe_32k.model"), keep=("doc_id",))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality classifier", quality), ("line dedup", lines), ("SimHash near-dedup", near_dups),
          ("benchmark decontamination", decontaminate), ("SentencePiece encoding", tokens)]

# The classifier, SimHash and the tokenizer cannot be written in SQL; tests/llm compare the stages
# with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{n}")
    return docs
