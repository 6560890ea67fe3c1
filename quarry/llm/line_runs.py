"""Operator 2: line dedup over a suffix array of line sequences, in DataFrame operations only.

A document is the sequence of its lines that are not blank. The suffixes of all sequences are
ranked by their first 2^t lines, by distributed prefix doubling: the rank of twice as many lines
comes from the pair (rank here, rank 2^t lines on). Ranks keep the order of the suffixes and come
from prefix sums over range partitions of the distinct pairs, so one frequent line is one row
there. Suffixes that share their first ``min_lines`` lines form one interval of the suffix array
with a longest common prefix of at least ``min_lines``; the doubling ends when the prefix covers
that many lines (two overlapping ranks cover a length that is no power of two), and suffixes whose
prefix is unique are dropped on the way. Of every interval the earliest suffix (by document id,
then text hash, then line) is kept; neighbouring later copies of neighbouring earlier lines merge
into the maximal repeated runs, whose lines are deleted.

Defined results: a null text stays null; an empty text stays empty; blank lines (ASCII white space
only) belong to no run and are never deleted; a document whose lines are all deleted keeps its row
with the blank lines or an empty text; rows that repeat both id and text count as one document
and get the same result; rows that repeat an id with another text are documents of their own; a
null id sorts first; an empty table gives no rows; columns of any name are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import free_names, materialize
from quarry.plans.prefix import running_sums

# Line ids are two 64-bit hashes of the line.
_KEY = ["id", "th"]
_NO_ID = -(1 << 63)


def _key(doc_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(F.col(doc_col).cast("long"), F.lit(_NO_ID)).alias("id"),
            F.xxhash64(F.col(text_col).cast("string")).alias("th")]


def line_sequences(docs: DataFrame, doc_col: str, text_col: str, count_words: bool = False) -> DataFrame:
    """(id, th, pos, line_no, h1, h2): one row per line that is not blank; pos counts those.
    ``count_words`` adds n_words, the line's runs of characters that are not white space."""
    n_words = [F.size(F.filter(F.split("s.line", "[ \\t\\r\\f\\x0B]+"), lambda w: w != "")).alias("n_words")] if count_words else []
    lines = F.filter(
        F.transform(F.split(F.col(text_col).cast("string"), "\n", -1),
                    lambda x, i: F.struct(i.alias("line_no"), x.alias("line"))),
        lambda s: s["line"].rlike("[^ \\t\\r\\f\\x0B]"))
    rows = docs.select(*_key(doc_col, text_col), F.posexplode(lines).alias("pos", "s")).select(
        *_KEY, "pos", F.col("s.line_no").alias("line_no"), F.xxhash64("s.line").alias("h1"),
        F.xxhash64(F.lit(1), F.col("s.line")).alias("h2"), *n_words)
    # rows that repeat id and text say the same
    return rows.dropDuplicates([*_KEY, "pos"])


def rank_pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``rows`` whose pair (a, b) is not unique, with ``rank``: one more than the number of such
    rows with a smaller pair."""
    pairs = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    ranks = running_sums(pairs, [a, b], {"upto": "size"}).select(a, b, (F.col("upto") - F.col("size") + 1).alias("__rank"))
    return rows.join(ranks, [a, b]).select(*[c for c in rows.columns if c not in (a, b)], F.col("__rank").alias("rank"))


def doubled(rows: DataFrame, by: int) -> DataFrame:
    """Each row with the rank ``by`` lines on as ``next``; windows that leave the document or
    reach a line that is not repeated are left out."""
    on = rows.select(*_KEY, (F.col("pos") - by).alias("pos"), F.col("rank").alias("next"))
    return rows.join(on, [*_KEY, "pos"])


def suffix_ranks(docs: DataFrame, min_lines: int, doc_col: str, text_col: str,
                 count_words: bool = False) -> tuple[DataFrame, DataFrame]:
    """(repeated lines, suffixes that share their first ``min_lines`` lines with another), the
    latter with the rank that names their interval."""
    lines = materialize(rank_pairs(line_sequences(docs, doc_col, text_col, count_words), "h1", "h2"), "lines-1")
    ranks = lines.drop("n_words")
    covered = 1
    while covered < min_lines:
        step = min(covered, min_lines - covered)
        ranks = materialize(rank_pairs(doubled(ranks, step), "rank", "next"), f"lines-{covered + step}")
        covered += step
    return lines, ranks


def later_long_lines(lines: DataFrame, line_words: int) -> DataFrame:
    """(id, th, pos) of repeated lines of at least ``line_words`` words but for each one's earliest copy."""
    place = F.struct(*_KEY, "pos")
    long = lines.filter(F.col("n_words") >= line_words)
    # written, so that the join below is between two plain inputs and Spark can split a hot line
    first = materialize(long.groupBy("rank").agg(F.min(place).alias("first")), "lines-long")
    return long.join(first, "rank").filter(place > F.col("first")).select(*_KEY, "pos")


def repeated_runs(docs: DataFrame, min_lines: int = 2, doc_col: str = "doc_id", text_col: str = "text",
                  count_words: bool = False) -> tuple[DataFrame, DataFrame]:
    """(repeated lines, maximal runs). A run is a later copy: id, th, pos, n_lines, and where its
    earliest copy starts (first_id, first_th, first_pos). ``count_words``: the lines have n_words."""
    lines, suffixes = suffix_ranks(docs, min_lines, doc_col, text_col, count_words)
    place = F.struct(*_KEY, "pos")
    # written, so that the join below is between two plain inputs and Spark can split a hot interval
    first = materialize(suffixes.groupBy("rank").agg(F.min(place).alias("first")), "lines-first")
    later = suffixes.join(first, "rank").filter(place > F.col("first")).select(
        *_KEY, "pos", F.col("first.id").alias("first_id"), F.col("first.th").alias("first_th"),
        (F.col("pos") - F.col("first.pos")).alias("shift"))
    # neighbours of one document that copy neighbours of one other: bounded by the document
    same = [*_KEY, "first_id", "first_th", "shift"]
    runs = later.withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy(*same).orderBy("pos"))) \
        .groupBy(*same, "island").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n"))
    return lines, runs.select(*_KEY, "pos", (F.col("n") + min_lines - 1).alias("n_lines"), "first_id", "first_th",
                              (F.col("pos") - F.col("shift")).alias("first_pos"))


def line_dedup(docs: DataFrame, min_lines: int = 2, doc_col: str = "doc_id", text_col: str = "text",
               counts: tuple[str, str] | None = None, line_words: int | None = None) -> DataFrame:
    """``docs`` with the lines of later copies deleted from ``text_col``; ``counts`` names columns
    for the number of lines and of deleted lines. With ``line_words``, a later copy of one line of
    at least so many words is deleted too, whatever its neighbours are."""
    lines, runs = repeated_runs(docs, min_lines, doc_col, text_col, line_words is not None)
    gone = runs.select(*_KEY, F.explode(F.sequence(F.col("pos"), (F.col("pos") + F.col("n_lines") - 1).cast("int")))
                       .alias("pos"))
    if line_words is not None:
        gone = gone.unionByName(later_long_lines(lines, line_words))
    gone = gone.distinct()
    names = [*docs.columns, *(counts or ())]
    id_, th, split, cut = free_names(names, "id", "th", "lines", "gone")
    removed = gone.join(lines.select(*_KEY, "pos", "line_no"), [*_KEY, "pos"]) \
        .groupBy(*_KEY).agg(F.collect_list("line_no").alias(cut)).withColumnsRenamed({"id": id_, "th": th})
    key = [c.alias(n) for c, n in zip(_key(doc_col, text_col), (id_, th))]
    own = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    parts = docs.select(*own, *key, F.split(F.col(text_col).cast("string"), "\n", -1).alias(split))
    joined = parts.join(removed, [id_, th], "left")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(cut)), lambda i: F.get(F.col(split), i))
    text = F.array_join(F.when(F.col(cut).isNull(), F.col(split)).otherwise(left), "\n")
    extra = [] if counts is None else [
        F.when(F.col(split).isNull(), 0).otherwise(F.size(split)).cast("long").alias(counts[0]),
        F.coalesce(F.size(cut), F.lit(0)).cast("long").alias(counts[1])]
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], *extra)
