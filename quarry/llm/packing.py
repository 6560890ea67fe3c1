"""Operator 13: best-fit packing of token documents by a length-histogram plan.

``write_pieces`` encodes every whole document, appends an end id, cuts only documents longer than
a sequence (the first piece takes the odd rest, the others are full) and writes one row per piece
with its ids. ``plan_slots`` packs the histogram of piece lengths, not the pieces: best fit by
falling length, where a group of equally filled sequences takes its share of equally long pieces in
one step. ``place`` numbers the pieces of each length over the whole table and joins every piece
with the planned slot of its (length, rank).

The plan is as large as the histogram allows, which the sequence size bounds (2048 lengths), not
the data: the driver sees one counter per length, and every task gets the same short plan.

Defined results: a null text is empty (its only id is the end id); a null ``doc_id`` is kept, and so
are repeated rows, each as a document of its own; an empty table gives no rows; columns of ``docs``
other than the two named ones are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.byte_bpe import batch_encoder
from quarry.llm.common import arrow_slices, fresh_path

PIECE_SCHEMA = "doc_id long, piece int, start long, length int, ids binary, part int, nth long"


def _pieces(path: str, end_id: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = batch_encoder(path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)         # pieces of each length before this slice
        for batch in batches:
            names, column = batch.column(0), batch.column(1)
            for a, b in arrow_slices(column):
                ids, rows = enc.encode(column.slice(a, b - a))
                ids = np.insert(ids, rows[1:], end_id).astype("<i4")
                n = np.diff(rows) + 1
                pieces = -(-n // size)
                doc = np.repeat(np.arange(b - a), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                odd = (n - size * (pieces - 1))[doc]
                length = np.where(piece == 0, odd, size)
                start = np.where(piece == 0, 0, odd + size * (piece - 1))
                order = np.argsort(length, kind="stable")
                counts = np.bincount(length, minlength=size + 1)
                nth = np.empty(len(doc), np.int64)
                nth[order] = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
                nth += seen[length]
                seen += counts
                at = np.concatenate([[0], 4 * np.cumsum(length)]).astype(np.int64)
                data = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(at), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [names.slice(a, b - a).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start),
                     pa.array(length.astype(np.int32)), data.cast(pa.binary()),
                     pa.array(np.full(len(doc), part, np.int32)), pa.array(nth)],
                    names=["doc_id", "piece", "start", "length", "ids", "part", "nth"])
    return run


def write_pieces(docs: DataFrame, path: str, tokenizer_path: str, size: int = 2048, end_id: int = 0,
                 doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, cut and write the pieces; ``ids`` are little-endian unsigned 32-bit integers.

    ``part`` and ``nth`` are the task that wrote a piece and the number of earlier pieces of its
    length there. They are read back from the written rows, so a task that runs again cannot
    change the numbering under later steps.
    """
    src = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    src.mapInArrow(_pieces(tokenizer_path, end_id, size), PIECE_SCHEMA) \
        .write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(PIECE_SCHEMA).parquet(path)


def plan_slots(histogram: dict[int, int], size: int) -> pd.DataFrame:
    """Best fit by falling length over counts.

    Sequences with the same room left form groups of consecutive numbers. The pieces of one length
    fill the tightest groups first: each sequence takes as many as fit, as it stays the tightest
    once chosen; what is left over opens new sequences. A row of the plan: ``length``, ``rank`` (of
    its first piece among those of the length), ``sequence`` (of its first piece), ``offset`` there,
    ``each`` (pieces a sequence takes).
    """
    plan: list[tuple[int, int, int, int, int]] = []
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]      # room -> (first sequence, how many)
    used = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def fill(first: int, n: int, room: int, length: int = length) -> int:
            """Sequences of a group that took pieces; the rest of the group keeps its room."""
            nonlocal left, rank
            each = room // length
            full = min(n, left // each)
            if full:
                plan.append((length, rank, first, size - room, each))
                rooms[room - each * length].append((first, full))
                left, rank = left - full * each, rank + full * each
            if full < n and left:
                plan.append((length, rank, first + full, size - room, left))
                rooms[room - left * length].append((first + full, 1))
                full, left, rank = full + 1, 0, rank + left
            return full

        for room in range(length, size + 1):
            if not left:
                break
            groups, rooms[room] = rooms[room], []
            for first, n in groups:
                took = fill(first, n, room) if left else 0
                if took < n:
                    rooms[room].append((first + took, n - took))
        if left:
            fresh = -(-left // (size // length))
            fill(used, fresh, size)
            used += fresh
    return pd.DataFrame(plan, columns=["length", "rank", "sequence", "offset", "each"]).sort_values(["length", "rank"])


def _slot_of(plan: pd.DataFrame):
    length, rank, sequence, offset, each = (plan[c].to_numpy(np.int64) for c in plan.columns)
    # ranks of a length are below 2^50, so one number orders (length, rank)
    keys = (length << 50) + rank

    @F.pandas_udf("sequence_id long, offset long")
    def slot(n: pd.Series, r: pd.Series) -> pd.DataFrame:
        n, r = n.to_numpy(np.int64), r.to_numpy(np.int64)
        at = np.searchsorted(keys, (n << 50) + r, side="right") - 1
        t = r - rank[at]
        return pd.DataFrame({"sequence_id": sequence[at] + t // each[at], "offset": offset[at] + t % each[at] * n})
    return slot


def place(pieces: DataFrame, size: int = 2048, columns: Sequence[str | Column] = ()) -> DataFrame:
    """Every piece of ``write_pieces`` with its ``sequence_id`` and its ``offset`` there.

    ``columns`` are further columns of the pieces, or expressions over them; they are computed
    before the join, so that ids do not travel unless asked for.
    """
    per_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = per_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = ["doc_id", "piece", "start", "length"]
    ranked = pieces.select(*own, "part", "nth", *columns).join(before, ["part", "length"])
    more = [c for c in ranked.columns if c not in (*own, "part", "nth", "before")]
    slot = _slot_of(plan_slots(histogram, size))(F.col("length"), F.col("before") + F.col("nth"))
    return ranked.withColumn("slot", slot).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"),
                                                  *more, "slot.sequence_id", "slot.offset")


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0,
         columns: Sequence[str | Column] = ("ids",), **names: str) -> DataFrame:
    """doc_id, piece, start, length, ``columns``, sequence_id and offset of every piece."""
    path = fresh_path(docs.sparkSession, "pieces")
    return place(write_pieces(docs, path, tokenizer_path, size, end_id, **names), size, columns)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id and the ids of each whole sequence; a group holds at most one sequence's ids."""
    parts = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))").alias("ids"))
