"""Operator 4: token ids in ORC files.

``write_token_files`` encodes whole documents, appends an end id to each and writes the ids
in ascending document order as ORC: integer run-length encoding (ORC's RLE v2) for ids and
offsets, row indexes and a Bloom filter on ``doc_id``. Readers split the files by stripe and
skip stripes and row groups by the min/max and Bloom data (``find_documents``).

Columns of a file: ``doc_id``, ``part`` (range partition, ascending with doc_id), ``start_in_part``
(ids of the earlier documents of the part), ``n_tokens``, ``ids``.

Defined results: a null text counts as empty (its ids are the end id alone); a null ``doc_id``
sorts first; rows with the same ``doc_id`` are all kept, ordered by a hash of the text; an empty table gives
files without rows; columns other than the two named ones are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.byte_bpe import BatchEncoder, batch_encoder
from quarry.llm.common import arrow_slices

FILE_SCHEMA = "doc_id long, part int, start_in_part long, n_tokens int, ids array<int>"


class CachedEncoder(BatchEncoder):
    """``BatchEncoder`` for lists of texts."""

    def encode_bytes(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ids, rows = self.encode(pa.array(texts, pa.string()))
        data = ids.astype("<u4").tobytes()
        return [data[4 * a:4 * b] for a, b in zip(rows[:-1].tolist(), rows[1:].tolist())]


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = batch_encoder(path)
        part = TaskContext.get().partitionId()
        before = 0
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for a, b in arrow_slices(column):
                flat, rows = enc.encode(column.slice(a, b - a))
                flat = np.insert(flat, rows[1:], end_id).astype(np.int32)
                ends = rows[1:] + np.arange(1, b - a + 1)
                sizes = np.diff(ends, prepend=0)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(np.full(b - a, part, np.int32)),
                     pa.array(before + ends - sizes), pa.array(sizes.astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat))],
                    names=["doc_id", "part", "start_in_part", "n_tokens", "ids"])
                before += int(ends[-1])
    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2,
                      doc_col: str = "doc_id", text_col: str = "text", fpp: float = 0.01) -> None:
    """Encode ``docs`` and write the ORC files under ``path``.

    The texts, not the wider ids, are range-shuffled by document id and encoded after the sort,
    so ids are written as they are made. Repeated ids spread by the text's hash (the text itself
    as a sort key would send sampled texts to the driver).
    """
    src = docs.select(F.col(doc_col).cast("long").alias("doc_id"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = src.withColumn("th", F.xxhash64("text")).repartitionByRange("doc_id", "th") \
        .sortWithinPartitions("doc_id", "th").select("doc_id", "text")
    (ordered.mapInArrow(_encode(tokenizer_path, end_id), FILE_SCHEMA)
     .write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", str(fpp))
     .option("orc.create.index", "true").option("orc.row.index.stride", "1000")
     .option("orc.stripe.size", str(16 << 20)).option("compression", "zstd").orc(path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the files with ``start``, the number of ids of all documents before a row's."""
    files = spark.read.schema(FILE_SCHEMA).orc(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row per written range partition
    before = totals.select("part", F.expr(
        "coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0)").alias("before"))
    return files.join(F.broadcast(before), "part").select(
        "doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def find_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of the given documents; stripes and row groups without them are skipped."""
    return spark.read.schema(FILE_SCHEMA).orc(path).filter(F.col("doc_id").isin([int(x) for x in doc_ids])) \
        .select("doc_id", "n_tokens", "ids")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        offsets = lists.offsets.to_numpy()
        values = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
        crc = [zlib.crc32(values[4 * a:4 * b]) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the ids as little-endian 32-bit integers."""
    return rows.select("doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"), "ids") \
        .mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
