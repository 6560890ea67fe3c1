"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quarry.session import ensure_checkpoint_dir, shared_path

# Python works on slices of an Arrow batch with at most so many bytes of text (one longer document
# is a slice alone), which bounds what a worker holds beside the batch.
SLICE_BYTES = 4_000_000


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder, for files that one run writes and reads."""
    ensure_checkpoint_dir(spark)
    return shared_path(spark, "llm", f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: later steps reuse the
    rows and a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """``materialize`` as a table in buckets of ``key``, one for each shuffle partition, without a
    shuffle. Joins by the key then read it in place; only the other side moves. For few large rows."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    table = "quarry_" + path.rsplit("/", 1)[1].replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(table)
    return spark.table(table)


def arrow_slices(texts: pa.Array, most: int = SLICE_BYTES):
    """(from, to) index pairs that cover a string column in order, each of about ``most`` bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    a, before = 0, 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield a, b
        a, before = b, int(ends[b - 1])


def free_names(taken: list[str], *names: str) -> list[str]:
    """Each name behind as many underscores (two at least) as it takes that no column has it,
    whatever the case of its letters."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        name = "__" + name
        while name.lower() in used:
            name = "_" + name
        out.append(name)
    return out
