"""Access to the input tables (one parquet dataset per table name)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(table_path(sf_dir, name))


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Temp views under the table names, for ``spark.sql`` (Q1/Q2)."""
    for n in names:
        if os.path.exists(table_path(sf_dir, n)) or "://" in sf_dir:
            load(spark, sf_dir, n).createOrReplaceTempView(n)


def register_file(spark: SparkSession, name: str, path: str, format: str | None = None, schema=None) -> DataFrame:
    """Q2: a file or folder as a view, so that a statement reads it by ``name``: csv, tsv, json (whole
    documents), jsonl, parquet or orc, by ``format`` or else by the path's extension (csv without
    one). Without a schema the types of CSV and JSON are inferred in a scan of their own."""
    from quarry.sources import files
    fmt = format or path.rstrip("/").rsplit("/", 1)[-1].rpartition(".")[2].lower()
    if fmt in ("json", "jsonl"):
        df = (files.read_json_documents if fmt == "json" else files.read_jsonl)(spark, path, schema=schema)
    elif fmt in ("parquet", "orc"):
        df = spark.read.format(fmt).load(path)
    else:
        df = files.read_csv(spark, path, schema=schema, sep="\t" if fmt == "tsv" else ",", infer=schema is None)
    df.createOrReplaceTempView(name)
    return df
