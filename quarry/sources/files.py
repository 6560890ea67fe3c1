"""File sources and sinks (SURVEY S*).

Readers return DataFrames with a declared schema where one is given;
schema inference is an opt-in extra pass. Encodings are an argument;
``detect_encoding`` decides between UTF-8 and a single-byte fallback by a
distributed count of undecodable characters, never by reading a file on
the driver.
"""

from __future__ import annotations

import io
import zipfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import cut_lineage

# Fixed values that must equal the reference's (accepted upload extensions,
# source-file priority and excluded output names).
ACCEPTED_EXTENSIONS = [".csv", ".json", ".txt", ".html", ".htm", ".xml", ".zip",
                       ".xlsx", ".xls", ".tsv", ".md", ".log"]
PRIORITY_NAMES = ["data.json", "input.json", "dataset.json", "attachment.json", "file.json",
                  "data.csv", "input.csv", "dataset.csv", "sample.csv"]
PRIORITY_EXTENSIONS = [".json", ".csv", ".parquet", ".xlsx"]
EXCLUDED_CSV_WORDS = ["result", "output", "temp", "log", "error"]
EXCLUDED_JSON_WORDS = ["result", "output", "temp", "config", "settings", "log", "error"]
INVALID_NAME_CHARS = '<>:"/\\|?*'
FALLBACK_ENCODINGS = ["utf-8", "latin-1", "cp1252", "iso-8859-1"]


# ----------------------------------------------------------------- readers


def detect_encoding(spark: SparkSession, path: str) -> str:
    """The encoding of a folder's text: UTF-16 if a file begins with its byte order mark,
    'UTF-8' unless some line is not valid UTF-8, else 'ISO-8859-1'.

    ``read.text`` keeps the raw bytes; ``is_valid_utf8`` checks them in the JVM and one distributed
    ``count_if`` brings two numbers to the driver. A line that starts with a mark's bytes decides for
    UTF-16, as no UTF-8 text has them. Latin-1 decodes every byte, so it ends the chain.
    """
    raw = F.expr("substring(cast(value as binary), 1, 2)")
    seen = spark.read.text(path).agg(
        F.count_if(raw.isin(F.lit(bytearray(b"\xff\xfe")), F.lit(bytearray(b"\xfe\xff")))).alias("marks"),
        F.count_if(~F.expr("is_valid_utf8(value)")).alias("bad")).first()
    return "UTF-16" if seen["marks"] else "ISO-8859-1" if seen["bad"] else "UTF-8"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             header: bool = True, sep: str = ",", encoding: str | None = "UTF-8",
             infer: bool = False) -> DataFrame:
    """CSV with header; ``encoding=None`` detects UTF-8 vs Latin-1."""
    enc = encoding or detect_encoding(spark, path)
    r = spark.read.option("header", header).option("sep", sep).option("encoding", enc).option("mode", "PERMISSIVE")
    if schema is not None:
        r = r.schema(schema)
    elif infer:
        r = r.option("inferSchema", True)
    return r.csv(path)


def read_tsv(spark: SparkSession, path: str, schema=None, header: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """Tab-separated values."""
    return read_csv(spark, path, schema=schema, header=header, sep="\t", encoding=encoding)


def read_json_documents(spark: SparkSession, path: str, schema=None, encoding: str | None = "UTF-8") -> DataFrame:
    """Whole-file JSON (a top-level array of objects becomes rows); ``encoding=None`` detects
    UTF-16, UTF-8 or Latin-1."""
    r = spark.read.option("multiLine", True).option("encoding", encoding or detect_encoding(spark, path))
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def read_jsonl(spark: SparkSession, path: str, schema=None, encoding: str = "UTF-8") -> DataFrame:
    """One JSON object per line; bad lines land in ``_corrupt_record``.
    Timestamps keep microseconds; a non-UTF-8 encoding needs the line
    separator spelled out."""
    r = (spark.read.option("encoding", encoding).option("timestampNTZFormat", TS_FORMAT)
         .option("timestampFormat", TS_FORMAT))
    if encoding.upper().replace("-", "") not in ("UTF8",):
        r = r.option("lineSep", "\n")
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Columnar scan with filter pushdown and column pruning."""
    return spark.read.parquet(path)


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line (``value``) plus the source file."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file (``value`` = whole text), e.g. HTML pages."""
    return spark.read.option("wholetext", True).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value"))


def read_xml(spark: SparkSession, path: str, row_tag: str, schema=None) -> DataFrame:
    """XML records (built-in source in Spark 4)."""
    r = spark.read.format("xml").option("rowTag", row_tag)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def zip_members(spark: SparkSession, path: str, errors: bool = False) -> DataFrame:
    """One row per ZIP member: (archive, member, size, content).

    Directories and hidden members are skipped, names are flattened to
    their basename with the ``extracted_`` prefix. Archives are read by
    ``binaryFile`` and opened on the executors; each member is yielded by
    itself. A bad archive or member is a row with ``error`` and no content
    when ``errors`` is set, else it has no row.
    """
    schema = "archive string, member string, size long, content binary" + (", error string" if errors else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def members(path, blob):
        try:
            with zipfile.ZipFile(io.BytesIO(bytes(blob))) as zf:
                for info in zf.infolist():
                    base = info.filename.rstrip("/").split("/")[-1]
                    if info.is_dir() or not base or base.startswith(".") or "/." in "/" + info.filename:
                        continue
                    try:
                        data = zf.read(info)
                    except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError) as e:
                        # damaged, encrypted or in a method that is not supported
                        yield path, f"extracted_{base}", None, None, f"{type(e).__name__}: {e}"
                    else:
                        yield path, f"extracted_{base}", len(data), data, None
        except (zipfile.BadZipFile, zlib.error, EOFError) as e:
            yield path, None, None, None, f"{type(e).__name__}: {e}"

    def explode(batches):
        for pdf in batches:
            for p, blob in zip(pdf["path"], pdf["content"]):
                for row in members(p, blob):
                    if errors or row[-1] is None:
                        out = pd.DataFrame([row[:len(names)]], columns=names)
                        yield out.assign(size=out["size"].astype("Int64"))

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(explode, schema)


# ----------------------------------------------------------------- manifest


def _ext(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def sanitize_name(name: Column) -> Column:
    """Invalid characters to '_', strip spaces and dots, empty -> unnamed_file,
    longer than 255 -> first 250 of the stem + extension."""
    cleaned = F.translate(name, INVALID_NAME_CHARS, "_" * len(INVALID_NAME_CHARS))
    cleaned = F.regexp_replace(cleaned, r"^[ .]+|[ .]+$", "")
    cleaned = F.when(cleaned == "", F.lit("unnamed_file")).otherwise(cleaned)
    ext = F.regexp_extract(cleaned, r"(\.[^.]*)$", 1)
    stem_col = F.substring(cleaned, F.lit(1), F.length(cleaned) - F.length(ext))
    capped = F.concat(F.substring(stem_col, F.lit(1), F.lit(250)), ext)
    return F.when(F.length(cleaned) > 255, capped).otherwise(cleaned)


def human_size(n: Column) -> Column:
    """Base-1024 size with one decimal: '0.0 B', '512.0 B', '1.5 KB', ... 'TB'."""
    units = ["B", "KB", "MB", "GB", "TB"]
    d = n.cast("double")
    expr = None
    for i, u in enumerate(units):
        lo = 1024.0 ** i
        cond = d < lo * 1024.0 if i < len(units) - 1 else F.lit(True)
        val = F.concat(F.format_string("%.1f", d / F.lit(lo)), F.lit(f" {u}"))
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr


def file_type(ext: Column) -> Column:
    return (F.when(ext == ".csv", "csv").when(ext == ".json", "json")
            .when(ext.isin(".xlsx", ".xls"), "excel").when(ext.isin(".html", ".htm"), "html")
            .when(ext == ".txt", "text").when(ext == ".parquet", "parquet").otherwise("text"))


def manifest(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """One row per file with derived columns; content is never read.

    ``binaryFile`` prunes the ``content`` column when it is not selected, so
    only the file listing and lengths are touched.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root)
             .select("path", "length"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    ext = _ext(F.col("path"))
    lname = F.lower(name)
    def any_word(words):
        hit = F.lit(False)
        for w in words:
            hit = hit | lname.contains(w)
        return hit

    # priority file names first, then json, csv, parquet, xlsx; json/csv
    # files whose name holds an output word are not data sources
    rank = F.when(lname.isin(*PRIORITY_NAMES), F.array_position(F.array(*map(F.lit, PRIORITY_NAMES)), lname) - 1)
    rank = rank.when((ext == ".json") & ~any_word(EXCLUDED_JSON_WORDS), F.lit(len(PRIORITY_NAMES)))
    rank = rank.when((ext == ".csv") & ~any_word(EXCLUDED_CSV_WORDS), F.lit(len(PRIORITY_NAMES) + 1))
    rank = rank.when(ext == ".parquet", F.lit(len(PRIORITY_NAMES) + 2))
    rank = rank.when(ext == ".xlsx", F.lit(len(PRIORITY_NAMES) + 3))
    is_question = (lname == "questions.txt") | lname.endswith("question.txt") | (
        lname.contains("question") & lname.endswith(".txt"))
    return files.select(
        F.col("path"), name.alias("name"), F.col("length").alias("size"), ext.alias("extension"),
        file_type(ext).alias("type"), ext.isin(*ACCEPTED_EXTENSIONS).alias("accepted"),
        sanitize_name(name).alias("safe_name"), human_size(F.col("length")).alias("size_text"),
        is_question.alias("is_question_file"), rank.cast("int").alias("source_rank"))


def manifest_by_type(files: DataFrame) -> DataFrame:
    """``type, n_files, n_accepted, total_size`` of a manifest."""
    return files.groupBy("type").agg(F.count(F.lit(1)).alias("n_files"), F.count_if("accepted").alias("n_accepted"),
                                     F.sum("size").alias("total_size"))


# ----------------------------------------------------------------- sinks


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV with header, no index column."""
    df.write.mode(mode).option("header", True).csv(path)
    return path


TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite", encoding: str = "UTF-8") -> str:
    """JSON result rows (one object per line), microsecond timestamps."""
    (df.write.mode(mode).option("encoding", encoding).option("timestampNTZFormat", TS_FORMAT)
     .option("timestampFormat", TS_FORMAT).json(path))
    return path


CORRUPT = "_corrupt_record"


def read_results(spark: SparkSession, glob: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The result JSON files of many run folders, with ``run_dir`` as lineage. A file that does
    not parse is a row with its text in ``_corrupt_record``; with a schema as without, that column
    is always there."""
    r = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if schema is not None:
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        known = schema if CORRUPT in schema.names else T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        r = r.schema(known)
    df = r.json(glob)
    if CORRUPT not in df.columns:
        df = df.withColumn(CORRUPT, F.lit(None).cast("string"))
    path = F.url_decode(F.col("_metadata.file_path"))
    return df.withColumn("run_dir", F.regexp_extract(path, r"([^/]+)/[^/]+$", 1))


def read_text_results(spark: SparkSession, glob: str) -> DataFrame:
    """The text outputs of run folders: ``run_dir, name, text``, one row per file."""
    path = F.url_decode(F.col("_metadata.file_path"))
    return spark.read.option("wholetext", True).text(glob).select(
        F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("run_dir"), F.regexp_extract(path, r"([^/]+)$", 1).alias("name"),
        F.col("value").alias("text"))


def result_health(results: DataFrame) -> DataFrame:
    """Per run the rows that were read and the damaged files: ``run_dir, n_rows, n_damaged``. The
    results are pinned first: a file scan may not be asked for its damaged texts alone."""
    bad = F.col(CORRUPT).isNotNull()
    return cut_lineage(results).groupBy("run_dir").agg(F.count_if(~bad).alias("n_rows"), F.count_if(bad).alias("n_damaged"))


URL_PATTERN = r"https?://\S+"


def extract_urls(text: Column) -> Column:
    """Every http(s) URL in a text (array, in order)."""
    return F.regexp_extract_all(text, F.lit(URL_PATTERN), 0)
