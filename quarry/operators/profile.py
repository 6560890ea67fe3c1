"""Dataset, page and text profiling (SURVEY P*).

A profile of k columns is one aggregate holding all k expressions (one
scan), never k jobs. Counts are exact; the reference's 5-row sample is
not reproduced (stated deviation).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.columns import numeric_columns, string_columns, temporal_columns

# Fixed value that must equal the reference's: column names that mark graph
# edge endpoints.
EDGE_NAME_WORDS = ["source", "target", "from", "to", "node", "edge", "connection"]
DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy", "dd.MM.yyyy"]


def _is_missing(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType
    x = F.col(f"`{c}`")
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return x.isNull() | F.isnan(x)
    return x.isNull()


def row_sample(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows whose JSON text has the smallest hash, as ``row`` (that text): the same rows
    however the table is laid out. Every task keeps its own ``n`` smallest and Spark merges those."""
    js = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("row"))
    return js.withColumn("_h", F.md5(F.col("row").cast("binary"))).orderBy("_h", "row").limit(n).select("row")


def table_profile(df: DataFrame, sample_rows: int = 2) -> DataFrame:
    """Columns, column count, exact row count, dtypes and a small sample (``row_sample``, by
    hash), one row."""
    dtypes = F.array(*[F.struct(F.lit(n).alias("column"), F.lit(t).alias("dtype")) for n, t in df.dtypes])
    counts = df.agg(F.count(F.lit(1)).alias("row_count"))
    sample = row_sample(df, sample_rows).agg(F.sort_array(F.collect_list("row")).alias("sample"))
    from quarry.functions.columns import combine_rows
    meta = counts.select(F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
                         F.lit(len(df.columns)).alias("num_columns"), dtypes.alias("dtypes"), "row_count")
    return combine_rows(meta, sample)


def missing_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULL (and NaN) count per column plus a total row, one pass."""
    cols = list(columns or df.columns)
    wide = df.agg(*[F.count_if(_is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(cols)]
    total = sum((F.col(f"m{i}") for i in range(len(cols))), F.lit(0).cast("bigint"))
    rows.append(F.struct(F.lit("__total__").alias("column"), total.alias("missing")))
    return wide.select(F.inline(F.array(*rows)))


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier identical row (count - distinct).

    Two 64/32-bit fingerprints are counted first (narrow shuffle); only rows
    whose fingerprint occurs more than once are grouped on the full row to
    verify, so wide rows are shuffled only for candidate duplicates.
    """
    cols = [F.col(f"`{c}`") for c in (columns or df.columns)]
    fp = df.select(F.xxhash64(*cols).alias("_h1"), F.hash(*cols).alias("_h2"), *cols)
    cand = fp.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_h1", "_h2")
    rows = fp.join(cand, ["_h1", "_h2"], "left_semi").drop("_h1", "_h2")
    exact = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    return exact.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def html_profile(pages: DataFrame, html: str = "html") -> DataFrame:
    """Size and presence of tables / forms / scripts per page."""
    low = F.lower(F.col(html))
    return pages.select("*", F.length(html).cast("bigint").alias("size_chars"), low.contains("<table").alias("has_tables"),
                        low.contains("<form").alias("has_forms"), low.contains("<script").alias("has_scripts"))


TITLE_PATTERN = r"(?i)<title[^>]*>([^<]+)</title>"


def html_title(html: Column) -> Column:
    """First <title> text, trimmed; NULL when absent."""
    t = F.trim(F.regexp_extract(html, TITLE_PATTERN, 1))
    return F.when(t == "", F.lit(None)).otherwise(t)


def text_profile(docs: DataFrame, text: str = "text") -> DataFrame:
    """Characters and lines (split on newline) per document."""
    return docs.select("*", F.length(text).cast("bigint").alias("size_chars"),
                       F.size(F.split(text, "\n", -1)).cast("bigint").alias("num_lines"))


def preview(docs: DataFrame, text: str, n_lines: int = 10, max_chars: int = 1000) -> DataFrame:
    """First n lines and a 1000-character cap with a truncation mark."""
    lines = F.slice(F.split(text, "\n", -1), 1, n_lines)
    head = F.array_join(lines, "\n")
    capped = F.when(F.length(head) > max_chars, F.concat(F.substring(head, 1, max_chars), F.lit("... (truncated)"))) \
              .otherwise(head)
    return docs.select("*", capped.alias("preview"))


def preview_table(df: DataFrame, n_rows: int = 10, max_columns: int = 10) -> DataFrame:
    """P9 of a table such as a CSV file: columns, num_columns, dtypes, sample_rows and ``preview``
    (one line per row of ``row_sample``, the first ``max_columns`` columns, cells joined by `` | ``),
    one row."""
    shown = df.columns[:max_columns]
    rows = row_sample(df, n_rows)
    schema = ", ".join(f"`{c}` string" for c in df.columns)
    cells = F.from_json("row", schema)
    line = F.concat_ws(" | ", *[F.coalesce(cells[c], F.lit("NULL")) for c in shown])
    out = rows.select(line.alias("line")).agg(F.count(F.lit(1)).alias("sample_rows"),
                                              F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("lines"))
    dtypes = F.array(*[F.struct(F.lit(n).alias("column"), F.lit(t).alias("dtype")) for n, t in df.dtypes])
    return out.select(F.array(*[F.lit(c) for c in df.columns]).alias("columns"), F.lit(len(df.columns)).alias("num_columns"),
                      dtypes.alias("dtypes"), "sample_rows", F.concat_ws("\n", F.lit(" | ".join(shown)), "lines").alias("preview"))


def preview_json(docs: DataFrame, js: str, max_chars: int = 1000) -> DataFrame:
    """P9 of JSON documents: ``data_type`` (list, dict or the scalar's), ``length`` of a list,
    ``keys`` of a dict or of a list's first item, and the text, cut at ``max_chars`` with a mark.
    A document that does not parse has an ``error`` and nothing else."""
    v = F.try_parse_json(js)
    kind = F.schema_of_variant(v)
    data_type = (F.when(kind.startswith("ARRAY"), "list").when(kind.startswith("OBJECT"), "dict").when(kind == "BIGINT", "int")
                 .when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), "float").when(kind == "STRING", "str")
                 .when(kind == "BOOLEAN", "bool").when(v.isNotNull(), "NoneType"))
    items = F.try_variant_get(v, "$", "array<variant>")
    first = F.when(data_type == "list", F.get(items, F.lit(0)).cast("string")).when(data_type == "dict", F.col(js))
    text = F.when(F.length(js) > max_chars, F.concat(F.substring(js, 1, max_chars), F.lit("\n... (truncated)"))).otherwise(F.col(js))
    return docs.select("*", data_type.alias("data_type"), F.size(F.when(data_type == "list", items)).alias("length"),
                       F.json_object_keys(first).alias("keys"), F.when(v.isNotNull(), text).alias("preview"),
                       F.when(v.isNull(), F.lit("JSON parse error")).alias("error"))


def column_roles(df: DataFrame, date_hit_rate: float = 0.8) -> DataFrame:
    """Role of every column (numeric / date / text / edge endpoint), the
    suggested chart kind, and row / column counts, from the schema plus one
    aggregate of date-parse hit rates for string columns."""
    nums = numeric_columns(df)
    temps = temporal_columns(df)
    strs = string_columns(df)
    hits = []
    for c in strs:
        parsed = F.coalesce(*[F.try_to_timestamp(F.col(f"`{c}`"), F.lit(fmt)) for fmt in DATE_FORMATS])
        hits += [F.count_if(parsed.isNotNull()).alias(f"{c}__hit"), F.count(F.col(f"`{c}`")).alias(f"{c}__nn")]
    stats = df.agg(F.count(F.lit(1)).alias("__rows"), *hits)
    rows = []
    for c, t in df.dtypes:
        lc = c.lower()
        edge = F.lit(any(w in lc for w in EDGE_NAME_WORDS))
        if c in nums:
            role = F.lit("numeric")
        elif c in temps:
            role = F.lit("date")
        elif c in strs:
            rate = F.col(f"{c}__hit") / F.nullif(F.col(f"{c}__nn"), F.lit(0))
            role = F.when(rate >= date_hit_rate, F.lit("date")).otherwise(F.lit("text"))
        else:
            role = F.lit("other")
        rows.append(F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), role.alias("role"),
                             edge.alias("edge_endpoint")))
    chart = "scatter" if len(nums) >= 2 else ("histogram" if len(nums) == 1 else "bar")
    return stats.select(F.inline(F.array(*rows)), F.lit(chart).alias("suggested_chart"),
                        F.col("__rows").alias("row_count"), F.lit(len(df.columns)).alias("column_count"))


def impute(df: DataFrame, columns: Sequence[str], how: str = "mean", value=None) -> DataFrame:
    """Fill NULLs with the column mean / median (scalar subqueries) or a constant ``value``, or
    drop the rows."""
    if how not in ("mean", "median", "constant", "drop"):
        raise ValueError(f"how must be mean, median, constant or drop, not {how!r}")
    if how == "constant" and value is None:
        raise ValueError("a constant fill needs a value")
    if how == "drop":
        return df.na.drop(subset=list(columns))
    from quarry.plans.prefix import exact_quantiles
    out = df
    for c in columns:
        if how == "mean":
            fill = df.agg(F.avg(c)).scalar()
        elif how == "constant":
            fill = F.lit(value)
        else:
            fill = exact_quantiles(df, c, [0.5]).select("q0").scalar()
        out = out.withColumn(c, F.coalesce(F.col(c), fill))
    return out


def convert_with_validation(df: DataFrame, column: str, to: str = "double") -> DataFrame:
    """try_cast a text column; count values that were present but bad."""
    raw = F.col(column)
    conv = F.regexp_replace(F.trim(raw), r"[$,]", "").try_cast(to)
    return df.agg(F.count(raw).alias("present"), F.count(conv).alias("converted"),
                  F.count_if(raw.isNotNull() & (F.trim(raw) != "") & conv.isNull()).alias("invalid"))


def detect_dates(df: DataFrame, column: str, formats: Sequence[str] = tuple(DATE_FORMATS),
                 threshold: float = 0.8) -> DataFrame:
    """Share of non-null values that parse as a date in any format, and
    whether the column qualifies (hit rate >= threshold)."""
    parsed = F.coalesce(*[F.try_to_timestamp(F.col(column), F.lit(f)) for f in formats])
    g = df.agg(F.count(column).alias("non_null"), F.count_if(parsed.isNotNull()).alias("parsed"))
    return g.select("non_null", "parsed", (F.col("parsed") / F.nullif(F.col("non_null"), F.lit(0))).alias("hit_rate"),
                    (F.col("parsed") >= F.lit(threshold) * F.col("non_null")).alias("is_date"))


def date_shape(fmt: str) -> str:
    """A regular expression that the beginning of every text of a date format matches: fields of two
    or four digits, literals as they are, anything from the first other field on."""
    out = "^"
    for m in re.finditer(r"([A-Za-z])\1*|'|[^A-Za-z']", fmt):
        part = m.group()
        if part == "yyyy":
            out += r"[+-]?[0-9]{4,}"
        elif part in ("MM", "dd", "HH", "mm", "ss"):
            out += "[0-9]{2}"
        elif part[0].isalpha() or part in "'[]{}#":
            break
        else:
            out += re.escape(part)
    return out


def _parsed(x: Column, fmt: str) -> Column:
    """``try_to_timestamp`` for the texts that have the format's shape: a text that does not parse
    costs an exception, many times what the shape costs."""
    return F.when(x.rlike(date_shape(fmt)), F.try_to_timestamp(x, F.lit(fmt)))


def _votes(df: DataFrame, columns: Sequence[str], formats: Sequence[str]) -> DataFrame:
    """One row: present values (``n{i}``) and votes per format (``v{i}``) of every column."""
    aggs = []
    for i, c in enumerate(columns):
        x = F.trim(F.col(f"`{c}`"))
        aggs += [F.count(F.nullif(x, F.lit(""))).alias(f"n{i}"),
                 F.array(*[F.count_if(_parsed(x, f).isNotNull()) for f in formats]).alias(f"v{i}")]
    return df.agg(*aggs)


def date_formats(df: DataFrame, columns: Sequence[str], formats: Sequence[str] = tuple(DATE_FORMATS)) -> DataFrame:
    """Per text column the format that most values have (ties: the first given), the values
    that are present, that it converts and that it fails: ``column, format, present, converted,
    failed``. The format is NULL where no value has any. One aggregate votes for all columns."""
    votes = _votes(df, columns, formats)
    names = F.array(*[F.lit(f) for f in formats])
    rows = []
    for i, c in enumerate(columns):
        best = F.array_max(F.col(f"v{i}"))
        fmt = F.when(best > 0, F.get(names, (F.array_position(F.col(f"v{i}"), best) - 1).cast("int")))
        rows.append(F.struct(F.lit(c).alias("column"), fmt.alias("format"), F.col(f"n{i}").alias("present"),
                             best.alias("converted"), (F.col(f"n{i}") - best).alias("failed")))
    return votes.select(F.inline(F.array(*rows)))


def convert_dates(df: DataFrame, columns: Sequence[str], formats: Sequence[str] = tuple(DATE_FORMATS)) -> DataFrame:
    """``df`` with the text columns converted to timestamps by the format that ``date_formats``
    finds for each; values in another format, or none, become NULL. The vote is one aggregate over
    all columns, whose one row of counts chooses the formats before the conversion is planned."""
    votes = _votes(df, columns, formats).first()
    out = {}
    for i, c in enumerate(columns):
        v = votes[f"v{i}"]
        best = max(v, default=0)
        out[c] = _parsed(F.trim(F.col(f"`{c}`")), formats[v.index(best)]) if best > 0 else F.lit(None).cast("timestamp")
    return df.withColumns(out)
