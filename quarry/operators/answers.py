"""Answer shaping (SURVEY O*) and run-log metrics.

Answers are one-row DataFrames: the spec's keys in order, missing keys
filled with a marker, extra columns dropped, values converted to the
declared types, and the row serialised with ``to_json``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.columns import nan_to_null, safe_double, safe_int, safe_str
from quarry.plans.prefix import exact_quantiles

# Fixed values that must equal the reference's markers and defaults.
MISSING_MARKER = "Missing data"
PAD_VALUE = "No data"


def python_type(type_text: str) -> str:
    """O3: 'number'/'int' -> int, 'float' -> float, else str.
    Deviation (SURVEY §8 trap 1): 'number' stays DOUBLE here."""
    t = type_text.lower()
    if "number" in t:
        return "double"
    if "int" in t:
        return "bigint"
    if "float" in t:
        return "double"
    return "string"


def typed(c: Column, type_text: str) -> Column:
    """O3: safe conversion with the typed default (0, 0.0, 'No data', '' for base64)."""
    t = python_type(type_text)
    if t == "bigint":
        return safe_int(c)
    if t == "double":
        return safe_double(c)
    if "base64" in type_text.lower():
        return safe_str(c, "")
    return safe_str(c, PAD_VALUE)


def json_safe(df: DataFrame) -> DataFrame:
    """NaN/Inf -> NULL for doubles, dates and timestamps as ISO strings."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(nan_to_null(c).alias(f.name))
        elif isinstance(f.dataType, T.DateType):
            out.append(F.date_format(c, "yyyy-MM-dd").alias(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out.append(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def answer_object(row: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """O1: exactly the spec keys, in order; a missing key holds the marker."""
    present = set(row.columns)
    cols = []
    for name, type_text in keys:
        if name in present:
            cols.append(typed(F.col(f"`{name}`"), type_text).alias(name))
        else:
            cols.append(F.lit(MISSING_MARKER).alias(name))
    shaped = json_safe(row.select(*cols))
    return shaped.select("*", F.to_json(F.struct(*[F.col(f"`{k}`") for k, _ in keys])).alias("answer_json"))


def answer_array(values: Column, length: int, as_strings: bool = True) -> Column:
    """O2: fixed-length array: padded with 'No data', truncated, all strings."""
    arr = F.transform(values, lambda v: v.cast("string")) if as_strings else values
    padded = F.concat(arr, F.array_repeat(F.lit(PAD_VALUE), F.greatest(F.lit(length) - F.size(arr), F.lit(0))))
    return F.slice(padded, 1, length)


PERF_LINE = r"PERFORMANCE \| ([^|]+?) \| (Optimized|Fallback) execution: ([0-9.]+)s"


def run_log_metrics(lines: DataFrame, text: str = "value", slow_seconds: float = 60.0) -> DataFrame:
    """Parse 'PERFORMANCE | id | Optimized|Fallback execution: N.NNs'
    lines and aggregate count / mean / p95 / slow share per level."""
    parsed = lines.select(F.regexp_extract(text, PERF_LINE, 1).alias("request_id"),
                          F.lower(F.regexp_extract(text, PERF_LINE, 2)).alias("level"),
                          F.regexp_extract(text, PERF_LINE, 3).try_cast("double").alias("seconds"))
    parsed = parsed.filter(F.col("seconds").isNotNull())
    p95 = exact_quantiles(parsed, "seconds", [0.95], ["level"], ["p95_seconds"]).drop("n")
    means = parsed.groupBy("level").agg(F.count(F.lit(1)).alias("runs"), F.avg("seconds").alias("mean_seconds"),
                                        F.avg((F.col("seconds") > slow_seconds).cast("double")).alias("slow_share"))
    return means.join(p95, "level").select("level", "runs", "mean_seconds", "p95_seconds", "slow_share")
