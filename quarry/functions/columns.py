"""Column-expression helpers shared by the operators.

All are built-in Catalyst expressions, so they stay inside whole-stage
codegen and never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_corr(x: ColumnLike, y: ColumnLike) -> Column:
    """Pearson correlation that is NULL (not an error) on a constant column.

    ``corr`` raises DIVIDE_BY_ZERO under ANSI mode when a side has zero
    variance; the covariance/standard-deviation form returns NULL instead.
    All three pieces are mergeable partial aggregates.
    """
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    xx = F.when(both, x.cast("double"))
    yy = F.when(both, y.cast("double"))
    denom = F.stddev_pop(xx) * F.stddev_pop(yy)
    return F.covar_pop(xx, yy) / F.nullif(denom, F.lit(0.0))


def nan_to_null(c: ColumnLike) -> Column:
    """JSON-safe double: NaN and +-Infinity become NULL."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def to_double(c: ColumnLike) -> Column:
    return col(c).try_cast("double")


def safe_int(c: ColumnLike, default: int = 0) -> Column:
    """``safe_convert`` to int: via double, so '3.7' gives 3; bad input gives default."""
    d = col(c).try_cast("double")
    d = F.when(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), F.lit(None)).otherwise(d)
    return F.coalesce(d.try_cast("bigint"), F.lit(default).cast("bigint"))


def safe_double(c: ColumnLike, default: float = 0.0) -> Column:
    d = col(c).try_cast("double")
    d = F.when(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), F.lit(None)).otherwise(d)
    return F.coalesce(d, F.lit(float(default)))


def safe_str(c: ColumnLike, default: str = "No data") -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(default))


def money_to_double(c: ColumnLike) -> Column:
    """'$1,234.50' -> 1234.5; anything unparseable -> NULL."""
    cleaned = F.regexp_replace(F.trim(col(c).cast("string")), r"[$,]", "")
    return cleaned.try_cast("double")


SIG_DIGITS = 10


def round_sig(c: ColumnLike, digits: int = SIG_DIGITS) -> Column:
    """Round to ``digits`` significant digits (0, NULL, NaN and +-Inf kept).

    x is scaled by an exact power of ten, rounded half away from zero and
    scaled back, so the result is the same double in any IEEE engine that
    follows the same steps (the SQL twins use the identical formula).
    """
    x = col(c).cast("double")
    e = F.floor(F.log10(F.abs(x)))
    k = F.lit(digits - 1) - e
    up = F.round(x * F.pow(F.lit(10.0), k), 0) / F.pow(F.lit(10.0), k)
    down = F.round(x / F.pow(F.lit(10.0), -k), 0) * F.pow(F.lit(10.0), -k)
    special = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))) | (x == 0)
    return F.when(special, x).when(k >= 0, up).otherwise(down)


def round_doubles(df: DataFrame, digits: int | None = None, decimals: dict[str, int] | None = None) -> DataFrame:
    """Round every DOUBLE/FLOAT column (top level): to ``SIG_DIGITS``
    significant digits by default, or to ``digits`` decimal places.
    ``decimals`` names columns that sit on a decimal grid (sums of money
    with two decimals): they are rounded to that many places, which
    recovers the exact grid value from any summation order."""
    decimals = decimals or {}
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f"`{f.name}`").cast("double")
            if f.name in decimals:
                out.append(F.round(c, decimals[f.name]).alias(f.name))
                continue
            out.append((round_sig(c) if digits is None else F.round(c, digits)).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def combine_rows(*frames: DataFrame) -> DataFrame:
    """Merge several one-row frames with disjoint columns into one row.

    A union plus a global ``first(ignorenulls)`` aggregate: no cross join,
    and each input may itself be a grouped-then-reduced aggregate.
    """
    merged = frames[0]
    for f in frames[1:]:
        merged = merged.unionByName(f, allowMissingColumns=True)
    names = []
    for f in frames:
        for n in f.columns:
            if n not in names:
                names.append(n)
    return merged.agg(*[F.first(F.col(f"`{n}`"), ignorenulls=True).alias(n) for n in names])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def temporal_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]


def ntz_epoch_micros(c: ColumnLike) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ wall-clock value,
    independent of the session time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col(c))


def ntz_to_instant(c: ColumnLike) -> Column:
    """TIMESTAMP_NTZ -> TIMESTAMP read as UTC (whatever the session zone):
    streaming watermarks need TIMESTAMP, and window bounds then align on
    UTC days exactly like the naive values."""
    return F.timestamp_micros(ntz_epoch_micros(c))


def instant_to_ntz(c: ColumnLike) -> Column:
    """TIMESTAMP -> its UTC wall clock as TIMESTAMP_NTZ (inverse of ntz_to_instant)."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(col(c)), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def ntz_floor(c: ColumnLike, seconds: int) -> Column:
    """Truncate a TIMESTAMP_NTZ to a multiple of ``seconds`` since the epoch
    (hour = 3600), by integer arithmetic: no session time zone involved."""
    us = ntz_epoch_micros(c)
    step = seconds * 1_000_000
    floored = us - F.pmod(us, F.lit(step))
    return F.timestamp_add("MICROSECOND", floored, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
