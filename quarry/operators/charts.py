"""Chart data tables (SURVEY C*): the aggregate behind each chart kind.

Drawing is not built; every function returns the rows a plotting tool
needs, computed with the same operators as the numeric answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import graph as G
from quarry.operators import stats as S
from quarry.operators import timeseries as W


def bar_totals(df: DataFrame, category: str, measure: str) -> DataFrame:
    """Total per category."""
    return df.groupBy(category).agg(F.sum(measure).alias("total"))


def line_series(df: DataFrame, ts: str, measure: str, grain: str = "month") -> DataFrame:
    """Measure and running total per period (down-sampled by the grain)."""
    return W.cumulative(W.resample(df, ts, measure, grain))


def histogram_bins(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """(bin_lo, bin_hi, n)."""
    return S.histogram(df, value, bins)


def scatter_points(df: DataFrame, x: str, y: str, key: str, every: int) -> DataFrame:
    """A deterministic 1-in-``every`` point sample by key hash (the
    down-sampling is the feature of a scatter chart) ..."""
    return df.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(every)) == 0).select(key, x, y)


def regression_endpoints(df: DataFrame, x: str, y: str) -> DataFrame:
    """... and the fitted line's two endpoints over all rows."""
    fit = S.regression_line(df, y, x)
    rng = df.agg(F.min(F.col(x).cast("double")).alias("x0"), F.max(F.col(x).cast("double")).alias("x1"))
    a = fit.select("slope").scalar()
    b = fit.select("intercept").scalar()
    return rng.select(F.inline(F.array(
        F.struct(F.col("x0").alias("x"), (b + a * F.col("x0")).alias("y")),
        F.struct(F.col("x1").alias("x"), (b + a * F.col("x1")).alias("y")))))


def box_plot(df: DataFrame, group: str, value: str) -> DataFrame:
    """Five numbers, fences and outlier count per group."""
    return S.iqr_outliers(df, group, value)


def violin(df: DataFrame, group: str, value: str, bins: int = 20) -> DataFrame:
    """Histogram per group over the global range."""
    x = F.col(value).cast("double")
    rng = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    lo, hi = rng.select("lo").scalar(), rng.select("hi").scalar()
    w = (hi - lo) / F.lit(float(bins))
    b = F.when(w == 0, 0).otherwise(F.least(F.floor((x - lo) / F.nullif(w, F.lit(0.0))), F.lit(bins - 1))).cast("int")
    return df.filter(x.isNotNull()).groupBy(group, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def network_table(edges: DataFrame) -> DataFrame:
    """Labelled nodes with degree plus the edges, one table."""
    d = G.degrees(edges).select(F.lit("node").alias("kind"), F.col("node").alias("a"),
                                F.lit(None).cast(edges.schema["dst"].dataType).alias("b"), "degree")
    e = edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"),
                     F.lit(None).cast("bigint").alias("degree"))
    return d.unionByName(e)
