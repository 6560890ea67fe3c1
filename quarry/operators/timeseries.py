"""Time-series operators.

Raw rows are first resampled to a series table ``(key, t, y)`` with a
partial (map-side) aggregate: its size is keys x periods, bounded by the
time span and not by the data volume. All ordered windows run on that
table and are partitioned by the series key; an unkeyed running total
over raw rows uses the range-partitioned prefix sum instead of a
single-partition window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.columns import ntz_epoch_micros
from quarry.plans.prefix import running_sum

GRAINS = ("day", "week", "month", "quarter", "year")


def period_start(ts: Column, grain: str) -> Column:
    """W6 bucket: the DATE on which the period of ``ts`` starts (weeks start Monday)."""
    d = ts.cast("date")
    if grain == "day":
        return d
    if grain in ("week", "month", "quarter", "year"):
        return F.trunc(d, grain)
    raise ValueError(grain)


def resample(df: DataFrame, ts: str, value: str | None, grain: str = "day",
             key: str | None = None, how: str = "sum") -> DataFrame:
    """(key, t, y) with y = sum / mean / count of value per period."""
    keys = ([F.col(key).alias("key")] if key else [F.lit("all").alias("key")])
    if how == "count":
        agg = F.count(F.lit(1))
    elif how == "mean":
        agg = F.avg(value)
    else:
        agg = F.sum(value)
    return df.groupBy(*keys, period_start(F.col(ts), grain).alias("t")).agg(agg.alias("y"))


def _w(order: str = "t") -> Window:
    return Window.partitionBy("key").orderBy(order)


def cumulative(series: DataFrame, out: str = "cum") -> DataFrame:
    """Running total per key."""
    return series.withColumn(out, F.sum("y").over(_w().rowsBetween(Window.unboundedPreceding, 0)))


def cumulative_rows(df: DataFrame, order: Sequence[str], value: str, out: str = "cum") -> DataFrame:
    """W1 over raw rows (unkeyed): distributed prefix sum, no single-task window."""
    return running_sum(df, order, value, out)


def rolling(series: DataFrame, n: int) -> DataFrame:
    """mean/sum/std of the last n rows; NULL until n rows exist (min_periods=n)."""
    w = _w().rowsBetween(-(n - 1), 0)
    full = F.count("y").over(w) == n
    return series.select("*", F.when(full, F.avg("y").over(w)).alias("roll_mean"),
                         F.when(full, F.sum("y").over(w)).alias("roll_sum"),
                         F.when(full, F.stddev_samp("y").over(w)).alias("roll_std"))


def rolling_span(series: DataFrame, seconds: int, tcol: str = "t") -> DataFrame:
    """sum/count/mean over the time span (t - seconds, t]; gaps count as time.

    The frame is a RANGE over epoch seconds, so irregular or missing
    periods are handled exactly.
    """
    epoch = F.floor(ntz_epoch_micros(F.col(tcol).cast("timestamp_ntz")) / 1_000_000).cast("bigint")
    w = Window.partitionBy("key").orderBy(epoch).rangeBetween(-(seconds - 1), 0)
    return series.select("*", F.sum("y").over(w).alias("span_sum"), F.count("y").over(w).alias("span_n"),
                         F.avg("y").over(w).alias("span_mean"))


def lag_diff(series: DataFrame, k: int = 1) -> DataFrame:
    """Previous value and first difference."""
    prev = F.lag("y", k).over(_w())
    return series.select("*", prev.alias("prev"), (F.col("y") - prev).alias("diff"))


def growth(series: DataFrame, months_back: int, name: str) -> DataFrame:
    """Growth against the period ``months_back`` months earlier.

    A join on the shifted period (not lag), so gaps give NULL instead of
    comparing with the wrong period. try_divide: 0 base gives NULL.
    """
    prev = series.select("key", F.add_months("t", months_back).alias("t"), F.col("y").alias("_prev"))
    j = series.join(prev, ["key", "t"], "left")
    return j.select("key", "t", "y", F.try_divide(F.col("y") - F.col("_prev"), F.col("_prev")).alias(name))


def calendar(series: DataFrame, step_days: int = 1) -> DataFrame:
    """Every period between each key's first and last (daily by default)."""
    span = series.groupBy("key").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    return span.select("key", F.explode(F.sequence("t0", "t1", F.expr(f"INTERVAL {step_days} DAYS"))).alias("t"))


def gap_fill(series: DataFrame, fill: str = "ffill", step_days: int = 1) -> DataFrame:
    """One row per period; missing periods forward-filled (or zero)."""
    cal = calendar(series, step_days)
    j = cal.join(series, ["key", "t"], "left")
    if fill == "zero":
        return j.select("key", "t", F.coalesce("y", F.lit(0)).alias("y"), F.col("y").isNull().alias("filled"))
    w = _w().rowsBetween(Window.unboundedPreceding, 0)
    return j.select("key", "t", F.last("y", ignorenulls=True).over(w).alias("y"), F.col("y").isNull().alias("filled"))


def day_index(tcol: str = "t") -> Column:
    return F.datediff(F.col(tcol), F.lit("1970-01-01").cast("date")).cast("double")


def trend(series: DataFrame) -> DataFrame:
    """Least-squares slope per day and direction per key."""
    x = day_index()
    g = series.groupBy("key").agg(F.regr_slope("y", x).alias("slope"), F.regr_intercept("y", x).alias("intercept"),
                                  F.count("y").alias("n"))
    return g.withColumn("direction", F.when(F.col("slope") > 0, "increasing")
                        .when(F.col("slope") < 0, "decreasing").otherwise("flat"))


def decompose(series: DataFrame, period: int = 7, phase: Column | None = None) -> DataFrame:
    """Classical additive decomposition per key.

    trend = centred moving average (2 x p MA for even p), seasonal = mean
    detrended value per phase re-centred to sum zero, resid = y - trend -
    seasonal. Phase defaults to the weekday (Monday = 0).
    """
    phase = phase if phase is not None else F.weekday("t")
    w = _w()
    h = period // 2
    if period % 2:
        win = w.rowsBetween(-h, h)
        tr = F.when(F.count("y").over(win) == period, F.avg("y").over(win))
    else:
        win = w.rowsBetween(-h, h)
        s = F.sum("y").over(win) - 0.5 * F.first("y").over(win) - 0.5 * F.last("y").over(win)
        tr = F.when(F.count("y").over(win) == period + 1, s / period)
    base = series.select("key", "t", "y", tr.alias("trend"), phase.alias("phase"))
    raw = base.groupBy("key", "phase").agg(F.avg(F.col("y") - F.col("trend")).alias("_s"))
    cen = raw.withColumn("seasonal", F.col("_s") - F.avg("_s").over(Window.partitionBy("key"))).drop("_s")
    out = base.join(cen, ["key", "phase"], "left")
    return out.select("key", "t", "y", "trend", "seasonal",
                      (F.col("y") - F.col("trend") - F.col("seasonal")).alias("resid"))


def seasonality_profile(df: DataFrame, ts: str, value: str, part: str = "weekday") -> DataFrame:
    """Mean and count by weekday (Mon=0) / month / hour of the raw rows."""
    p = {"weekday": F.weekday(ts), "month": F.month(ts), "hour": F.hour(ts)}[part].cast("bigint")
    return df.groupBy(p.alias(part)).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def autocorrelation(series: DataFrame, max_lag: int) -> DataFrame:
    """ACF r_k = sum((y_t - m)(y_{t-k} - m)) / sum((y_t - m)^2) per key."""
    m = F.avg("y").over(Window.partitionBy("key"))
    base = series.select("key", "t", (F.col("y") - m).alias("d"))
    lags = base.select("key", "d", *[F.lag("d", k).over(_w()).alias(f"l{k}") for k in range(1, max_lag + 1)])
    wide = lags.groupBy("key").agg(F.sum(F.col("d") * F.col("d")).alias("den"),
                                   *[F.sum(F.col("d") * F.col(f"l{k}")).alias(f"n{k}") for k in range(1, max_lag + 1)])
    return wide.select("key", F.inline(F.array(*[
        F.struct(F.lit(k).alias("lag"), (F.col(f"n{k}") / F.nullif("den", F.lit(0.0))).alias("acf"))
        for k in range(1, max_lag + 1)])))


def dickey_fuller(series: DataFrame) -> DataFrame:
    """DF regression dy_t = a + b*y_{t-1}; t statistic of b (no lag terms)."""
    ylag = F.lag("y").over(_w())
    d = series.select("key", F.col("y").cast("double").alias("y"), ylag.cast("double").alias("ylag"))
    d = d.select("key", "ylag", (F.col("y") - F.col("ylag")).alias("dy"))
    g = d.groupBy("key").agg(F.regr_slope("dy", "ylag").alias("b"), F.regr_r2("dy", "ylag").alias("r2"),
                             F.regr_syy("dy", "ylag").alias("syy"), F.regr_sxx("dy", "ylag").alias("sxx"),
                             F.regr_count("dy", "ylag").alias("n"))
    se = F.sqrt((1 - F.col("r2")) * F.col("syy") / (F.col("n") - 2) / F.col("sxx"))
    return g.select("key", "n", "b", (F.col("b") / F.nullif(se, F.lit(0.0))).alias("df_t"))


def _horizon(h: int) -> Column:
    return F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step")


def forecast_linear(series: DataFrame, h: int) -> DataFrame:
    """Trend-line forecast for the next h days after each key's last day."""
    x = day_index()
    g = series.groupBy("key").agg(F.regr_slope("y", x).alias("b"), F.regr_intercept("y", x).alias("a"),
                                  F.max("t").alias("last"))
    f = g.select("key", "a", "b", "last", _horizon(h))
    t = F.date_add("last", F.col("step"))
    return f.select("key", "step", t.alias("t"),
                    (F.col("a") + F.col("b") * F.datediff(t, F.lit("1970-01-01").cast("date"))).alias("forecast"))


def forecast_seasonal_naive(series: DataFrame, h: int, period: int = 7) -> DataFrame:
    """Value of the same phase in the last observed season (daily series, gap-filled)."""
    last = series.groupBy("key").agg(F.max("t").alias("last"))
    f = last.select("key", "last", _horizon(h))
    f = f.withColumn("t", F.date_add("last", F.col("step"))) \
         .withColumn("src", F.date_sub("t", (F.ceil(F.col("step") / period) * period).cast("int")))
    src = series.select("key", F.col("t").alias("src"), F.col("y").alias("forecast"))
    return f.join(src, ["key", "src"], "left").select("key", "step", "t", "forecast")


def forecast_ses(series: DataFrame, alpha: float, h: int) -> DataFrame:
    """Simple exponential smoothing, flat forecast = final level.

    level_T = (1-a)^(T-1) y_1 + sum_{i>=2} a (1-a)^(T-i) y_i, a weighted
    sum, so the recursion becomes one grouped aggregate.
    """
    w = _w()
    i = F.row_number().over(w)
    n = F.count(F.lit(1)).over(Window.partitionBy("key"))
    b = series.select("key", "t", "y", i.alias("i"), n.alias("n"))
    a = float(alpha)
    wt = F.when(F.col("i") == 1, F.pow(F.lit(1 - a), F.col("n") - 1)).otherwise(
        F.lit(a) * F.pow(F.lit(1 - a), F.col("n") - F.col("i")))
    lvl = b.groupBy("key").agg(F.sum(wt * F.col("y")).alias("level"), F.max("t").alias("last"))
    return lvl.select("key", _horizon(h), "level", "last").select(
        "key", "step", F.date_add("last", F.col("step")).alias("t"), F.col("level").alias("forecast"))


def _solve(matrix: Column, n: int) -> Column:
    """Solutions of n linear equations, given as an array of rows with the right side last, by
    elimination in array expressions; NULL where they do not determine one (a pivot below 1e-12 of
    the diagonal it started from). For symmetric systems such as normal equations."""
    def step(state: Column, k: Column) -> Column:
        pivot_row = F.get(state["m"], k)
        pivot = F.get(pivot_row, k)
        sound = F.when(F.abs(pivot) > 1e-12 * F.abs(F.get(state["d"], k)), pivot)
        top = F.transform(pivot_row, lambda x: x / sound)
        rows = F.transform(state["m"], lambda row, i: F.when(i == k, top).otherwise(
            F.zip_with(row, top, lambda x, y: x - F.get(row, k) * y)))
        return F.struct(rows.alias("m"), state["d"].alias("d"))

    diagonal = F.transform(matrix, lambda row, i: F.get(row, i))
    start = F.struct(matrix.alias("m"), diagonal.alias("d"))
    done = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), start, step)
    answer = F.transform(done["m"], lambda row: F.get(row, F.lit(n)))
    return F.when(~F.exists(answer, lambda x: x.isNull()), answer)


def ar_fit(series: DataFrame, p: int) -> DataFrame:
    """W13d: AR(p) by least squares per key: ``key, coef`` (intercept, then the coefficients of lag 1
    to p) and ``n``, the rows used; ``recent`` holds the last p values, the latest first.

    The lags are one ordered window over the (key, period) series, their means and co-moments one
    aggregate per key, and the p equations are solved in array expressions. ``coef`` is NULL with
    p + 1 rows or fewer and where the lags determine no solution (a constant series).
    """
    y = F.col("y").cast("double")
    lags = [f"x{k}" for k in range(1, p + 1)]
    rows = series.select("key", "t", y.alias("x0"), *[F.lag(y, k).over(_w()).alias(x) for k, x in enumerate(lags, 1)])
    full = F.lit(True)
    for x in ("x0", *lags):
        full = full & F.col(x).isNotNull()
    pairs = [(i, j) for i in range(1, p + 1) for j in range(0, p + 1) if j == 0 or j >= i]
    used = {x: F.when(full, F.col(x)) for x in ("x0", *lags)}
    g = rows.groupBy("key").agg(
        F.count(used["x0"]).alias("n"), *[F.avg(used[x]).alias(f"m_{x}") for x in used],
        *[F.covar_pop(used[f"x{i}"], used[f"x{j}"]).alias(f"c_{i}_{j}") for i, j in pairs],
        F.max_by(F.array(*[F.col(f"x{k}") for k in range(p)]), "t").alias("recent"))
    matrix = F.array(*[F.array(*[F.col(f"c_{min(i, j)}_{max(i, j)}") for j in range(1, p + 1)], F.col(f"c_{i}_0"))
                       for i in range(1, p + 1)])
    g = g.withColumn("phi", F.when(F.col("n") > p + 1, _solve(matrix, p)))
    means = F.array(*[F.col(f"m_{x}") for x in lags])
    explained = F.aggregate(F.zip_with("phi", means, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return g.select("key", F.concat(F.array(F.col("m_x0") - explained), "phi").alias("coef"), "n", "recent")


def forecast_ar(series: DataFrame, p: int, h: int) -> DataFrame:
    """W13d: ``h`` steps ahead of an AR(p) of each key: ``key, step, t, forecast``. Every step feeds
    on the ones before it. NULL where ``ar_fit`` has no coefficients or one of the last p values is
    missing."""
    fit = ar_fit(series, p).join(series.groupBy("key").agg(F.max("t").alias("last")), "key")

    def step(past: Column, _: Column) -> Column:
        terms = F.zip_with(F.slice(F.col("coef"), 2, p), F.slice(past, 1, p), lambda a, b: a * b)
        return F.concat(F.array(F.aggregate(terms, F.get(F.col("coef"), F.lit(0)), lambda a, b: a + b)), past)

    ahead = F.reverse(F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(h)), F.col("recent"), step), 1, h))
    steps = fit.select("key", "last", _horizon(h), F.when(F.col("coef").isNotNull(), ahead).alias("ahead"))
    return steps.select("key", "step", F.date_add("last", F.col("step")).alias("t"),
                        F.get(F.col("ahead"), F.col("step") - 1).alias("forecast"))


def peak_trough(series: DataFrame) -> DataFrame:
    """Per key the period of the highest and lowest value (earliest on ties)."""
    first_max = F.row_number().over(Window.partitionBy("key").orderBy(F.col("y").desc(), F.col("t")))
    first_min = F.row_number().over(Window.partitionBy("key").orderBy(F.col("y").asc(), F.col("t")))
    s = series.filter(F.col("y").isNotNull()).select("key", "t", "y", first_max.alias("a"), first_min.alias("b"))
    return s.groupBy("key").agg(F.max(F.when(F.col("a") == 1, F.col("t"))).alias("peak_t"),
                                F.max(F.when(F.col("a") == 1, F.col("y"))).alias("peak_y"),
                                F.max(F.when(F.col("b") == 1, F.col("t"))).alias("trough_t"),
                                F.max(F.when(F.col("b") == 1, F.col("y"))).alias("trough_y"))


def rank_within(df: DataFrame, part: str, value: str, tie: str) -> DataFrame:
    """Rank / dense_rank / row_number / quartile (ntile 4) within each
    group, by value descending; computed with keyed prefix sums so a large
    group is spread over many tasks."""
    from quarry.plans.prefix import keyed_ranks
    r = keyed_ranks(df, [part], value, [tie], descending=True, buckets=4)
    return r.withColumnRenamed("ntile", "quartile").select(*df.columns, "rank", "dense_rank", "row_number", "quartile")
