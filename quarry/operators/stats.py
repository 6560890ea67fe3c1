"""Statistics (SURVEY T*): describe, correlation family, tests, outliers,
histograms, regression lines and frequency tables.

Everything is computed from mergeable moments in one aggregate per
question (count, sums, co-moments, exact or approximate percentiles);
global constants such as min/max or totals enter row expressions as
scalar subqueries, never through a join of a one-row frame.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import safe_corr
from quarry.functions.distributions import kolmogorov_tail, normal_cdf
from quarry.plans.prefix import exact_quantiles, join_groups, value_ranks
from quarry.session import cut_lineage


def _num(c: str) -> Column:
    return F.col(c).cast("double")


def describe(df: DataFrame, columns: Sequence[str], exact_percentiles: bool = True) -> DataFrame:
    """One aggregate over all columns, then one row per column.

    Skewness and kurtosis are the bias-corrected sample forms (pandas /
    DuckDB), derived from Spark's population moments.
    ``exact_percentiles=False`` switches quartiles to ``percentile_approx``
    for very large groups (named, never silent).
    """
    aggs = []
    for c in columns:
        x = _num(c)
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"),
                 F.max(x).alias(f"{c}__max"), F.skewness(x).alias(f"{c}__g1"), F.kurtosis(x).alias(f"{c}__g2")]
        if not exact_percentiles:
            aggs.append(F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10000).alias(f"{c}__q"))
    wide = df.agg(*aggs)
    structs = []
    for c in columns:
        n = F.col(f"{c}__count").cast("double")
        g1, g2 = F.col(f"{c}__g1"), F.col(f"{c}__g2")
        skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))
        kurt = F.when(n > 3, ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)))
        structs.append(F.struct(
            F.lit(c).alias("column"), F.col(f"{c}__count").alias("count"), F.col(f"{c}__mean").alias("mean"),
            F.col(f"{c}__std").alias("std"), F.col(f"{c}__min").alias("min"),
            *([F.col(f"{c}__q")[0].alias("q25"), F.col(f"{c}__q")[1].alias("q50"), F.col(f"{c}__q")[2].alias("q75")]
              if not exact_percentiles else []),
            F.col(f"{c}__max").alias("max"), skew.alias("skewness"), kurt.alias("kurtosis")))
    long = wide.select(F.inline(F.array(*structs)))
    if not exact_percentiles:
        return long
    # exact quartiles of all columns in one rank pipeline over (column, value)
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _num(c).alias("value"))
                                            for c in columns])).alias("s")).select("s.*")
    q = exact_quantiles(stacked, "value", [0.25, 0.5, 0.75], ["column"], ["q25", "q50", "q75"]).drop("n")
    out = long.join(q, "column", "left")
    return out.select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max", "skewness", "kurtosis")


def pearson(df: DataFrame, x: str | Column, y: str | Column, name: str = "r") -> DataFrame:
    """Guarded Pearson correlation (NULL on a constant column)."""
    return df.agg(safe_corr(x, y).alias(name))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All column pairs (col_a before col_b as given), long form.

    One definition at every width: a pair uses the rows where both values are finite numbers (NULL,
    NaN and infinite values count as missing), and a
    column that is constant on them gives NULL. Values are centred on the column means (one
    aggregate), then one pass gathers the Gram matrices of values, squares and presence: tasks
    multiply Arrow batches, and what is shuffled is one row per pair and task.
    """
    cols = list(columns)
    k = len(cols)
    means = df.agg(*[F.avg(_num(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first() if k else []
    centre = [0.0 if m is None or not math.isfinite(m) else float(m) for m in means]
    upper = np.triu_indices(k, 1)

    def gram(batches):
        total = np.zeros((6, k, k))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1) - centre
            p = np.isfinite(x).astype(float)
            x = np.where(p > 0, x, 0.0)
            total += np.stack([p.T @ p, x.T @ p, p.T @ x, (x * x).T @ p, p.T @ (x * x), x.T @ x])
        yield pa.RecordBatch.from_arrays(
            [pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), *(pa.array(t[upper]) for t in total)],
            names=["i", "j", *names])

    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    sums = df.select(*[_num(c).alias(f"v{i}") for i, c in enumerate(cols)]).mapInArrow(
        gram, "i int, j int, " + ", ".join(f"{x} double" for x in names)).groupBy("i", "j").agg(
        *[F.sum(x).alias(x) for x in names])
    n = F.nullif(F.col("n"), F.lit(0.0))
    # below this share of the mean square a variance is rounding error
    var = lambda s, ss: F.when(F.col(ss) / n - (F.col(s) / n) ** 2 > 1e-13 * F.col(ss) / n,
                               F.col(ss) / n - (F.col(s) / n) ** 2)
    r = (F.col("sxy") / n - F.col("sx") / n * F.col("sy") / n) / F.sqrt(var("sx", "sxx") * var("sy", "syy"))
    name = F.array(*[F.lit(c) for c in cols])
    return sums.select(name[F.col("i")].alias("col_a"), name[F.col("j")].alias("col_b"),
                       F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))


def strongest_pair(matrix: DataFrame) -> DataFrame:
    """T4: pair with the largest |r| (ties by column names)."""
    return (matrix.filter(F.col("r").isNotNull())
            .orderBy(F.abs("r").desc(), F.col("col_a"), F.col("col_b")).limit(1))


def spearman(df: DataFrame, x: str, y: str, name: str = "rho") -> DataFrame:
    """T5: Pearson on tie-averaged ranks.

    Ranks come from per-value counts and distributed prefix sums (no
    global window). What joins the rank tables is one counter per distinct
    (x, y), not the rows; a rank table of few values is broadcast, so that a
    column of few values does not gather its pairs. The mean rank is
    (n + 1) / 2, so the correlation is three weighted sums.
    """
    pts = df.select(F.col(x).alias("_x"), F.col(y).alias("_y")).filter("_x IS NOT NULL AND _y IS NOT NULL")
    rx = value_ranks(pts, "_x").select("_x", F.col("avg_rank").alias("_rx"))
    ry = value_ranks(pts, "_y").select("_y", F.col("avg_rank").alias("_ry"))
    pairs = pts.groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("_c"))
    mean = (pts.agg(F.count(F.lit(1))).scalar() + 1) / F.lit(2.0)
    ranked = join_groups(join_groups(pairs, rx, "_x"), ry, "_y").select(
        "_c", (F.col("_rx") - mean).alias("_dx"), (F.col("_ry") - mean).alias("_dy"))
    weighted = lambda a, b: F.sum(F.col("_c") * F.col(a) * F.col(b))
    norm = F.sqrt(weighted("_dx", "_dx")) * F.sqrt(weighted("_dy", "_dy"))
    return ranked.agg((weighted("_dx", "_dy") / F.nullif(norm, F.lit(0.0))).alias(name))


def _average_ranks(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every value replaced by its tie-averaged rank in its column."""
    out = rows
    for c in columns:
        ranks = value_ranks(rows, c).select(c, F.col("avg_rank").alias("_rank"))
        out = join_groups(out, ranks, c).withColumn(c, F.col("_rank")).drop("_rank")
    return out


def group_moments(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(_num(value)).alias("n"), F.avg(_num(value)).alias("mean"),
                                 F.var_samp(_num(value)).alias("var"))


def t_test_one_sample(df: DataFrame, value: str, mu0: float) -> DataFrame:
    """T6 one-sample: t = (mean - mu0) / (sd / sqrt(n)), df = n - 1."""
    x = _num(value)
    g = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    return g.select((F.col("mean") - F.lit(mu0)) / F.nullif(F.col("sd") / F.sqrt("n"), F.lit(0.0)),
                    (F.col("n") - 1).cast("double")).toDF("t", "df")


def t_test_two_sample(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """T6 two-sample, pooled and Welch, from the two groups' moments."""
    g = df.filter(F.col(group).isin(a, b)).groupBy().agg(
        *[F.count(F.when(F.col(group) == v, _num(value))).alias(f"n{i}") for i, v in ((1, a), (2, b))],
        *[F.avg(F.when(F.col(group) == v, _num(value))).alias(f"m{i}") for i, v in ((1, a), (2, b))],
        *[F.var_samp(F.when(F.col(group) == v, _num(value))).alias(f"v{i}") for i, v in ((1, a), (2, b))])
    n1, n2, m1, m2, v1, v2 = (F.col(c).cast("double") for c in ("n1", "n2", "m1", "m2", "v1", "v2"))
    sp2 = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    t_pooled = (m1 - m2) / F.nullif(F.sqrt(sp2 * (1 / n1 + 1 / n2)), F.lit(0.0))
    se2 = v1 / n1 + v2 / n2
    t_welch = (m1 - m2) / F.nullif(F.sqrt(se2), F.lit(0.0))
    df_welch = se2 * se2 / F.nullif((v1 / n1) * (v1 / n1) / (n1 - 1) + (v2 / n2) * (v2 / n2) / (n2 - 1), F.lit(0.0))
    return g.select(t_pooled.alias("t_pooled"), (n1 + n2 - 2).alias("df_pooled"),
                    t_welch.alias("t_welch"), df_welch.alias("df_welch"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square statistic of independence and its degrees of freedom.

    stat = sum over observed cells of O^2/E - N (cells with O = 0 add E,
    which this identity accounts for), E = row_total * col_total / N.
    Row, column and grand totals are grouped sums of the (small) crosstab.
    """
    ct = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("o"))
    rows = ct.groupBy(a).agg(F.sum("o").alias("ra"))
    cols = ct.groupBy(b).agg(F.sum("o").alias("cb"))
    n = ct.agg(F.sum("o")).scalar()
    cells = ct.join(rows, a).join(cols, b)
    e = F.col("ra") * F.col("cb") / n
    stat = cells.agg((F.sum(F.col("o") * F.col("o") / e) - n).alias("chi2"),
                     F.count_distinct(a).alias("r"), F.count_distinct(b).alias("c"))
    return stat.select("chi2", ((F.col("r") - 1) * (F.col("c") - 1)).alias("dof"))


def anova_oneway(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way ANOVA F from per-group moments (ANOVATest is absent in 4.1)."""
    g = group_moments(df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()), group, value)
    grand = g.agg(F.sum(F.col("n") * F.col("mean")) / F.sum("n")).scalar()
    s = g.agg(F.sum(F.col("n") * (F.col("mean") - grand) * (F.col("mean") - grand)).alias("ssb"),
              F.sum((F.col("n") - 1) * F.coalesce(F.col("var"), F.lit(0.0))).alias("ssw"),
              F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    return s.select((F.col("ssb") / (F.col("k") - 1) / F.nullif(F.col("ssw") / (F.col("n") - F.col("k")), F.lit(0.0)))
                    .alias("f"), (F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"),
                    F.col("ssb"), F.col("ssw"))


def jarque_bera(df: DataFrame, value: str) -> DataFrame:
    """JB = n/6 * (S^2 + K^2/4), population skewness S and excess kurtosis K."""
    x = _num(value)
    g = df.agg(F.count(x).alias("n"), F.skewness(x).alias("s"), F.kurtosis(x).alias("k"))
    return g.select("n", "s", "k", (F.col("n") / 6.0 * (F.col("s") * F.col("s") + F.col("k") * F.col("k") / 4.0))
                    .alias("jb"))


def mean_confidence_interval(df: DataFrame, value: str, z: float = 1.96) -> DataFrame:
    """Mean +- z * sd / sqrt(n)."""
    x = _num(value)
    g = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    half = F.lit(z) * F.col("sd") / F.sqrt("n")
    return g.select("n", "mean", (F.col("mean") - half).alias("lo"), (F.col("mean") + half).alias("hi"))


def iqr_outliers(df: DataFrame, group: str, value: str, k: float = 1.5) -> DataFrame:
    """Per group quartiles, fences and outlier count (five numbers too).

    The per-group fences table has one row per group and meets counters of
    distinct (group, value), not rows.
    """
    x = _num(value)
    fences = exact_quantiles(df, value, [0.0, 0.25, 0.5, 0.75, 1.0], [group],
                             ["min", "q1", "median", "q3", "max"]).drop("n")
    fences = fences.withColumn("lo", F.col("q1") - k * (F.col("q3") - F.col("q1"))) \
                   .withColumn("hi", F.col("q3") + k * (F.col("q3") - F.col("q1")))
    fences = cut_lineage(fences)
    values = df.groupBy(group, x.alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    out = (F.col("_x") < F.col("lo")) | (F.col("_x") > F.col("hi"))
    counts = join_groups(values, fences.select(group, "lo", "hi"), group).groupBy(group).agg(
        F.sum(F.when(out, F.col("_c")).otherwise(0)).alias("n_outliers"))
    return fences.join(counts, group)


def zscore_outliers(df: DataFrame, group: str, value: str, z: float = 3.0) -> DataFrame:
    """Per group count of rows with |x - mean| / sd > z."""
    x = _num(value)
    m = df.groupBy(group).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    values = df.groupBy(group, x.alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    out = F.abs(F.col("_x") - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0)) > z
    return join_groups(values, m, group).groupBy(group).agg(
        F.sum(F.when(out, F.col("_c")).otherwise(0)).alias("n_outliers"), F.sum("_c").alias("n"))


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Equal-width bins over [min, max]; the max lands in the last bin.

    min and max are scalar subqueries of one aggregate; bin counting is a
    partial aggregate. Empty bins are emitted (calendar of bin ids).
    """
    x = _num(value)
    rng = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    lo = rng.select("lo").scalar()
    hi = rng.select("hi").scalar()
    width = (hi - lo) / F.lit(float(bins))
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((x - lo) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).cast("int")
    counts = df.filter(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = rng.filter(F.col("lo").isNotNull()).select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counts, "bin", "left").select(
        "bin", (lo + F.col("bin") * width).alias("bin_lo"), (lo + (F.col("bin") + 1) * width).alias("bin_hi"),
        F.coalesce("n", F.lit(0)).alias("n"))
    return out


def regression_line(df: DataFrame, y: str, x: str) -> DataFrame:
    """Least-squares line y ~ x (slope, intercept, R^2, n)."""
    yy, xx = _num(y), _num(x)
    return df.agg(F.regr_slope(yy, xx).alias("slope"), F.regr_intercept(yy, xx).alias("intercept"),
                  F.regr_r2(yy, xx).alias("r2"), F.regr_count(yy, xx).alias("n"))


def frequency_table(df: DataFrame, column: str) -> DataFrame:
    """Count and share per value; the total is a scalar subquery."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("share", F.col("n") / total)


def ks_normal(df: DataFrame, value: str) -> DataFrame:
    """One-sample Kolmogorov-Smirnov test against a normal with the sample's mean and deviation:
    n, statistic, p (one row; NULL for a constant or empty column).

    The empirical distribution comes from the counts and ranks of the distinct values, range by
    range, and the statistic is the largest gap on either side of a step. p is the limiting
    distribution at (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * statistic.
    """
    x = _num(value)
    moments = df.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.count(x).alias("n"))
    m, s, n = (moments.select(c).scalar() for c in ("m", "s", "n"))
    steps = value_ranks(df.select(x.alias("_x")), "_x").withColumn("f", normal_cdf((F.col("_x") - m) / F.nullif(s, F.lit(0.0))))
    gap = F.greatest((F.col("rank") - 1 + F.col("cnt")) / n - F.col("f"), F.col("f") - (F.col("rank") - 1) / n)
    top = steps.agg(n.alias("n"), F.max(gap).alias("statistic"))
    root = F.sqrt(F.col("n").cast("double"))
    return top.select("n", "statistic", kolmogorov_tail((root + 0.12 + 0.11 / root) * F.col("statistic")).alias("p"))


def ks_normal_ml(df: DataFrame, value: str) -> DataFrame:
    """T9 (Spark ML form): ``KolmogorovSmirnovTest`` against the same normal."""
    from pyspark.ml.stat import KolmogorovSmirnovTest
    x = _num(value)
    m = df.agg(F.avg(x), F.stddev_samp(x)).first()
    res = KolmogorovSmirnovTest.test(df.select(x.alias("_x")).filter("_x IS NOT NULL"), "_x", "norm",
                                     float(m[0]), float(m[1])).first()
    return df.sparkSession.createDataFrame([(float(res.statistic), float(res.pValue))], "statistic double, p double")


def chi_square_ml(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """T7 (Spark ML form): ChiSquareTest of each categorical feature
    against the label; one row per feature with statistic, dof and p."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import ChiSquareTest
    va = VectorAssembler(inputCols=features, outputCol="_f")
    r = ChiSquareTest.test(va.transform(df.select(*[F.col(c).cast("double") for c in features],
                                                  F.col(label).cast("double").alias(label))), "_f", label).first()
    rows = [(f, float(r.statistics[i]), int(r.degreesOfFreedom[i]), float(r.pValues[i])) for i, f in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "feature string, statistic double, dof int, p double")


def correlation_matrix_ml(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """T4/T5 (Spark ML form): ``Correlation.corr`` on an assembled vector, long form. By its
    definition rows with a NULL in any of the columns are left out; ``correlation_matrix`` uses
    every pair's complete rows. ``spearman`` is Pearson on the columns' tie-averaged ranks: these come
    from the counts of the distinct values, so that no column's rows are sorted."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation
    rows = df.select(*[_num(c).alias(c) for c in columns])
    if method == "spearman":
        rows, method = _average_ranks(rows.dropna(), columns), "pearson"
    va = VectorAssembler(inputCols=columns, outputCol="_f", handleInvalid="skip")
    mat = Correlation.corr(va.transform(rows), "_f", method).first()[0]
    arr = mat.toArray()
    rows = [(a, b, float(arr[i][j])) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, r double")
