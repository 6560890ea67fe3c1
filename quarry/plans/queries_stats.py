"""Registered queries: statistics (T*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import distributions as D
from quarry.functions.columns import round_doubles
from quarry.operators import stats as S
from quarry.plans.catalog import ORACLE, T, query

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql(table: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS "min", round(quantile_cont({c}, 0.25), 6) AS q25,
  round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS "max",
  round(skewness({c}), 6) AS skewness, round(kurtosis({c}), 6) AS kurtosis FROM {table}""")
    return "\nUNION ALL\n".join(parts)


@query("t1_describe", bench=True, sql=_describe_sql("lineitem", LI_NUM))
def q_t1(spark, sf):
    return round_doubles(S.describe(T(spark, sf, "lineitem"), LI_NUM))


def _corr_sql(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


@query("t2_pearson", sql=f"SELECT round({_corr_sql('l_quantity', 'l_extendedprice')}, 6) AS r FROM lineitem")
def q_t2(spark, sf):
    return round_doubles(S.pearson(T(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"))


@query("t2_pearson_constant_groups", sql=f"""
SELECT l_discount, round({_corr_sql('l_quantity', 'l_discount')}, 6) AS r FROM lineitem GROUP BY l_discount""")
def q_t2c(spark, sf):
    """Within a discount group the discount is constant: r must be NULL, not an error."""
    from quarry.functions.columns import safe_corr
    return round_doubles(T(spark, sf, "lineitem").groupBy("l_discount")
                         .agg(safe_corr("l_quantity", "l_discount").alias("r")))


@query("t3_day_of_month_corr", sql=f"""
SELECT round({_corr_sql('dayofmonth(o_orderdate)', 'o_totalprice')}, 6) AS r FROM orders""")
def q_t3(spark, sf):
    return round_doubles(S.pearson(T(spark, sf, "orders"), F.dayofmonth("o_orderdate"), F.col("o_totalprice")))


def _matrix_sql(table: str, cols: list[str]) -> str:
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round({_corr_sql(a, b)}, 6) AS r FROM {table}")
    return "\nUNION ALL\n".join(parts)


@query("t4_corr_matrix", sql=_matrix_sql("lineitem", LI_NUM))
def q_t4(spark, sf):
    return round_doubles(S.correlation_matrix(T(spark, sf, "lineitem"), LI_NUM))


@query("t4_strongest_pair", sql=f"""
SELECT * FROM ({_matrix_sql('lineitem', LI_NUM)}) WHERE r IS NOT NULL ORDER BY abs(r) DESC, col_a, col_b LIMIT 1""")
def q_t4s(spark, sf):
    return round_doubles(S.strongest_pair(S.correlation_matrix(T(spark, sf, "lineitem"), LI_NUM)))


@query("t5_spearman", sql=f"""
WITH p AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
             rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM p)
SELECT round({_corr_sql('rx', 'ry')}, 6) AS rho FROM r""")
def q_t5(spark, sf):
    return round_doubles(S.spearman(T(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"))


@query("t6_ttest_one_sample", sql="""
SELECT round((avg(l_quantity) - 25) / (stddev_samp(l_quantity) / sqrt(count(l_quantity))), 6) AS t,
       CAST(count(l_quantity) - 1 AS DOUBLE) AS df FROM lineitem""")
def q_t6a(spark, sf):
    return round_doubles(S.t_test_one_sample(T(spark, sf, "lineitem"), "l_quantity", 25.0))


@query("t6_ttest_two_sample", sql="""
WITH g AS (SELECT
  CAST(count(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING') AS DOUBLE) AS n1,
  CAST(count(c_acctbal) FILTER (WHERE c_mktsegment = 'MACHINERY') AS DOUBLE) AS n2,
  avg(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING') AS m1,
  avg(c_acctbal) FILTER (WHERE c_mktsegment = 'MACHINERY') AS m2,
  var_samp(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING') AS v1,
  var_samp(c_acctbal) FILTER (WHERE c_mktsegment = 'MACHINERY') AS v2 FROM customer)
SELECT round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 6) AS t_pooled,
       round(n1 + n2 - 2, 6) AS df_pooled,
       round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t_welch,
       round((v1 / n1 + v2 / n2) * (v1 / n1 + v2 / n2) / ((v1 / n1) * (v1 / n1) / (n1 - 1) + (v2 / n2) * (v2 / n2) / (n2 - 1)), 6) AS df_welch
FROM g""")
def q_t6b(spark, sf):
    return round_doubles(S.t_test_two_sample(T(spark, sf, "customer"), "c_mktsegment", "c_acctbal",
                                             "BUILDING", "MACHINERY"))


def _p_sql(name: str, **p: str) -> str:
    """The registered twin of a test with p-values of its (rounded) statistics."""
    return "SELECT *, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in p.items()) + f" FROM ({ORACLE[name]})"


@query("t6_ttest_pvalues", sql=_p_sql(
    "t6_ttest_two_sample", p_pooled=D.f_pvalue_sql("t_pooled * t_pooled", "1", "df_pooled"),
    p_welch=D.f_pvalue_sql("t_welch * t_welch", "1", "df_welch")))
def q_t6p(spark, sf):
    """p-values of the two-sample tests."""
    t = round_doubles(S.t_test_two_sample(T(spark, sf, "customer"), "c_mktsegment", "c_acctbal", "BUILDING", "MACHINERY"))
    return round_doubles(t.select("*", D.t_pvalue(F.col("t_pooled"), F.col("df_pooled")).alias("p_pooled"),
                                  D.t_pvalue(F.col("t_welch"), F.col("df_welch")).alias("p_welch")))


def _chi_sql(table: str, a: str, b: str) -> str:
    return f"""
WITH ct AS (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
ra AS (SELECT a, sum(o) AS ra FROM ct GROUP BY a), cb AS (SELECT b, sum(o) AS cb FROM ct GROUP BY b),
n AS (SELECT sum(o) AS n FROM ct)
SELECT round(sum(o * o / (ra * cb / n)) - any_value(n), 6) AS chi2,
       CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS BIGINT) AS dof
FROM ct JOIN ra USING (a) JOIN cb USING (b), n"""


@query("t7_chi_square_labels", sql=_chi_sql("labels", "quality", "toxic"))
def q_t7(spark, sf):
    return round_doubles(S.chi_square(T(spark, sf, "labels"), "quality", "toxic"))


@query("t7_chi_square_orders", sql=_chi_sql("orders", "o_orderstatus", "o_orderpriority"))
def q_t7b(spark, sf):
    return round_doubles(S.chi_square(T(spark, sf, "orders"), "o_orderstatus", "o_orderpriority"))


@query("t7_chi_square_pvalue", sql=_p_sql("t7_chi_square_orders", p=D.chi2_pvalue_sql("chi2", "dof")))
def q_t7p(spark, sf):
    c = round_doubles(S.chi_square(T(spark, sf, "orders"), "o_orderstatus", "o_orderpriority"))
    return round_doubles(c.select("*", D.chi2_pvalue(F.col("chi2"), F.col("dof")).alias("p")))


@query("t8_anova", sql="""
WITH g AS (SELECT c_mktsegment, count(c_acctbal) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v
           FROM customer WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL GROUP BY 1),
t AS (SELECT sum(n * m) / sum(n) AS grand FROM g),
s AS (SELECT sum(n * (m - grand) * (m - grand)) AS ssb, sum((n - 1) * coalesce(v, 0)) AS ssw,
             count(*) AS k, sum(n) AS n FROM g, t)
SELECT round(ssb / (k - 1) / (ssw / (n - k)), 6) AS f, CAST(k - 1 AS BIGINT) AS df_between,
       CAST(n - k AS BIGINT) AS df_within, round(ssb, 6) AS ssb, round(ssw, 6) AS ssw FROM s""")
def q_t8(spark, sf):
    return round_doubles(S.anova_oneway(T(spark, sf, "customer"), "c_mktsegment", "c_acctbal"))


@query("t8_anova_pvalue", sql="SELECT f, df_between, df_within, p FROM ("
       + _p_sql("t8_anova", p=D.f_pvalue_sql("f", "df_between", "df_within")) + ")")
def q_t8p(spark, sf):
    a = round_doubles(S.anova_oneway(T(spark, sf, "customer"), "c_mktsegment", "c_acctbal"))
    return round_doubles(a.select("f", "df_between", "df_within",
                                  D.f_pvalue(F.col("f"), F.col("df_between"), F.col("df_within")).alias("p")))


@query("t9_jarque_bera", sql="""
WITH m AS (SELECT avg(o_totalprice) AS mu, count(o_totalprice) AS n FROM orders),
c AS (SELECT any_value(n) AS n, avg(power(o_totalprice - mu, 2)) AS m2, avg(power(o_totalprice - mu, 3)) AS m3,
             avg(power(o_totalprice - mu, 4)) AS m4 FROM orders, m WHERE o_totalprice IS NOT NULL)
SELECT n, round(m3 / power(m2, 1.5), 6) AS s, round(m4 / (m2 * m2) - 3, 6) AS k,
       round(n / 6.0 * (power(m3 / power(m2, 1.5), 2) + power(m4 / (m2 * m2) - 3, 2) / 4), 6) AS jb FROM c""")
def q_t9(spark, sf):
    return round_doubles(S.jarque_bera(T(spark, sf, "orders"), "o_totalprice"))


@query("t10_confidence_interval", sql="""
SELECT count(l_extendedprice) AS n, round(avg(l_extendedprice), 6) AS mean,
  round(avg(l_extendedprice) - 1.96 * stddev_samp(l_extendedprice) / sqrt(count(l_extendedprice)), 6) AS lo,
  round(avg(l_extendedprice) + 1.96 * stddev_samp(l_extendedprice) / sqrt(count(l_extendedprice)), 6) AS hi FROM lineitem""")
def q_t10(spark, sf):
    return round_doubles(S.mean_confidence_interval(T(spark, sf, "lineitem"), "l_extendedprice"))


@query("t11_iqr_outliers", sql="""
WITH q AS (SELECT event_type, quantile_cont(value, 0.0) AS "min", quantile_cont(value, 0.25) AS q1,
  quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 1.0) AS "max"
  FROM events GROUP BY 1),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT f.event_type, round("min", 6) AS "min", round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round("max", 6) AS "max", round(lo, 6) AS lo, round(hi, 6) AS hi,
  count(*) FILTER (WHERE e.value < lo OR e.value > hi) AS n_outliers
FROM f JOIN events e USING (event_type) GROUP BY ALL""")
def q_t11(spark, sf):
    return round_doubles(S.iqr_outliers(T(spark, sf, "events"), "event_type", "value"))


@query("t12_zscore_outliers", sql="""
WITH m AS (SELECT event_type, avg(value) AS mean, stddev_samp(value) AS sd FROM events GROUP BY 1)
SELECT event_type, count(*) FILTER (WHERE abs(value - mean) / nullif(sd, 0) > 2.5) AS n_outliers, count(*) AS n
FROM events JOIN m USING (event_type) GROUP BY 1""")
def q_t12(spark, sf):
    return S.zscore_outliers(T(spark, sf, "events"), "event_type", "value", z=2.5)


@query("t13_histogram", sql="""
WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
b AS (SELECT CAST(CASE WHEN (hi - lo) / 20.0 = 0 THEN 0 ELSE least(floor((o_totalprice - lo) / ((hi - lo) / 20.0)), 19) END AS INTEGER) AS bin
      FROM orders, r WHERE o_totalprice IS NOT NULL),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin),
g AS (SELECT CAST(unnest(range(0, 20)) AS INTEGER) AS bin)
SELECT g.bin, round(lo + g.bin * ((hi - lo) / 20.0), 6) AS bin_lo, round(lo + (g.bin + 1) * ((hi - lo) / 20.0), 6) AS bin_hi,
       coalesce(n, 0) AS n FROM g CROSS JOIN r LEFT JOIN c ON g.bin = c.bin""")
def q_t13(spark, sf):
    return round_doubles(S.histogram(T(spark, sf, "orders"), "o_totalprice", 20))


@query("t14_regression_line", sql="""
SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept,
       round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem""")
def q_t14(spark, sf):
    return round_doubles(S.regression_line(T(spark, sf, "lineitem"), "l_extendedprice", "l_quantity"))


@query("t15_frequency_share", sql="""
SELECT c_mktsegment, count(*) AS n, round(count(*) / (SELECT count(*) FROM customer), 6) AS share FROM customer GROUP BY 1""")
def q_t15(spark, sf):
    return round_doubles(S.frequency_table(T(spark, sf, "customer"), "c_mktsegment"))


@query("t9_ks_normal", sql=f"""
WITH m AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s, count(o_totalprice) AS n FROM orders),
v AS (SELECT o_totalprice AS x, count(*) AS cnt, (o_totalprice - any_value(m)) / any_value(s) AS z FROM orders, m GROUP BY 1),
c AS (SELECT cnt, z, sum(cnt) OVER (ORDER BY x) AS cum FROM v),
f AS (SELECT cnt, cum, {D.normal_cdf_sql("z")} AS f FROM c),
d AS (SELECT any_value(n) AS n, max(greatest(cum / CAST(n AS DOUBLE) - f, f - (cum - cnt) / CAST(n AS DOUBLE))) AS statistic FROM f, m),
x AS (SELECT *, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * statistic AS x FROM d)
SELECT n, round(statistic, 6) AS statistic, round({D.kolmogorov_tail_sql("x")}, 12) AS p FROM x""")
def q_t9ks(spark, sf):
    """Kolmogorov-Smirnov normality test of order totals."""
    r = S.ks_normal(T(spark, sf, "orders"), "o_totalprice")
    return round_doubles(r.drop("p")).join(r.select("n", F.round("p", 12).alias("p")), "n")


@query("t7_chi_square_ml")
def q_t7ml(spark, sf):
    """ChiSquareTest of quality against toxicity (Spark ML)."""
    return round_doubles(S.chi_square_ml(T(spark, sf, "labels"), ["quality"], "toxic"))


@query("t5_spearman_matrix", sql=f"""
WITH p AS (SELECT l_quantity AS a, l_discount AS b, l_tax AS c FROM lineitem
           WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL),
r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra,
             rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb,
             rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0 AS rc FROM p)
SELECT 'l_quantity' AS col_a, 'l_discount' AS col_b, round({_corr_sql('ra', 'rb')}, 6) AS r FROM r
UNION ALL SELECT 'l_quantity', 'l_tax', round({_corr_sql('ra', 'rc')}, 6) FROM r
UNION ALL SELECT 'l_discount', 'l_tax', round({_corr_sql('rb', 'rc')}, 6) FROM r""")
def q_t5m(spark, sf):
    """Spearman matrix for the wide case: Spark ML Correlation (Gram matrix)."""
    return round_doubles(S.correlation_matrix_ml(T(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"],
                                                 "spearman"))
