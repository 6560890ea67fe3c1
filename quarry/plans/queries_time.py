"""Registered queries: time series and windows (W*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.columns import round_doubles
from quarry.operators import timeseries as W
from quarry.plans.catalog import T, query
from quarry.plans.prefix import global_row_number, running_sum, value_ranks


def orders_daily(spark, sf):
    return W.resample(T(spark, sf, "orders"), "o_orderdate", "o_totalprice", "day")


def events_daily(spark, sf, how="count"):
    return W.resample(T(spark, sf, "events"), "ts", "value", "day", key="event_type", how=how)


ORD_DAILY_SQL = "SELECT 'all' AS key, CAST(o_orderdate AS DATE) AS t, sum(o_totalprice) AS y FROM orders GROUP BY 2"
EV_COUNT_SQL = "SELECT event_type AS key, CAST(ts AS DATE) AS t, count(*) AS y FROM events GROUP BY 1, 2"
EV_SUM_SQL = "SELECT event_type AS key, CAST(ts AS DATE) AS t, sum(value) AS y FROM events GROUP BY 1, 2"


@query("w1_cumulative_daily", sql=f"""
SELECT key, t, round(y, 2) AS y, round(sum(y) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING), 2) AS cum
FROM ({ORD_DAILY_SQL})""")
def q_w1(spark, sf):
    """Daily totals, then a distributed running sum over the days."""
    s = orders_daily(spark, sf)
    return round_doubles(running_sum(s, ["t"], "y", "cum"), 2)


@query("w1_cumulative_keyed", sql=f"""
SELECT key, t, y, CAST(sum(y) OVER (PARTITION BY key ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
FROM ({EV_COUNT_SQL})""")
def q_w1k(spark, sf):
    return W.cumulative(events_daily(spark, sf))


@query("w1_cumulative_rows", sql="""
SELECT o_orderkey, o_orderdate, round(sum(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS cum
FROM orders""")
def q_w1r(spark, sf):
    """Row-level running total of order value in (date, key) order
    (range-partitioned prefix sum, no single-partition window)."""
    o = T(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return round_doubles(W.cumulative_rows(o, ["o_orderdate", "o_orderkey"], "o_totalprice"), 2).drop("o_totalprice")


@query("w2_rolling", sql=f"""
SELECT key, t, round(y, 6) AS y,
  CASE WHEN count(y) OVER w = 7 THEN round(avg(y) OVER w, 6) END AS roll_mean,
  CASE WHEN count(y) OVER w = 7 THEN round(sum(y) OVER w, 6) END AS roll_sum,
  CASE WHEN count(y) OVER w = 7 THEN round(stddev_samp(y) OVER w, 6) END AS roll_std
FROM ({EV_SUM_SQL}) WINDOW w AS (PARTITION BY key ORDER BY t ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def q_w2(spark, sf):
    return round_doubles(W.rolling(events_daily(spark, sf, "sum"), 7))


@query("w3_rolling_span", sql="""
WITH s AS (SELECT event_type AS key, date_trunc('hour', ts) AS t, count(*) AS y FROM events GROUP BY 1, 2)
SELECT key, t, y, CAST(sum(y) OVER w AS BIGINT) AS span_sum, count(y) OVER w AS span_n, round(avg(y) OVER w, 6) AS span_mean
FROM s WINDOW w AS (PARTITION BY key ORDER BY CAST(epoch(t) AS BIGINT) RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW)""")
def q_w3(spark, sf):
    """24-hour rolling count over an hourly series with missing hours."""
    ev = T(spark, sf, "events")
    from quarry.functions.columns import ntz_floor
    hourly = ev.groupBy(F.col("event_type").alias("key"),
                        ntz_floor("ts", 3600).alias("t")).agg(F.count(F.lit(1)).alias("y"))
    return round_doubles(W.rolling_span(hourly, 86400))


MONTHLY_SQL = ("SELECT 'all' AS key, CAST(date_trunc('month', o_orderdate) AS DATE) AS t, sum(o_totalprice) AS y "
               "FROM orders GROUP BY 2")


@query("w4_lag_diff", sql=f"""
SELECT key, t, round(y, 2) AS y, round(lag(y) OVER (ORDER BY t), 2) AS prev, round(y - lag(y) OVER (ORDER BY t), 2) AS diff
FROM ({MONTHLY_SQL})""")
def q_w4(spark, sf):
    s = W.resample(T(spark, sf, "orders"), "o_orderdate", "o_totalprice", "month")
    return round_doubles(W.lag_diff(s), 2)


@query("w5_growth", sql=f"""
WITH s AS ({MONTHLY_SQL})
SELECT s.key, s.t, round(s.y, 2) AS y,
  round(CASE WHEN p1.y = 0 THEN NULL ELSE (s.y - p1.y) / p1.y END, 6) AS mom,
  round(CASE WHEN p12.y = 0 THEN NULL ELSE (s.y - p12.y) / p12.y END, 6) AS yoy
FROM s LEFT JOIN s p1 ON p1.key = s.key AND CAST(p1.t + INTERVAL 1 MONTH AS DATE) = s.t
LEFT JOIN s p12 ON p12.key = s.key AND CAST(p12.t + INTERVAL 12 MONTH AS DATE) = s.t""")
def q_w5(spark, sf):
    s = W.resample(T(spark, sf, "orders"), "o_orderdate", "o_totalprice", "month")
    mom = W.growth(s, 1, "mom")
    yoy = W.growth(s, 12, "yoy").select("key", "t", "yoy")
    out = mom.join(yoy, ["key", "t"])
    return round_doubles(out.select("key", "t", F.round("y", 2).alias("y"), "mom", "yoy"))


@query("w6_resample_all_grains", sql="""
SELECT grain, t, round(sum(o_totalprice), 2) AS y, count(*) AS n FROM (
  SELECT 'day' AS grain, CAST(o_orderdate AS DATE) AS t, o_totalprice FROM orders
  UNION ALL SELECT 'week', CAST(date_trunc('week', o_orderdate) AS DATE), o_totalprice FROM orders
  UNION ALL SELECT 'month', CAST(date_trunc('month', o_orderdate) AS DATE), o_totalprice FROM orders
  UNION ALL SELECT 'quarter', CAST(date_trunc('quarter', o_orderdate) AS DATE), o_totalprice FROM orders
  UNION ALL SELECT 'year', CAST(date_trunc('year', o_orderdate) AS DATE), o_totalprice FROM orders)
GROUP BY 1, 2""")
def q_w6(spark, sf):
    """All five grains in one scan: each row fans out to its five periods
    and one partial aggregate collapses them."""
    o = T(spark, sf, "orders").select("o_orderdate", "o_totalprice")
    fan = o.select(F.explode(F.array(*[F.struct(F.lit(g).alias("grain"), W.period_start(F.col("o_orderdate"), g).alias("t"))
                                       for g in W.GRAINS])).alias("p"), "o_totalprice")
    g = fan.groupBy("p.grain", "p.t").agg(F.round(F.sum("o_totalprice"), 2).alias("y"), F.count(F.lit(1)).alias("n"))
    return g


@query("w7_gap_fill", sql=f"""
WITH s AS ({ORD_DAILY_SQL}),
cal AS (SELECT 'all' AS key, CAST(unnest(generate_series(min(t), max(t), INTERVAL 1 DAY)) AS DATE) AS t FROM s)
SELECT cal.key, cal.t, round(last_value(s.y IGNORE NULLS) OVER (ORDER BY cal.t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS y,
       s.y IS NULL AS filled
FROM cal LEFT JOIN s ON cal.t = s.t""")
def q_w7(spark, sf):
    return round_doubles(W.gap_fill(orders_daily(spark, sf)), 2)


@query("w8_trend", sql=f"""
SELECT key, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, count(y) AS n,
  CASE WHEN regr_slope(y, x) > 0 THEN 'increasing' WHEN regr_slope(y, x) < 0 THEN 'decreasing' ELSE 'flat' END AS direction
FROM (SELECT key, y, CAST(datediff('day', DATE '1970-01-01', t) AS DOUBLE) AS x FROM ({EV_COUNT_SQL})) GROUP BY key""")
def q_w8(spark, sf):
    return round_doubles(W.trend(events_daily(spark, sf)))


@query("w9_decomposition", sql=f"""
WITH s AS ({ORD_DAILY_SQL}),
cal AS (SELECT 'all' AS key, CAST(unnest(generate_series(min(t), max(t), INTERVAL 1 DAY)) AS DATE) AS t FROM s),
f AS (SELECT cal.key, cal.t, coalesce(s.y, 0) AS y FROM cal LEFT JOIN s ON cal.t = s.t),
b AS (SELECT key, t, y, CASE WHEN count(y) OVER w = 7 THEN avg(y) OVER w END AS trend, isodow(t) - 1 AS phase
      FROM f WINDOW w AS (PARTITION BY key ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
r AS (SELECT key, phase, avg(y - trend) AS s FROM b GROUP BY 1, 2),
c AS (SELECT key, phase, s - avg(s) OVER (PARTITION BY key) AS seasonal FROM r)
SELECT b.key, b.t, round(b.y, 2) AS y, round(trend, 2) AS trend, round(seasonal, 2) AS seasonal,
       round(b.y - trend - seasonal, 2) AS resid FROM b LEFT JOIN c ON b.key = c.key AND b.phase = c.phase""")
def q_w9(spark, sf):
    s = W.gap_fill(orders_daily(spark, sf), fill="zero").select("key", "t", "y")
    return round_doubles(W.decompose(s, 7), 2)


@query("w10_seasonality_weekday", sql="""
SELECT isodow(ts) - 1 AS weekday, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1""")
def q_w10(spark, sf):
    return round_doubles(W.seasonality_profile(T(spark, sf, "events"), "ts", "value", "weekday"))


@query("w10_seasonality_hour", sql="""
SELECT hour(ts) AS hour, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1""")
def q_w10h(spark, sf):
    return round_doubles(W.seasonality_profile(T(spark, sf, "events"), "ts", "value", "hour"))


def _acf_sql(k: int) -> str:
    lags = ", ".join(f"lag(d, {i}) OVER (PARTITION BY key ORDER BY t) AS l{i}" for i in range(1, k + 1))
    parts = " UNION ALL ".join(
        f"SELECT key, {i} AS lag, round(sum(d * l{i}) / nullif(sum(d * d), 0), 6) AS acf FROM l GROUP BY key"
        for i in range(1, k + 1))
    return f"""
WITH s AS ({EV_COUNT_SQL}), d AS (SELECT key, t, y - avg(y) OVER (PARTITION BY key) AS d FROM s),
l AS (SELECT key, d, {lags} FROM d) {parts}"""


@query("w11_autocorrelation", sql=_acf_sql(7))
def q_w11(spark, sf):
    return round_doubles(W.autocorrelation(events_daily(spark, sf), 7))


@query("w12_dickey_fuller", sql=f"""
WITH s AS ({EV_COUNT_SQL}),
d AS (SELECT key, CAST(lag(y) OVER (PARTITION BY key ORDER BY t) AS DOUBLE) AS ylag,
             CAST(y AS DOUBLE) - lag(y) OVER (PARTITION BY key ORDER BY t) AS dy FROM s),
g AS (SELECT key, regr_slope(dy, ylag) AS b, regr_r2(dy, ylag) AS r2, regr_syy(dy, ylag) AS syy,
             regr_sxx(dy, ylag) AS sxx, CAST(regr_count(dy, ylag) AS BIGINT) AS n FROM d GROUP BY key)
SELECT key, n, round(b, 6) AS b, round(b / nullif(sqrt((1 - r2) * syy / (n - 2) / sxx), 0), 6) AS df_t FROM g""")
def q_w12(spark, sf):
    return round_doubles(W.dickey_fuller(events_daily(spark, sf)))


@query("w13_forecast_linear", sql=f"""
WITH s AS ({EV_COUNT_SQL}),
g AS (SELECT key, regr_slope(y, CAST(datediff('day', DATE '1970-01-01', t) AS DOUBLE)) AS b,
             regr_intercept(y, CAST(datediff('day', DATE '1970-01-01', t) AS DOUBLE)) AS a, max(t) AS last FROM s GROUP BY key),
h AS (SELECT key, a, b, last, unnest(range(1, 8)) AS step FROM g)
SELECT key, CAST(step AS INTEGER) AS step, CAST(last + CAST(step AS INTEGER) AS DATE) AS t,
       round(a + b * datediff('day', DATE '1970-01-01', CAST(last + CAST(step AS INTEGER) AS DATE)), 6) AS forecast FROM h""")
def q_w13a(spark, sf):
    return round_doubles(W.forecast_linear(events_daily(spark, sf), 7))


@query("w13_forecast_seasonal_naive", sql=f"""
WITH s AS ({EV_COUNT_SQL}),
h AS (SELECT key, max(t) AS last FROM s GROUP BY key),
f AS (SELECT key, CAST(step AS INTEGER) AS step, CAST(last + CAST(step AS INTEGER) AS DATE) AS t FROM (SELECT key, last, unnest(range(1, 8)) AS step FROM h))
SELECT f.key, f.step, f.t, s.y AS forecast FROM f LEFT JOIN s ON s.key = f.key
  AND s.t = CAST(f.t - CAST(ceil(f.step / 7.0) * 7 AS INTEGER) AS DATE)""")
def q_w13b(spark, sf):
    return W.forecast_seasonal_naive(events_daily(spark, sf), 7, 7)


@query("w13_forecast_ses", sql=f"""
WITH s AS (SELECT key, t, y, row_number() OVER (PARTITION BY key ORDER BY t) AS i, count(*) OVER (PARTITION BY key) AS n
           FROM ({EV_COUNT_SQL})),
l AS (SELECT key, sum(CASE WHEN i = 1 THEN pow(0.7, n - 1) ELSE 0.3 * pow(0.7, n - i) END * y) AS level, max(t) AS last
      FROM s GROUP BY key)
SELECT key, CAST(step AS INTEGER) AS step, CAST(last + CAST(step AS INTEGER) AS DATE) AS t, round(level, 6) AS forecast
FROM (SELECT key, level, last, unnest(range(1, 8)) AS step FROM l)""")
def q_w13c(spark, sf):
    return round_doubles(W.forecast_ses(events_daily(spark, sf), 0.3, 7))


@query("w13_ar1_fit", sql=f"""
WITH s AS ({EV_COUNT_SQL}),
d AS (SELECT key, CAST(y AS DOUBLE) AS y, CAST(lag(y) OVER (PARTITION BY key ORDER BY t) AS DOUBLE) AS ylag FROM s)
SELECT key, round(regr_intercept(y, ylag), 6) AS c, round(regr_slope(y, ylag), 6) AS phi FROM d GROUP BY key""")
def q_w13d(spark, sf):
    """AR(1) by least squares in SQL form (regr over the lagged series)."""
    from pyspark.sql import Window
    s = events_daily(spark, sf)
    d = s.select("key", F.col("y").cast("double").alias("y"),
                 F.lag("y").over(Window.partitionBy("key").orderBy("t")).cast("double").alias("ylag"))
    return round_doubles(d.groupBy("key").agg(F.regr_intercept("y", "ylag").alias("c"),
                                               F.regr_slope("y", "ylag").alias("phi")))


# AR(3) by the inverse of the lags' 3 x 3 covariances (Cramer's rule)
AR3_SQL = f"""
WITH s AS ({EV_COUNT_SQL}),
d AS (SELECT key, t, CAST(y AS DOUBLE) AS y, CAST(lag(y, 1) OVER o AS DOUBLE) AS a, CAST(lag(y, 2) OVER o AS DOUBLE) AS b,
        CAST(lag(y, 3) OVER o AS DOUBLE) AS c FROM s WINDOW o AS (PARTITION BY key ORDER BY t)),
m AS (SELECT key, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc,
        covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, b) AS bb, covar_pop(b, c) AS bc,
        covar_pop(c, c) AS cc, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, covar_pop(c, y) AS cy
      FROM d WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL GROUP BY key),
e AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM m),
f AS (SELECT *, (ay * (bb * cc - bc * bc) - ab * (by_ * cc - bc * cy) + ac * (by_ * bc - bb * cy)) / det AS phi1,
        (aa * (by_ * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - by_ * ac)) / det AS phi2,
        (aa * (bb * cy - by_ * bc) - ab * (ab * cy - by_ * ac) + ay * (ab * bc - bb * ac)) / det AS phi3 FROM e),
fit AS (SELECT key, n, my - phi1 * ma - phi2 * mb - phi3 * mc AS c, phi1, phi2, phi3 FROM f WHERE n > 4)
"""


@query("w13_arp_fit", sql=AR3_SQL + """SELECT key, n, round(c, 6) AS c, round(phi1, 6) AS phi1, round(phi2, 6) AS phi2,
  round(phi3, 6) AS phi3 FROM fit""")
def q_w13p(spark, sf):
    """AR(3) per key from one window and one aggregate."""
    fit = W.ar_fit(events_daily(spark, sf), 3)
    return round_doubles(fit.select("key", "n", *[F.get(F.col("coef"), F.lit(k)).alias(c)
                                                  for k, c in enumerate(["c", "phi1", "phi2", "phi3"])]))


@query("w13_forecast_ar", sql=AR3_SQL + """,
last AS (SELECT key, t, y, a, b FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t DESC) AS r FROM d) WHERE r = 1),
f1 AS (SELECT l.*, fit.* EXCLUDE (key), fit.c + phi1 * y + phi2 * a + phi3 * b AS s1 FROM last l JOIN fit USING (key)),
f2 AS (SELECT *, c + phi1 * s1 + phi2 * y + phi3 * a AS s2 FROM f1),
f3 AS (SELECT *, c + phi1 * s2 + phi2 * s1 + phi3 * y AS s3 FROM f2),
f4 AS (SELECT *, c + phi1 * s3 + phi2 * s2 + phi3 * s1 AS s4 FROM f3),
f5 AS (SELECT *, c + phi1 * s4 + phi2 * s3 + phi3 * s2 AS s5 FROM f4),
st AS (SELECT key, t, unnest([1, 2, 3, 4, 5]) AS step, unnest([s1, s2, s3, s4, s5]) AS forecast FROM f5)
SELECT key, CAST(step AS INTEGER) AS step, CAST(t + CAST(step AS INTEGER) AS DATE) AS t, round(forecast, 6) AS forecast FROM st""")
def q_w13far(spark, sf):
    return round_doubles(W.forecast_ar(events_daily(spark, sf), 3, 5))


@query("w14_peak_trough", sql=f"""
WITH s AS ({EV_SUM_SQL})
SELECT key, first(t ORDER BY y DESC, t) AS peak_t, round(max(y), 6) AS peak_y, first(t ORDER BY y ASC, t) AS trough_t,
       round(min(y), 6) AS trough_y FROM s WHERE y IS NOT NULL GROUP BY key""")
def q_w14(spark, sf):
    return round_doubles(W.peak_trough(events_daily(spark, sf, "sum")))


@query("w15_rank_within_group", sql="""
SELECT c_custkey, c_nationkey, c_acctbal,
  rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS rank,
  dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS dense_rank,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS row_number,
  ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS quartile
FROM customer""")
def q_w15(spark, sf):
    c = T(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return W.rank_within(c, "c_nationkey", "c_acctbal", "c_custkey")


@query("w15_global_rank", sql="""
SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice) AS rank, dense_rank() OVER (ORDER BY o_totalprice) AS dense_rank,
       row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_number FROM orders WHERE o_totalprice IS NOT NULL""")
def q_w15g(spark, sf):
    """Global ranks without a single-partition window: per-value counts and
    range-partitioned prefix sums, joined back on the value."""
    o = T(spark, sf, "orders").select("o_orderkey", "o_totalprice").filter("o_totalprice IS NOT NULL")
    ranks = value_ranks(o, "o_totalprice").select("o_totalprice", "rank", "dense_rank")
    rn = global_row_number(o, ["o_totalprice", "o_orderkey"])
    return rn.join(ranks, "o_totalprice").select("o_orderkey", "rank", "dense_rank", "row_number")
