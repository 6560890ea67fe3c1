"""Registered queries: chart tables (C*), run-log metrics (O6) and streams (V*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.columns import round_doubles
from quarry.operators import answers as O
from quarry.operators import charts as C
from quarry.operators import graph as G
from quarry.operators import stats as S
from quarry.operators import timeseries as W
from quarry.plans import fixtures as FX
from quarry.plans.catalog import T, query
from quarry.plans.queries_graph import GD, GS, LEVELS, W as GW, communities_sql, dense, sparse
from quarry.streaming import streams as V


@query("c1_bar_totals", sql="""
SELECT n_name, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def q_c1(spark, sf):
    o = T(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    c = T(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    n = F.broadcast(T(spark, sf, "nation").select("n_nationkey", "n_name"))
    return round_doubles(C.bar_totals(o.join(c, "c_custkey").join(n, "n_nationkey"), "n_name", "o_totalprice"), 2)


@query("c2_line_monthly", sql="""
SELECT 'all' AS key, t, round(y, 2) AS y, round(sum(y) OVER (ORDER BY t), 2) AS cum FROM (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS t, sum(o_totalprice) AS y FROM orders GROUP BY 1)""")
def q_c2(spark, sf):
    return round_doubles(C.line_series(T(spark, sf, "orders"), "o_orderdate", "o_totalprice", "month"), 2)


@query("c3_histogram_bins", sql="""
WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT CAST(CASE WHEN (hi - lo) / 20.0 = 0 THEN 0 ELSE least(floor((l_extendedprice - lo) / ((hi - lo) / 20.0)), 19) END AS INTEGER) AS bin
      FROM lineitem, r WHERE l_extendedprice IS NOT NULL),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin),
g AS (SELECT CAST(unnest(range(0, 20)) AS INTEGER) AS bin)
SELECT g.bin, round(lo + g.bin * ((hi - lo) / 20.0), 6) AS bin_lo, round(lo + (g.bin + 1) * ((hi - lo) / 20.0), 6) AS bin_hi,
       coalesce(n, 0) AS n FROM g CROSS JOIN r LEFT JOIN c ON g.bin = c.bin""")
def q_c3(spark, sf):
    return round_doubles(C.histogram_bins(T(spark, sf, "lineitem"), "l_extendedprice", 20))


@query("c4_degree_bars", sql=GW(GS) + "SELECT degree, count(*) AS n_nodes FROM deg GROUP BY degree")
def q_c4(spark, sf):
    return G.degree_distribution(sparse(spark, sf))


@query("c5_scatter_points")
def q_c5(spark, sf):
    """A 1-in-20 point sample (down-sampling is the chart's feature)."""
    return C.scatter_points(T(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_orderkey", 20)


@query("c5_regression_endpoints", sql="""
WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b,
                  min(l_quantity) AS x0, max(l_quantity) AS x1 FROM lineitem)
SELECT x0 AS x, round(b + a * x0, 6) AS y FROM f UNION ALL SELECT x1, round(b + a * x1, 6) FROM f""")
def q_c5e(spark, sf):
    return round_doubles(C.regression_endpoints(T(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"))


@query("c6_box_plot", sql="""
WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.0) AS "min", quantile_cont(l_extendedprice, 0.25) AS q1,
  quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3, quantile_cont(l_extendedprice, 1.0) AS "max"
  FROM lineitem GROUP BY 1),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT f.l_returnflag, round("min", 6) AS "min", round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round("max", 6) AS "max", round(lo, 6) AS lo, round(hi, 6) AS hi,
  count(*) FILTER (WHERE e.l_extendedprice < lo OR e.l_extendedprice > hi) AS n_outliers
FROM f JOIN lineitem e USING (l_returnflag) GROUP BY ALL""")
def q_c6(spark, sf):
    return round_doubles(C.box_plot(T(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice"))


@query("c6_violin", sql="""
WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
SELECT event_type, CAST(CASE WHEN (hi - lo) / 20.0 = 0 THEN 0 ELSE least(floor((value - lo) / ((hi - lo) / 20.0)), 19) END AS INTEGER) AS bin,
       count(*) AS n FROM events, r WHERE value IS NOT NULL GROUP BY 1, 2""")
def q_c6v(spark, sf):
    return C.violin(T(spark, sf, "events"), "event_type", "value", 20)


@query("c7_heatmap", sql="""
SELECT 'p_size' AS col_a, 'p_retailprice' AS col_b,
  round(covar_pop(p_size, p_retailprice) / nullif(stddev_pop(p_size) * stddev_pop(p_retailprice), 0), 6) AS r FROM part
UNION ALL SELECT 'p_size', 'p_partkey', round(covar_pop(p_size, p_partkey) / nullif(stddev_pop(p_size) * stddev_pop(p_partkey), 0), 6) FROM part
UNION ALL SELECT 'p_retailprice', 'p_partkey',
  round(covar_pop(p_retailprice, p_partkey) / nullif(stddev_pop(p_retailprice) * stddev_pop(p_partkey), 0), 6) FROM part""")
def q_c7(spark, sf):
    return round_doubles(S.correlation_matrix(T(spark, sf, "part"), ["p_size", "p_retailprice", "p_partkey"]))


@query("c8_top_categories", sql="""
SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 10""")
def q_c8(spark, sf):
    from quarry.operators.relational import top_k_frequency
    return top_k_frequency(T(spark, sf, "part"), "p_brand", 10)


@query("c9_acf_table", sql="""
WITH s AS (SELECT 'all' AS key, CAST(o_orderdate AS DATE) AS t, count(*) AS y FROM orders GROUP BY 2),
d AS (SELECT key, t, y - avg(y) OVER (PARTITION BY key) AS d FROM s),
l AS (SELECT key, d, lag(d, 1) OVER (PARTITION BY key ORDER BY t) AS l1, lag(d, 7) OVER (PARTITION BY key ORDER BY t) AS l7 FROM d)
SELECT key, 1 AS lag, round(sum(d * l1) / sum(d * d), 6) AS acf FROM l GROUP BY key
UNION ALL SELECT key, 7, round(sum(d * l7) / sum(d * d), 6) FROM l GROUP BY key""")
def q_c9(spark, sf):
    s = W.resample(T(spark, sf, "orders"), "o_orderdate", None, "day", how="count")
    acf = W.autocorrelation(s, 7)
    return round_doubles(acf.filter(F.col("lag").isin(1, 7)))


@query("c10_network_table", sql=GW(GD) + """
SELECT 'node' AS kind, node AS a, CAST(NULL AS BIGINT) AS b, degree FROM deg
UNION ALL SELECT 'edge', src, dst, NULL FROM g""")
def q_c10(spark, sf):
    return C.network_table(dense(spark, sf))


@query("c11_community_sizes", sql=communities_sql(GD, LEVELS) + "\nSELECT label, count(*) AS size FROM labels GROUP BY label")
def q_c11(spark, sf):
    return G.component_sizes(G.communities(dense(spark, sf)))


# ------------------------------------------------------------------ run logs and streams

LOG_SQL = """SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS window_start,
  CASE WHEN user_id % 2 = 0 THEN 'optimized' ELSE 'fallback' END AS level, count(*) AS runs,
  round(avg(round(value, 2)), 6) AS mean_seconds, count(*) FILTER (WHERE round(value, 2) > 60) AS slow_runs,
  round(max(round(value, 2)), 6) AS max_seconds FROM events WHERE value >= 0 GROUP BY 1, 2"""


@query("o6_run_log_metrics", sql="""
SELECT CASE WHEN user_id % 2 = 0 THEN 'optimized' ELSE 'fallback' END AS level, count(*) AS runs,
  round(avg(round(value, 2)), 6) AS mean_seconds, round(quantile_cont(round(value, 2), 0.95), 6) AS p95_seconds,
  round(avg(CASE WHEN round(value, 2) > 60 THEN 1.0 ELSE 0.0 END), 6) AS slow_share FROM events WHERE value >= 0 GROUP BY 1""")
def q_o6(spark, sf):
    """Run-log metrics over log lines Spark derives from events."""
    lines = spark.read.text(FX.run_log_dir(spark, sf))
    return round_doubles(O.run_log_metrics(lines))


@query("v1_run_log_stream", sql=LOG_SQL)
def q_v1(spark, sf):
    """Streaming twin of O6: tumbling daily windows with a watermark."""
    out = V.run_log_stream(spark, FX.run_log_dir(spark, sf))
    return round_doubles(out)


@query("v2_event_window_stream", sql="""
WITH b AS (SELECT event_type, value, time_bucket(INTERVAL 12 HOUR, ts) AS s FROM events),
w AS (SELECT event_type, value, s AS ws FROM b UNION ALL SELECT event_type, value, s - INTERVAL 12 HOUR FROM b)
SELECT ws AS window_start, ws + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n, round(avg(value), 6) AS mean_value
FROM w GROUP BY ALL""")
def q_v2(spark, sf):
    """Sliding 1-day / 12-hour window means of events from a file stream."""
    return round_doubles(V.event_window_means(spark, FX.events_stream_dir(spark, sf)))
