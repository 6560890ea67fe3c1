"""Registered queries: flagship report, rows (R*), joins (J*), aggregates (A*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.columns import combine_rows, round_doubles, safe_corr
from quarry.operators import relational as R
from quarry.plans.catalog import T, query
from quarry.plans.prefix import exact_quantiles


def fixed_small(df: DataFrame) -> DataFrame:
    """Broadcast hint for dimension tables whose size does not grow with the
    data (TPC-H region: 5 rows, nation: 25 rows at every scale factor)."""
    return F.broadcast(df)


# ------------------------------------------------------------------ flagship


def sales_report(orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Example-2 report (A1, A2, T3, A4, A6) on orders by customer nation.

    total, top nation, day-of-month correlation, median and 10 % tax in
    one row. The row-level aggregate and the per-nation totals are two
    aggregates of the same join; they are merged by union + first(), not
    by a cross join.
    """
    j = (orders.select("o_custkey", "o_totalprice", "o_orderdate")
         .join(customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
         .join(fixed_small(nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")), "c_nationkey"))
    scalars = j.agg(
        F.sum("o_totalprice").alias("total_sales"),
        safe_corr(F.dayofmonth("o_orderdate"), F.col("o_totalprice")).alias("day_sales_correlation"),
        (F.sum("o_totalprice") * F.lit(0.10)).alias("total_sales_tax"),
    )
    median = exact_quantiles(j, "o_totalprice", [0.5], names=["median_sales"]).select("median_sales")
    top = (R.grouped_total_with_top(j, "n_name", "o_totalprice", "t")
           .orderBy(F.col("t").desc(), F.col("n_name").asc()).limit(1)
           .select(F.col("n_name").alias("top_nation")))
    out = combine_rows(scalars, median, top)
    return round_doubles(out.select("total_sales", "day_sales_correlation", "median_sales", "total_sales_tax",
                                    "top_nation"), decimals={"total_sales": 2, "total_sales_tax": 3})


@query("sales_report", bench=True, sql="""
WITH j AS (
  SELECT o.o_totalprice AS price, o.o_orderdate AS d, n.n_name
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey),
s AS (SELECT round(sum(price), 2) AS total_sales,
             round(covar_pop(dayofmonth(d), price) / nullif(stddev_pop(dayofmonth(d)) * stddev_pop(price), 0), 6) AS day_sales_correlation,
             round(median(price), 6) AS median_sales,
             round(sum(price) * 0.10, 3) AS total_sales_tax FROM j),
t AS (SELECT n_name AS top_nation FROM j GROUP BY n_name ORDER BY sum(price) DESC, n_name LIMIT 1)
SELECT * FROM s, t
""")
def q_sales_report(spark: SparkSession, sf: str) -> DataFrame:
    return sales_report(T(spark, sf, "orders"), T(spark, sf, "customer"), T(spark, sf, "nation"))


# ------------------------------------------------------------------ R: rows


@query("r1_count_predicate", sql="SELECT count(*) FILTER (WHERE l_quantity > 45) AS n FROM lineitem")
def q_r1(spark, sf):
    return R.count_where(T(spark, sf, "lineitem"), F.col("l_quantity") > 45)


@query("r2_count_category", sql="SELECT count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS n FROM customer")
def q_r2(spark, sf):
    return R.count_equal(T(spark, sf, "customer"), "c_mktsegment", "BUILDING")


@query("r3_argmin_earliest", sql="""
SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate IS NOT NULL
ORDER BY o_orderdate, o_orderkey LIMIT 1""")
def q_r3(spark, sf):
    return R.arg_best(T(spark, sf, "orders"), "o_orderdate", ["o_orderkey"], tie=["o_orderkey"], largest=False)


@query("r4_filtered_argmax", sql="""
SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_size < 10 AND p_retailprice IS NOT NULL
ORDER BY p_retailprice DESC, p_partkey LIMIT 1""")
def q_r4(spark, sf):
    return R.arg_best(T(spark, sf, "part"), "p_retailprice", ["p_partkey", "p_name"], tie=["p_partkey"],
                      where=F.col("p_size") < 10)


@query("r5_argmax_row", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem WHERE l_extendedprice IS NOT NULL
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 1""")
def q_r5(spark, sf):
    return R.arg_best(T(spark, sf, "lineitem"), "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey"],
                      tie=["l_orderkey", "l_linenumber"])


@query("r6_argmax_date", sql="""
SELECT day, round(total, 2) AS total FROM (
  SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS total FROM orders GROUP BY 1)
ORDER BY total DESC, day LIMIT 1""")
def q_r6(spark, sf):
    daily = (T(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day"))
             .agg(F.sum("o_totalprice").alias("total")))
    return round_doubles(R.arg_best(daily, "total", ["day"], tie=["day"]), decimals={"total": 2})


@query("r7_topk_frequency", sql="""
SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 10""")
def q_r7(spark, sf):
    return R.top_k_frequency(T(spark, sf, "lineitem"), "l_partkey", 10)


@query("r8_rename_positional", sql="""
SELECT p_partkey AS "Rank", p_size AS "Peak", p_name AS "Title", p_retailprice AS "Worldwide_Gross",
       p_brand AS "Year", p_type AS "Column_6" FROM part""")
def q_r8(spark, sf):
    p = T(spark, sf, "part").select("p_partkey", "p_size", "p_name", "p_retailprice", "p_brand", "p_type")
    return R.rename_positional(p, ["Rank", "Peak", "Title", "Worldwide_Gross", "Year"])


@query("r9_regex_filter", sql=r"""
SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '^Brand#1\d$')""")
def q_r9(spark, sf):
    return R.regex_filter(T(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", r"^Brand#1\d$")


@query("r10_distinct_keywords", sql="""
SELECT DISTINCT w AS word FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w <> ''""")
def q_r10(spark, sf):
    words = T(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    return words.filter(F.col("word") != "").distinct()


@query("r11_sort_by_count", sql="""
SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_orderpriority""")
def q_r11(spark, sf):
    return R.sort_by_count(T(spark, sf, "orders"), "o_orderpriority")


@query("r12_first_rows", sql="""
SELECT p_partkey, strategy, reason, p_retailprice FROM (
  SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY strategy, reason, p_retailprice) AS rn FROM (
    SELECT p_partkey, 1 AS strategy, 'large' AS reason, p_retailprice FROM part WHERE p_size > 45
    UNION ALL SELECT p_partkey, 2, 'dear', p_retailprice FROM part WHERE p_retailprice > 1900
    UNION ALL SELECT p_partkey, 3, 'promotion', p_retailprice FROM part WHERE p_type = 'PROMO')) WHERE rn = 1""")
def q_r12r(spark, sf):
    """The winning rows themselves."""
    p = T(spark, sf, "part")
    lists = [(F.col("p_size") > 45, 1, "large"), (F.col("p_retailprice") > 1900, 2, "dear"), (F.col("p_type") == "PROMO", 3, "promotion")]
    cands = None
    for cond, rank, why in lists:
        rows = p.filter(cond).select("p_partkey", F.lit(rank).alias("strategy"), F.lit(why).alias("reason"), "p_retailprice")
        cands = rows if cands is None else cands.unionByName(rows)
    return R.union_first_strategy(cands, ["p_partkey"])


@query("r12_union_strategies", sql="""
SELECT p_partkey, min(strategy) AS strategy FROM (
  SELECT p_partkey, 1 AS strategy FROM part WHERE p_size > 45
  UNION ALL SELECT p_partkey, 2 FROM part WHERE p_retailprice > 1900
  UNION ALL SELECT p_partkey, 3 FROM part WHERE p_type = 'PROMO') GROUP BY p_partkey""")
def q_r12(spark, sf):
    p = T(spark, sf, "part")
    cands = (p.filter(F.col("p_size") > 45).select("p_partkey", F.lit(1).alias("strategy"))
             .unionByName(p.filter(F.col("p_retailprice") > 1900).select("p_partkey", F.lit(2).alias("strategy")))
             .unionByName(p.filter(F.col("p_type") == "PROMO").select("p_partkey", F.lit(3).alias("strategy"))))
    return R.union_first_strategy(cands, ["p_partkey"])


@query("r13_key_set_diff", sql="""
WITH req AS (SELECT o_orderkey AS l_orderkey, CAST(unnest(range(1, 5)) AS INTEGER) AS l_linenumber FROM orders),
have AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT l_orderkey, l_linenumber, 'missing' AS kind FROM (SELECT * FROM req EXCEPT SELECT * FROM have)
UNION ALL
SELECT l_orderkey, l_linenumber, 'extra' AS kind FROM (SELECT * FROM have EXCEPT SELECT * FROM req)""")
def q_r13(spark, sf):
    """Required line numbers 1..4 per order against the lines present (table form)."""
    orders, lines = T(spark, sf, "orders"), T(spark, sf, "lineitem")
    req = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("l_linenumber"))
    return R.key_table_diff(req, lines.select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"],
                            4 * orders.count() + lines.count())


@query("r14_head_ordered", sql="""
SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20""")
def q_r14(spark, sf):
    c = T(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return c.orderBy(F.col("c_acctbal").desc(), F.col("c_custkey")).limit(20)


# ------------------------------------------------------------------ J: joins


@query("j1_inner_join", bench=True, sql="""
SELECT c_mktsegment, year(o_orderdate) AS yr, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue,
       count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
GROUP BY ALL""")
def q_j1(spark, sf):
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    o = T(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    c = T(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    j = R.equi_join(R.equi_join(li, o, "l_orderkey"), c, "o_custkey")
    out = j.groupBy("c_mktsegment", F.year("o_orderdate").cast("bigint").alias("yr")).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        F.count(F.lit(1)).alias("n"))
    return round_doubles(out, decimals={"revenue": 4})


@query("j1_left_join", sql="""
SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey
GROUP BY c_custkey""")
def q_j1_left(spark, sf):
    """Orders are counted per customer first, then joined (pre-aggregate before the join)."""
    per = T(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n_orders"))
    c = T(spark, sf, "customer").select("c_custkey")
    return R.equi_join(c, per, "c_custkey", "left").select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@query("j1_full_join", sql="""
WITH a AS (SELECT c_nationkey AS nk, count(*) AS n_customers FROM customer GROUP BY 1),
b AS (SELECT s_nationkey AS nk, count(*) AS n_suppliers FROM supplier GROUP BY 1)
SELECT coalesce(a.nk, b.nk) AS nationkey, n_customers, n_suppliers FROM a FULL OUTER JOIN b ON a.nk = b.nk""")
def q_j1_full(spark, sf):
    a = T(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nk")).agg(F.count(F.lit(1)).alias("n_customers"))
    b = T(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nk")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    return (R.equi_join(a, b, "nk", "full")
            .select(F.col("nk").alias("nationkey"), "n_customers", "n_suppliers"))


@query("j1_right_join", sql="""
WITH big AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000)
SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM big RIGHT JOIN customer ON o_custkey = c_custkey""")
def q_j1_right(spark, sf):
    """Every customer, with the large orders where there are some."""
    big = T(spark, sf, "orders").filter(F.col("o_totalprice") > 300000).select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return R.equi_join(big, T(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", "right") \
            .select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@query("j2_semi_join", sql="""
SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def q_j2_semi(spark, sf):
    big = T(spark, sf, "orders").filter(F.col("o_totalprice") > 400000).select(F.col("o_custkey").alias("c_custkey"))
    return R.equi_join(T(spark, sf, "customer").select("c_custkey"), big, "c_custkey", "left_semi")


@query("j2_anti_join", sql="""
SELECT c_custkey FROM customer WHERE NOT EXISTS (
  SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)""")
def q_j2_anti(spark, sf):
    """Customers without an order above 300,000."""
    o = T(spark, sf, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return R.equi_join(T(spark, sf, "customer").select("c_custkey"), o, "c_custkey", "left_anti")


@query("j3_band_join", sql="""
SELECT s_suppkey, count(*) AS n FROM supplier JOIN lineitem
  ON l_extendedprice BETWEEN s_acctbal * 10 AND s_acctbal * 10 + 100
GROUP BY s_suppkey""")
def q_j3(spark, sf):
    s = T(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal") * 10).alias("lo"),
                                        (F.col("s_acctbal") * 10 + 100).alias("hi"))
    li = T(spark, sf, "lineitem").select("l_extendedprice")
    j = R.band_join(li, s, "l_extendedprice", "lo", "hi", bucket_width=100.0)
    return j.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("j4_asof_join", sql="""
WITH days AS (SELECT event_type, CAST(min(ts) AS DATE) AS d0, CAST(max(ts) AS DATE) AS d1 FROM events GROUP BY 1),
grid AS (SELECT event_type, CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS TIMESTAMP) + INTERVAL 12 HOUR AS grid_ts FROM days)
SELECT g.event_type, g.grid_ts, e.value FROM grid g ASOF LEFT JOIN events e
  ON g.event_type = e.event_type AND g.grid_ts >= e.ts""")
def q_j4(spark, sf):
    ev = T(spark, sf, "events").select("event_type", "ts", "value")
    days = ev.groupBy("event_type").agg(F.min("ts").cast("date").alias("d0"), F.max("ts").cast("date").alias("d1"))
    grid = days.select("event_type", F.explode(F.sequence("d0", "d1")).alias("d")).select(
        "event_type", (F.col("d").cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS")).alias("grid_ts"))
    return R.asof_join(ev, grid, "event_type", "ts", "grid_ts", ["value"])


# ------------------------------------------------------------------ A: aggregates


@query("a1_total", sql="SELECT round(sum(l_extendedprice), 2) AS total FROM lineitem")
def q_a1(spark, sf):
    return round_doubles(T(spark, sf, "lineitem").agg(F.sum("l_extendedprice").alias("total")), decimals={"total": 2})


@query("a2_top_group", sql="""
SELECT n_name AS top_nation, round(t, 2) AS top_total FROM (
 SELECT n_name, sum(o_totalprice) AS t FROM orders JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name) ORDER BY t DESC, n_name LIMIT 1""")
def q_a2(spark, sf):
    o = T(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    c = T(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    n = fixed_small(T(spark, sf, "nation").select("n_nationkey", "n_name"))
    j = o.join(c, "c_custkey").join(n, "n_nationkey")
    g = R.grouped_total_with_top(j, "n_name", "o_totalprice", "top_total")
    best = R.arg_best(g, "top_total", ["n_name"], tie=["n_name"])
    return round_doubles(best.select(F.col("n_name").alias("top_nation"), "top_total"), decimals={"top_total": 2})


@query("a3_mean", sql="""
SELECT l_returnflag, round(avg(l_quantity), 6) AS mean_qty, round(avg(l_discount), 6) AS mean_discount
FROM lineitem GROUP BY 1""")
def q_a3(spark, sf):
    return round_doubles(T(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.avg("l_quantity").alias("mean_qty"), F.avg("l_discount").alias("mean_discount")))


@query("a4_median", sql="""
SELECT o_orderstatus, round(median(o_totalprice), 6) AS median_price FROM orders GROUP BY 1""")
def q_a4(spark, sf):
    """Exact interpolated median per group, computed from ranks (no group's
    values are buffered in one task)."""
    q = exact_quantiles(T(spark, sf, "orders"), "o_totalprice", [0.5], ["o_orderstatus"], ["median_price"])
    return round_doubles(q.drop("n"))


@query("a5_min_max", sql="""
SELECT l_linestatus, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price,
       min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1""")
def q_a5(spark, sf):
    return T(spark, sf, "lineitem").groupBy("l_linestatus").agg(
        F.min("l_extendedprice").alias("min_price"), F.max("l_extendedprice").alias("max_price"),
        F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))


@query("a6_tax", sql="SELECT round(sum(o_totalprice) * 0.10, 3) AS tax FROM orders")
def q_a6(spark, sf):
    return round_doubles(T(spark, sf, "orders").agg((F.sum("o_totalprice") * F.lit(0.10)).alias("tax")),
                         decimals={"tax": 3})


@query("a7_count_avg", sql="""
SELECT p_type, count(*) AS n, round(avg(p_retailprice), 6) AS mean FROM part GROUP BY 1 ORDER BY n DESC, p_type""")
def q_a7(spark, sf):
    return round_doubles(R.grouped_count_avg(T(spark, sf, "part"), "p_type", "p_retailprice"))


@query("a8_distinct_mode_agg", sql="""
WITH j AS (SELECT r_name, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey
           JOIN region ON n_regionkey = r_regionkey),
m AS (SELECT r_name, c_mktsegment AS mode_segment FROM (
        SELECT r_name, c_mktsegment, row_number() OVER (PARTITION BY r_name ORDER BY count(*) DESC, c_mktsegment) AS rn
        FROM j GROUP BY r_name, c_mktsegment) WHERE rn = 1),
d AS (SELECT r_name, count(DISTINCT n_name) AS n_nations, count(*) AS n_customers FROM j GROUP BY r_name),
s AS (SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM (SELECT DISTINCT r_name, n_name FROM j) GROUP BY r_name)
SELECT d.r_name, n_nations, n_customers, mode_segment, nations FROM d JOIN m USING (r_name) JOIN s USING (r_name)""")
def q_a8(spark, sf):
    """Distinct count, mode (ties: smallest value) and ordered string_agg per region.

    Mode is a count per (group, value) and two partial aggregates (no
    window, no collected values); string_agg runs over distinct names.
    """
    c = T(spark, sf, "customer").select("c_nationkey", "c_mktsegment")
    n = fixed_small(T(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey"))
    r = fixed_small(T(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"))
    j = c.join(n, "c_nationkey").join(r, "n_regionkey")
    d = j.groupBy("r_name").agg(F.count_distinct("n_name").alias("n_nations"), F.count(F.lit(1)).alias("n_customers"))
    m = R.group_mode(j, "r_name", "c_mktsegment", "mode_segment")
    s = (j.select("r_name", "n_name").distinct().groupBy("r_name")
         .agg(F.expr("string_agg(n_name, ',') WITHIN GROUP (ORDER BY n_name)").alias("nations")))
    return d.join(m, "r_name").join(s, "r_name")


@query("a9_dispersion", sql="""
SELECT l_returnflag, round(stddev_samp(l_extendedprice), 6) AS sd, round(var_samp(l_extendedprice), 6) AS var,
  round(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round(quantile_cont(l_extendedprice, 0.5), 6) AS q2,
  round(quantile_cont(l_extendedprice, 0.75), 6) AS q3, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90
FROM lineitem GROUP BY 1""")
def q_a9(spark, sf):
    li = T(spark, sf, "lineitem")
    m = li.groupBy("l_returnflag").agg(F.stddev_samp("l_extendedprice").alias("sd"),
                                       F.var_samp("l_extendedprice").alias("var"))
    q = exact_quantiles(li, "l_extendedprice", [0.25, 0.5, 0.75, 0.9], ["l_returnflag"], ["q1", "q2", "q3", "p90"])
    return round_doubles(m.join(q.drop("n"), "l_returnflag"))


@query("a10_date_range", sql="""
SELECT min(o_orderdate) AS earliest, max(o_orderdate) AS latest,
       datediff('day', min(o_orderdate), max(o_orderdate)) AS span_days FROM orders""")
def q_a10(spark, sf):
    return T(spark, sf, "orders").agg(F.min("o_orderdate").alias("earliest"), F.max("o_orderdate").alias("latest"),
                                      F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).cast("bigint").alias("span_days"))


@query("a11_rollup", sql="""
SELECT r_name, n_name, round(sum(c_acctbal), 2) AS total, count(*) AS n, CAST(grouping(r_name, n_name) AS BIGINT) AS gid
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY ROLLUP (r_name, n_name)""")
def q_a11(spark, sf):
    c = T(spark, sf, "customer").select("c_nationkey", "c_acctbal")
    n = fixed_small(T(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey"))
    r = fixed_small(T(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"))
    return round_doubles(R.rollup_totals(c.join(n, "c_nationkey").join(r, "n_regionkey"),
                                         ["r_name", "n_name"], "c_acctbal"), decimals={"total": 2})


@query("a11_cube", sql="""
SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total, count(*) AS n,
  CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS gid FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def q_a11c(spark, sf):
    return round_doubles(R.rollup_totals(T(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"],
                                         "o_totalprice", "cube"), decimals={"total": 2})


@query("a12_crosstab_long", sql="""
SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2""")
def q_a12(spark, sf):
    return R.crosstab_long(T(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("a12_pivot", sql="""
SELECT o_orderstatus,
  count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS "1-URGENT",
  count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS "2-HIGH",
  count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS "3-MEDIUM",
  count(*) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED') AS "4-NOT SPECIFIED",
  count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS "5-LOW"
FROM orders GROUP BY 1""")
def q_a12p(spark, sf):
    w = R.crosstab_wide(T(spark, sf, "orders"), "o_orderstatus", "o_orderpriority", PRIORITIES)
    return w.select("o_orderstatus", *[F.coalesce(F.col(f"`{p}`"), F.lit(0)).alias(p) for p in PRIORITIES])


@query("a13_quality_summary", sql="""
SELECT (SELECT count(*) FROM lineitem) AS n_rows, 11 AS n_columns,
  (SELECT count(*) FILTER (WHERE l_orderkey IS NULL) + count(*) FILTER (WHERE l_quantity IS NULL OR isnan(l_quantity))
     + count(*) FILTER (WHERE l_extendedprice IS NULL OR isnan(l_extendedprice)) + count(*) FILTER (WHERE l_returnflag IS NULL)
   FROM lineitem) AS missing_cells,
  CAST((SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS BIGINT) AS duplicate_rows,
  (SELECT round(avg(l_extendedprice), 6) FROM lineitem) AS mean_price, (SELECT round(stddev_samp(l_extendedprice), 6) FROM lineitem) AS sd_price""")
def q_a13(spark, sf):
    """P12 + P13 + A9 in one row: one profiling aggregate plus the
    fingerprinted duplicate count, merged without a cross join."""
    from quarry.operators import profile as P
    li = T(spark, sf, "lineitem")
    miss = P.missing_values(li, ["l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag"]) \
            .filter(F.col("column") == "__total__").select(F.col("missing").alias("missing_cells"))
    stats = li.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(li.columns)).alias("n_columns"),
                   F.avg("l_extendedprice").alias("mean_price"), F.stddev_samp("l_extendedprice").alias("sd_price"))
    return round_doubles(combine_rows(stats, miss, P.duplicate_rows(li)))


@query("a13_quality_summary_csv", sql="""
WITH base AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 100 = 4),
t AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, CASE WHEN l_orderkey % 100 IN (2, 3) THEN NULL ELSE l_extendedprice END AS price,
  CAST(l_shipdate AS DATE) AS ship_day FROM base)
SELECT count(*) AS n_rows, 6 AS n_columns, count(*) - count(price) AS missing_cells,
  CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS BIGINT) AS duplicate_rows,
  round(avg(price), 6) AS mean_price, round(stddev_samp(price), 6) AS sd_price FROM t""")
def q_a13c(spark, sf):
    """The same summary of the damaged CSV, where cells are missing and rows doubled."""
    from quarry.functions.columns import money_to_double
    from quarry.operators import profile as P
    from quarry.plans import fixtures as FX
    from quarry.sources import files as S
    raw = S.read_csv(spark, FX.csv_dirty_path(spark, sf))
    t = raw.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", money_to_double(F.col("l_extendedprice")).alias("price"),
                   F.col("l_shipdate").cast("date").alias("ship_day"))
    miss = P.missing_values(t).filter(F.col("column") == "__total__").select(F.col("missing").alias("missing_cells"))
    stats = t.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(t.columns)).alias("n_columns"), F.avg("price").alias("mean_price"),
                  F.stddev_samp("price").alias("sd_price"))
    return round_doubles(combine_rows(stats, miss, P.duplicate_rows(t)))


SALES_SPEC = [
    {"key": "total_sales", "source": "sales", "op": "relational.aggregate", "params": {"column": "price"},
     "type": "number"},
    {"key": "top_nation", "source": "sales", "op": "relational.top_group",
     "params": {"group": "n_name", "measure": "price"}, "column": "n_name", "type": "string"},
    {"key": "day_sales_correlation", "source": "sales", "op": "stats.pearson",
     "prepare": {"op": "relational.day_of_month", "params": {"date_col": "d"}},
     "params": {"x": "day", "y": "price"}, "type": "number"},
    {"key": "median_sales", "source": "sales", "op": "relational.aggregate",
     "params": {"column": "price", "how": "median"}, "type": "number"},
    {"key": "total_sales_tax", "source": "sales", "op": "relational.aggregate",
     "params": {"column": "price", "scale": 0.10}, "type": "number"},
]


@query("spec_sales_answer", sql="""
WITH j AS (
  SELECT o.o_totalprice AS price, o.o_orderdate AS d, n.n_name
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey),
s AS (SELECT round(sum(price), 2) AS total_sales,
             round(covar_pop(dayofmonth(d), price) / nullif(stddev_pop(dayofmonth(d)) * stddev_pop(price), 0), 6) AS day_sales_correlation,
             round(median(price), 6) AS median_sales,
             round(sum(price) * 0.10, 3) AS total_sales_tax FROM j),
t AS (SELECT n_name AS top_nation FROM j GROUP BY n_name ORDER BY sum(price) DESC, n_name LIMIT 1)
SELECT * FROM s, t""")
def q_spec(spark, sf):
    """The flagship report through the declarative spec (operators looked
    up in the registry, one job per item, merged without a cross join)."""
    from quarry.plans.spec import answer
    o = T(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("price"),
                                      F.col("o_orderdate").alias("d"))
    c = T(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    n = fixed_small(T(spark, sf, "nation").select("n_nationkey", "n_name"))
    sales = o.join(c, "c_custkey").join(n, "n_nationkey")
    out = answer(spark, {"sales": sales}, SALES_SPEC).drop("answer_json")
    return round_doubles(out, decimals={"total_sales": 2, "total_sales_tax": 3})
