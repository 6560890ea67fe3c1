"""Registered queries: profiling (P*) and JSON (K*, S6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.columns import money_to_double, round_doubles
from quarry.operators import jsonops as J
from quarry.operators import profile as P
from quarry.plans import fixtures as FX
from quarry.plans.catalog import T, query
from quarry.sources import files as S


@query("p1_table_profile", sql="""
SELECT column_name AS "column", dtype, CAST(pos AS INTEGER) AS position, (SELECT count(*) FROM lineitem) AS row_count
FROM (VALUES ('l_orderkey', 'bigint', 0), ('l_partkey', 'bigint', 1), ('l_suppkey', 'bigint', 2),
  ('l_linenumber', 'int', 3), ('l_quantity', 'double', 4), ('l_extendedprice', 'double', 5), ('l_discount', 'double', 6),
  ('l_tax', 'double', 7), ('l_returnflag', 'string', 8), ('l_linestatus', 'string', 9), ('l_shipdate', 'timestamp_ntz', 10))
  AS t(column_name, dtype, pos)""")
def q_p1(spark, sf):
    """Schema, positions and the exact row count (long form)."""
    prof = P.table_profile(T(spark, sf, "lineitem"), sample_rows=0)
    return prof.select(F.posexplode("dtypes").alias("position", "d"), "row_count").select(
        F.col("d.column").alias("column"), F.col("d.dtype").alias("dtype"), F.col("position").cast("int"), "row_count")


@query("p1_table_sample", sql="""
WITH r AS (SELECT to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey, 'c_acctbal': c_acctbal,
  'c_mktsegment': c_mktsegment}) AS row FROM customer),
t AS (SELECT row FROM r ORDER BY md5(CAST(row AS VARCHAR)), row LIMIT 5)
SELECT CAST(row_number() OVER (ORDER BY row) - 1 AS INTEGER) AS pos, CAST(row AS VARCHAR) AS row, (SELECT count(*) FROM customer) AS row_count FROM t""")
def q_p1s(spark, sf):
    """The profile's sample: five customers, the same on any layout of the table."""
    c = T(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    return P.table_profile(c, sample_rows=5).select(F.posexplode("sample").alias("pos", "row"), "row_count")


@query("p6_html_profile", sql="""
SELECT page_id, length(html) AS size_chars, contains(lower(html), '<table') AS has_tables,
       contains(lower(html), '<form') AS has_forms, contains(lower(html), '<script') AS has_scripts FROM pages""")
def q_p6(spark, sf):
    return P.html_profile(T(spark, sf, "pages").select("page_id", "html")).drop("html")


@query("p7_html_title", sql=r"""
SELECT page_id, nullif(trim(regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1)), '') AS title FROM pages""")
def q_p7(spark, sf):
    return T(spark, sf, "pages").select("page_id", P.html_title(F.col("html")).alias("title"))


@query("p8_text_profile", sql="""
SELECT doc_id, length(text) AS size_chars, len(string_split(text, chr(10))) AS num_lines FROM documents""")
def q_p8(spark, sf):
    return P.text_profile(T(spark, sf, "documents").select("doc_id", "text")).drop("text") \
            .withColumn("num_lines", F.col("num_lines").cast("bigint"))


@query("p9_preview", sql="""
WITH h AS (SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 1, 10), chr(10)) AS head FROM documents)
SELECT doc_id, CASE WHEN length(head) > 1000 THEN substring(head, 1, 1000) || '... (truncated)' ELSE head END AS preview FROM h""")
def q_p9(spark, sf):
    return P.preview(T(spark, sf, "documents").select("doc_id", "text"), "text").drop("text")


@query("p9_preview_csv", sql="""
WITH r AS (SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size,
  CAST(p_retailprice AS VARCHAR) AS p_retailprice FROM part),
j AS (SELECT *, CAST(to_json({'p_partkey': p_partkey, 'p_name': p_name, 'p_brand': p_brand, 'p_type': p_type, 'p_size': p_size,
  'p_retailprice': p_retailprice}) AS VARCHAR) AS js FROM r),
t AS (SELECT concat_ws(' | ', p_partkey, p_name, p_brand, p_type, p_size, p_retailprice) AS line FROM j ORDER BY md5(js), js LIMIT 10)
SELECT 'p_partkey,p_name,p_brand,p_type,p_size,p_retailprice' AS columns, 6 AS num_columns, 'string,string,string,string,string,string' AS dtypes,
  count(*) AS sample_rows, 'p_partkey | p_name | p_brand | p_type | p_size | p_retailprice' || chr(10) || string_agg(line, chr(10) ORDER BY line) AS preview FROM t""")
def q_p9c(spark, sf):
    p = P.preview_table(S.read_tsv(spark, FX.tsv_part_path(spark, sf)))
    return p.select(F.array_join("columns", ",").alias("columns"), "num_columns",
                    F.array_join(F.transform("dtypes", lambda d: d["dtype"]), ",").alias("dtypes"), "sample_rows", "preview")


@query("p9_preview_json", sql="""
WITH d AS (SELECT c_custkey AS id, c_custkey % 5 AS k, CASE c_custkey % 5
    WHEN 0 THEN '{"id":' || c_custkey || ',"name":"' || c_name || '","balance":' || c_acctbal || ',"nation":{"name":"' || n_name
      || '","region":{"name":"' || r_name || '"}}}'
    WHEN 1 THEN '[{"id":' || c_custkey || ',"segment":"' || c_mktsegment || '"},{"id":' || c_nationkey || ',"segment":"' || n_name || '"}]'
    WHEN 2 THEN '[' || c_custkey || ',' || c_nationkey || ',' || n_regionkey || ']'
    WHEN 3 THEN '{"keys":[' || c_custkey || ',' || c_nationkey || '],"segments":["' || c_mktsegment || '"]}' END AS js
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT id, CASE WHEN k IN (1, 2) THEN 'list' WHEN k IN (0, 3) THEN 'dict' END AS data_type,
  CASE k WHEN 1 THEN 2 WHEN 2 THEN 3 END AS length,
  CASE k WHEN 0 THEN 'id,name,balance,nation' WHEN 1 THEN 'id,segment' WHEN 3 THEN 'keys,segments' END AS keys,
  CASE WHEN length(js) > 60 THEN substring(js, 1, 60) || chr(10) || '... (truncated)' ELSE js END AS preview,
  CASE WHEN k = 4 THEN 'JSON parse error' END AS error FROM d""")
def q_p9j(spark, sf):
    p = P.preview_json(FX.json_synth(spark, sf), "js", max_chars=60)
    return p.select("id", "data_type", "length", F.array_join("keys", ",").alias("keys"), "preview", "error")


def _typed_dirty(spark, sf):
    df = S.read_csv(spark, FX.csv_dirty_path(spark, sf))
    return df.select(F.col("l_orderkey").cast("bigint"), F.col("l_returnflag"),
                     money_to_double(F.col("l_extendedprice")).alias("price"),
                     F.col("l_shipdate").cast("date").alias("ship_day"))


DIRTY_BASE = """
WITH base AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 100 = 4),
t AS (SELECT l_orderkey, l_returnflag, CASE WHEN l_orderkey % 100 IN (2, 3) THEN NULL ELSE l_extendedprice END AS price,
             CAST(l_shipdate AS DATE) AS ship_day FROM base)"""


@query("p12_missing_values", sql=DIRTY_BASE + """
SELECT "column", missing FROM (
  SELECT 'l_orderkey' AS "column", count(*) FILTER (WHERE l_orderkey IS NULL) AS missing FROM t
  UNION ALL SELECT 'l_returnflag', count(*) FILTER (WHERE l_returnflag IS NULL) FROM t
  UNION ALL SELECT 'price', count(*) FILTER (WHERE price IS NULL OR isnan(price)) FROM t
  UNION ALL SELECT 'ship_day', count(*) FILTER (WHERE ship_day IS NULL) FROM t
  UNION ALL SELECT '__total__', count(*) FILTER (WHERE l_orderkey IS NULL) + count(*) FILTER (WHERE l_returnflag IS NULL)
    + count(*) FILTER (WHERE price IS NULL OR isnan(price)) + count(*) FILTER (WHERE ship_day IS NULL) FROM t)""")
def q_p12(spark, sf):
    return P.missing_values(_typed_dirty(spark, sf))


@query("p13_duplicate_rows", sql="""
SELECT CAST((SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS BIGINT) AS duplicate_rows""")
def q_p13(spark, sf):
    return P.duplicate_rows(T(spark, sf, "lineitem"))


@query("p13_duplicate_rows_csv", sql=DIRTY_BASE + """
SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag, l_quantity,
   CASE WHEN l_orderkey % 100 IN (2, 3) THEN NULL ELSE l_extendedprice END, l_orderkey % 100 IN (2, 3), l_shipdate FROM base)) AS BIGINT)
   AS duplicate_rows FROM base""")
def q_p13c(spark, sf):
    """Duplicates in the CSV round trip (rows with l_orderkey % 100 = 4 were written twice)."""
    df = S.read_csv(spark, FX.csv_dirty_path(spark, sf))
    return P.duplicate_rows(df.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity",
                                      money_to_double(F.col("l_extendedprice")).alias("p"),
                                      (F.pmod(F.col("l_orderkey").cast("bigint"), F.lit(100)).isin(2, 3)).alias("m"),
                                      "l_shipdate"))


@query("p14_column_roles", sql="""
SELECT column_name AS "column", dtype, role, edge AS edge_endpoint, 'scatter' AS suggested_chart,
       (SELECT count(*) FROM orders) AS row_count, 6 AS column_count
FROM (VALUES ('o_orderkey', 'bigint', 'numeric', false), ('o_custkey', 'bigint', 'numeric', false),
  ('o_orderstatus', 'string', 'text', false), ('o_totalprice', 'double', 'numeric', true),
  ('o_orderdate', 'timestamp_ntz', 'date', false), ('o_orderpriority', 'string', 'text', false)) AS t(column_name, dtype, role, edge)""")
def q_p14(spark, sf):
    return P.column_roles(T(spark, sf, "orders"))


@query("p16_impute_mean", sql=DIRTY_BASE + """
SELECT l_returnflag, round(sum(coalesce(price, (SELECT avg(price) FROM t))), 2) AS total, count(*) AS n FROM t GROUP BY 1""")
def q_p16(spark, sf):
    filled = P.impute(_typed_dirty(spark, sf), ["price"], "mean")
    return round_doubles(filled.groupBy("l_returnflag").agg(F.sum("price").alias("total"), F.count(F.lit(1)).alias("n")), 2)


@query("p16_drop_missing", sql=DIRTY_BASE + "SELECT count(*) AS n FROM t WHERE price IS NOT NULL")
def q_p16d(spark, sf):
    return P.impute(_typed_dirty(spark, sf), ["price"], "drop").agg(F.count(F.lit(1)).alias("n"))


@query("p17_convert_validate", sql="""
WITH base AS (SELECT l_orderkey FROM lineitem UNION ALL SELECT l_orderkey FROM lineitem WHERE l_orderkey % 100 = 4)
SELECT count(*) FILTER (WHERE l_orderkey % 100 <> 3) AS present, count(*) FILTER (WHERE l_orderkey % 100 NOT IN (2, 3)) AS converted,
       count(*) FILTER (WHERE l_orderkey % 100 = 2) AS invalid FROM base""")
def q_p17(spark, sf):
    """Text prices to DOUBLE; 'n/a' is invalid, empty fields are absent."""
    return P.convert_with_validation(S.read_csv(spark, FX.csv_dirty_path(spark, sf)), "l_extendedprice")


@query("p18_detect_dates", sql="""
WITH base AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 100 = 4)
SELECT 'l_shipdate' AS "column", count(*) AS non_null, count(*) AS parsed, CAST(1.0 AS DOUBLE) AS hit_rate, true AS is_date FROM base
UNION ALL SELECT 'l_returnflag', count(*), 0, CAST(0.0 AS DOUBLE), false FROM base""")
def q_p18(spark, sf):
    df = S.read_csv(spark, FX.csv_dirty_path(spark, sf))
    a = P.detect_dates(df, "l_shipdate").select(F.lit("l_shipdate").alias("column"), "*")
    b = P.detect_dates(df, "l_returnflag").select(F.lit("l_returnflag").alias("column"), "*")
    return a.unionByName(b)


def _date_texts(spark, sf):
    """Ship dates as text in three formats, each with rows that are missing or in another format."""
    d, k = F.col("l_shipdate"), F.pmod("l_orderkey", F.lit(100))
    iso = F.date_format(d, "yyyy-MM-dd")
    return T(spark, sf, "lineitem").select(
        "l_returnflag",
        F.when(k == 1, "n/a").when(k == 2, F.date_format(d, "yyyy/MM/dd")).otherwise(iso).alias("iso"),
        F.when(k == 1, "").when(k == 3, iso).otherwise(F.date_format(d, "MM/dd/yyyy")).alias("us"),
        F.when(k < 5, iso).when(k == 6, F.lit(None)).otherwise(F.date_format(d, "dd.MM.yyyy")).alias("dotted"))


DATE_TEXT_SQL = """WITH t AS (SELECT l_returnflag, l_orderkey % 100 AS k, CAST(l_shipdate AS DATE) AS d FROM lineitem)
"""


@query("p18_date_formats", sql=DATE_TEXT_SQL + """
SELECT 'iso' AS "column", 'yyyy-MM-dd' AS format, count(*) AS present, count(*) FILTER (WHERE k NOT IN (1, 2)) AS converted,
  count(*) FILTER (WHERE k IN (1, 2)) AS failed FROM t
UNION ALL SELECT 'us', 'MM/dd/yyyy', count(*) FILTER (WHERE k <> 1), count(*) FILTER (WHERE k NOT IN (1, 3)), count(*) FILTER (WHERE k = 3) FROM t
UNION ALL SELECT 'dotted', 'dd.MM.yyyy', count(*) FILTER (WHERE k <> 6), count(*) FILTER (WHERE k >= 5 AND k <> 6), count(*) FILTER (WHERE k < 5) FROM t
UNION ALL SELECT 'l_returnflag', NULL, count(*), 0, count(*) FROM t""")
def q_p18f(spark, sf):
    return P.date_formats(_date_texts(spark, sf), ["iso", "us", "dotted", "l_returnflag"])


@query("p18_convert_dates", sql=DATE_TEXT_SQL + """,
c AS (SELECT l_returnflag, CASE WHEN k NOT IN (1, 2) THEN d END AS iso, CASE WHEN k NOT IN (1, 3) THEN d END AS us,
  CASE WHEN k >= 5 AND k <> 6 THEN d END AS dotted FROM t)
SELECT l_returnflag, date_trunc('month', iso)::DATE AS month, count(iso) AS n_iso, count(us) AS n_us, count(dotted) AS n_dotted,
  min(iso) AS first_iso, max(us) AS last_us, CAST(sum(datediff('day', DATE '1970-01-01', dotted)) AS BIGINT) AS days_dotted
FROM c GROUP BY 1, 2""")
def q_p18c(spark, sf):
    """Three text columns converted by their own formats, by flag and month."""
    c = P.convert_dates(_date_texts(spark, sf), ["iso", "us", "dotted"])
    c = c.select("l_returnflag", *[F.col(x).cast("date").alias(x) for x in ("iso", "us", "dotted")])
    return c.groupBy("l_returnflag", F.trunc("iso", "month").alias("month")).agg(
        F.count("iso").alias("n_iso"), F.count("us").alias("n_us"), F.count("dotted").alias("n_dotted"),
        F.min("iso").alias("first_iso"), F.max("us").alias("last_us"),
        F.sum(F.datediff("dotted", F.lit("1970-01-01").cast("date"))).cast("bigint").alias("days_dotted"))


# ------------------------------------------------------------------ JSON

JSON_KIND = "c_custkey % 5"


@query("p2_json_profile", sql="""
SELECT c_custkey AS id, c_custkey % 5 <> 4 AS valid,
  CASE c_custkey % 5 WHEN 0 THEN 'dict' WHEN 1 THEN 'list' WHEN 2 THEN 'list' WHEN 3 THEN 'dict' END AS data_type,
  CAST(CASE c_custkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 6 WHEN 3 THEN 2 END AS BIGINT) AS records,
  CASE c_custkey % 5 WHEN 1 THEN 'dict' WHEN 2 THEN 'int' END AS item_type,
  CASE c_custkey % 5 WHEN 0 THEN 'id,name,balance,nation' WHEN 1 THEN 'id,segment' WHEN 3 THEN 'keys,segments' END AS keys,
  CAST(CASE c_custkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 1 END AS BIGINT) AS depth,
  CASE c_custkey % 5 WHEN 0 THEN 'nested' WHEN 4 THEN NULL ELSE 'simple' END AS complexity,
  CASE c_custkey % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'json' WHEN 4 THEN NULL ELSE 'general' END AS suggested_analysis
FROM customer""")
def q_p2(spark, sf):
    """P2-P5, K4, K6 per JSON document of the derived customer corpus."""
    docs = FX.json_synth(spark, sf)
    # lists of numbers get more than five items and a deeper last one
    deep = F.concat(F.expr("substring(js, 1, length(js) - 1)"), F.lit(',4,5,{"b":{"c":{"d":1}}}]'))
    prof = J.json_profile(docs.withColumn("js", F.when(F.col("id") % 5 == 2, deep).otherwise(F.col("js"))))
    return prof.withColumn("keys", F.array_join("keys", ","))


@query("k1_flatten", sql="""
SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, n_name AS "nation.name", r_name AS "nation.region.name"
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 5 = 0""")
def q_k1(spark, sf):
    schema = "id bigint, name string, balance double, nation struct<name: string, region: struct<name: string>>"
    docs = FX.json_synth(spark, sf)
    parsed = docs.filter(F.try_parse_json("js").isNotNull() & F.col("js").startswith("{\"id\"") &
                         F.col("js").contains("\"nation\"")).select(F.from_json("js", schema).alias("d")).select("d.*")
    return J.flatten(parsed)


@query("k2_explode_arrays", sql="""
SELECT c_custkey AS id, 0 AS pos, c_custkey AS item_id, c_mktsegment AS segment FROM customer WHERE c_custkey % 5 = 1
UNION ALL
SELECT c_custkey, 1, CAST(c_nationkey AS BIGINT), n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 5 = 1""")
def q_k2(spark, sf):
    docs = FX.json_synth(spark, sf).filter(F.col("js").startswith("[{"))
    arr = docs.select("id", F.from_json("js", "array<struct<id: bigint, segment: string>>").alias("a"))
    return arr.select("id", F.posexplode_outer("a").alias("pos", "item")).select(
        "id", "pos", F.col("item.id").alias("item_id"), F.col("item.segment").alias("segment"))


@query("k3_key_inventory", sql="""
SELECT key, count(*) AS n_docs FROM (
  SELECT unnest(['id', 'name', 'balance', 'nation']) AS key FROM customer WHERE c_custkey % 5 = 0
  UNION ALL SELECT unnest(['keys', 'segments']) FROM customer WHERE c_custkey % 5 = 3) GROUP BY key""")
def q_k3(spark, sf):
    return J.key_inventory(FX.json_synth(spark, sf))


@query("k5_field_quality", sql="""
SELECT '$.id' AS path, 'bigint' AS type, count(*) FILTER (WHERE c_custkey % 5 = 0) AS present,
       count(*) FILTER (WHERE c_custkey % 5 = 0) AS typed FROM customer
UNION ALL SELECT '$.nation.region.name', 'string', count(*) FILTER (WHERE c_custkey % 5 = 0), count(*) FILTER (WHERE c_custkey % 5 = 0) FROM customer
UNION ALL SELECT '$[0].id', 'bigint', count(*) FILTER (WHERE c_custkey % 5 = 1), count(*) FILTER (WHERE c_custkey % 5 = 1) FROM customer
UNION ALL SELECT '$.keys', 'array<bigint>', count(*) FILTER (WHERE c_custkey % 5 = 3), count(*) FILTER (WHERE c_custkey % 5 = 3) FROM customer
UNION ALL SELECT '$.name', 'int', count(*) FILTER (WHERE c_custkey % 5 = 0), 0 FROM customer""")
def q_k5(spark, sf):
    paths = [("$.id", "bigint"), ("$.nation.region.name", "string"), ("$[0].id", "bigint"),
             ("$.keys", "array<bigint>"), ("$.name", "int")]
    return J.field_quality(FX.json_synth(spark, sf), "js", paths)


@query("k6_invalid_json", sql="""
SELECT count(*) AS n_docs, count(*) FILTER (WHERE c_custkey % 5 = 4) AS n_invalid FROM customer""")
def q_k6(spark, sf):
    docs = FX.json_synth(spark, sf)
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.try_parse_json("js").isNull()).alias("n_invalid"))


@query("s6_normalise_json", sql="""
WITH c AS (SELECT *, c_custkey % 5 AS m FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
q AS (SELECT m, c_custkey AS id, 0 AS row_idx, unnest(['id', 'name', 'balance', 'nation']) AS key, unnest([CAST(c_custkey AS VARCHAR),
    '"' || c_name || '"', CAST(c_acctbal AS VARCHAR), '{"name":"' || n_name || '","region":{"name":"' || r_name || '"}}']) AS value FROM c WHERE m = 0
  UNION ALL SELECT m, c_custkey, unnest([0, 0, 1, 1]), unnest(['id', 'segment', 'id', 'segment']), unnest([CAST(c_custkey AS VARCHAR),
    '"' || c_mktsegment || '"', CAST(c_nationkey AS VARCHAR), '"' || n_name || '"']) FROM c WHERE m = 1
  UNION ALL SELECT m, c_custkey, unnest([0, 1, 2]), 'value', unnest([CAST(c_custkey AS VARCHAR), CAST(c_nationkey AS VARCHAR),
    CAST(n_regionkey AS VARCHAR)]) FROM c WHERE m = 2
  UNION ALL SELECT m, c_custkey, unnest([0, 1, 0]), unnest(['keys', 'keys', 'segments']), unnest([CAST(c_custkey AS VARCHAR),
    CAST(c_nationkey AS VARCHAR), '"' || c_mktsegment || '"']) FROM c WHERE m = 3)
SELECT id, CAST(row_idx AS BIGINT) AS row_idx, key, CASE WHEN key = 'balance' THEN CAST(round(CAST(value AS DOUBLE), 2) AS VARCHAR)
  ELSE value END AS value FROM q""")
def q_s6(spark, sf):
    """Every document shape to (id, row, key, value) rows (VARIANT explode)."""
    cells = J.explode_records(FX.json_synth(spark, sf), "id")
    # decimals of JSON text may end in zeros that a double does not show
    money = F.round(F.col("value").try_cast("double"), 2).cast("string")
    return cells.withColumn("value", F.when(F.col("key") == "balance", money).otherwise(F.col("value")))
