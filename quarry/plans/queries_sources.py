"""Registered queries: sources and sinks (S*). Each file format is a round
trip: Spark writes a given table in that format into the shared folder,
the reader under test reads it back, and the answer is compared with the
same computation on the original table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.columns import money_to_double, round_doubles
from quarry.plans import fixtures as FX
from quarry.plans.catalog import T, query
from quarry.sources import files as S

DIRTY_SQL = """
WITH base AS (SELECT l_returnflag, l_orderkey, l_extendedprice FROM lineitem
              UNION ALL SELECT l_returnflag, l_orderkey, l_extendedprice FROM lineitem WHERE l_orderkey % 100 = 4),
p AS (SELECT l_returnflag, CASE WHEN l_orderkey % 100 IN (2, 3) THEN NULL ELSE l_extendedprice END AS price,
             l_orderkey % 100 IN (2, 3) AS missing FROM base)"""


@query("s1_read_csv", sql=DIRTY_SQL + """
SELECT l_returnflag, count(*) AS n, count(price) AS n_price, count(*) FILTER (WHERE missing) AS n_missing,
       round(sum(price), 2) AS total FROM p GROUP BY 1""")
def q_s1(spark, sf):
    """CSV with header (all text), money strings parsed with '$' and ','
    removed; 'n/a' and empty fields count as missing."""
    df = S.read_csv(spark, FX.csv_dirty_path(spark, sf))
    price = money_to_double(F.col("l_extendedprice"))
    return round_doubles(df.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count(price).alias("n_price"),
        F.count_if(price.isNull()).alias("n_missing"), F.sum(price).alias("total")), 2)


@query("s1_detect_encoding_csv", sql="SELECT 'UTF-8' AS encoding, count(*) + (SELECT count(*) FROM lineitem WHERE l_orderkey % 100 = 4) AS n FROM lineitem")
def q_s1e(spark, sf):
    path = FX.csv_dirty_path(spark, sf)
    enc = S.detect_encoding(spark, path)
    return S.read_csv(spark, path, encoding=None).agg(F.lit(enc).alias("encoding"), F.count(F.lit(1)).alias("n"))


@query("s2_read_tsv", sql="""
SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 6) AS mean_price, CAST(sum(p_size) AS BIGINT) AS total_size
FROM part GROUP BY 1""")
def q_s2(spark, sf):
    schema = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    df = S.read_tsv(spark, FX.tsv_part_path(spark, sf), schema=schema)
    return round_doubles(df.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("mean_price"),
                                                   F.sum("p_size").cast("bigint").alias("total_size")))


@query("s3_read_json_documents", sql="""
SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderdate) AS first_order FROM orders GROUP BY 1""")
def q_s3(spark, sf):
    schema = ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string")
    df = S.read_json_documents(spark, FX.json_array_docs_path(spark, sf), schema=schema)
    return round_doubles(df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"),
                                                         F.min("o_orderdate").alias("first_order")), 2)


@query("s4_read_jsonl", sql="""
SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1""")
def q_s4(spark, sf):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    df = S.read_jsonl(spark, FX.jsonl_events_path(spark, sf), schema=schema)
    return round_doubles(df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"),
                                                      F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")),
                         decimals={"total": 2})


@query("s5_read_json_latin1", sql="""
SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1""")
def q_s5(spark, sf):
    df = S.read_jsonl(spark, FX.latin1_documents_path(spark, sf), schema="doc_id long, lang string, text string",
                      encoding="ISO-8859-1")
    return df.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("bigint").alias("chars"))


@query("s5_read_json_utf16", sql="""
SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, 'UTF-16' AS encoding FROM orders GROUP BY 1""")
def q_s5u(spark, sf):
    """Whole JSON documents in UTF-16: the encoding is found by the byte order mark."""
    path = FX.utf16_orders_path(spark, sf) + "/*.json"
    df = S.read_json_documents(spark, path, schema="o_orderstatus string, o_totalprice double", encoding=None)
    out = df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    return round_doubles(out, 2).withColumn("encoding", F.lit(S.detect_encoding(spark, path)))


@query("s14_manifest_by_type", sql="""
SELECT CASE n_nationkey % 4 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' WHEN 2 THEN 'text' ELSE 'html' END AS type, count(*) AS n_files,
  count(*) AS n_accepted, CAST(sum(length(n_name)) AS BIGINT) AS total_size FROM nation GROUP BY 1""")
def q_s14t(spark, sf):
    files = S.manifest(spark, FX.mixed_folder(spark, sf)).filter(F.col("name").startswith("nation-"))
    return S.manifest_by_type(files)


@query("s15_write_csv", sql="""
SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier""")
def q_s15(spark, sf):
    """CSV sink and reader: what is written comes back."""
    from quarry.session import derived_path
    path = S.write_csv(T(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), derived_path(spark, "csv_sink", sf))
    return S.read_csv(spark, path, schema="s_suppkey long, s_name string, s_nationkey int, s_acctbal double")


@query("s7_read_parquet_pushdown", sql="""
SELECT count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01' AND l_discount > 0.05""")
def q_s7(spark, sf):
    """Filter and projection reach the parquet scan (PushedFilters / ReadSchema)."""
    li = S.read_parquet(spark, f"{sf}/lineitem.parquet")
    f = li.filter((F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz")) & (F.col("l_discount") > 0.05))
    return round_doubles(f.agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty")), 2)


@query("s8_read_text_lines", sql="""
SELECT CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines,
       CAST(sum(length(replace(text, chr(10), ''))) AS BIGINT) AS chars FROM documents""")
def q_s8(spark, sf):
    lines = S.read_text_lines(spark, FX.text_documents_path(spark, sf))
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("value")).cast("bigint").alias("chars"))


@query("s10_read_xml", sql="SELECT n_nationkey, n_name, n_regionkey FROM nation")
def q_s10(spark, sf):
    return S.read_xml(spark, FX.xml_nation_path(spark, sf), "nation",
                      schema="n_nationkey int, n_name string, n_regionkey int")


@query("s14_manifest", sql="""
SELECT regexp_extract(filename, '([^/]+)$', 1) AS name, size,
       '.parquet' AS extension, 'parquet' AS type, false AS accepted, regexp_extract(filename, '([^/]+)$', 1) AS safe_name,
       CASE WHEN size < 1024 THEN printf('%.1f B', size::DOUBLE) WHEN size < 1024*1024 THEN printf('%.1f KB', size / 1024.0)
            WHEN size < 1024*1024*1024 THEN printf('%.1f MB', size / 1048576.0) ELSE printf('%.1f GB', size / 1073741824.0) END AS size_text,
       false AS is_question_file, 11 AS source_rank
FROM read_blob('/root/testdata/sf0.01/*.parquet')""")
def q_s14(spark, sf):
    """File manifest of the input folder (lengths only; content is pruned)."""
    return S.manifest(spark, sf).drop("path").withColumn("source_rank", F.col("source_rank").cast("int"))


@query("s17_read_results", sql="""
SELECT 'o_orderpriority=' || o_orderpriority AS run_dir, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY o_orderpriority""")
def q_s17(spark, sf):
    df = S.read_results(spark, FX.result_runs_path(spark, sf) + "/*/*.json", schema="n_orders long, total double")
    return df.select("run_dir", "n_orders", "total")


@query("s17_damaged_results", sql="""
SELECT 'run=run-' || substring(o_orderpriority, 1, 1) AS run_dir, CAST(count(DISTINCT o_orderpriority) FILTER (WHERE o_orderpriority NOT LIKE '3%') AS BIGINT) AS n_rows,
  CAST(count(DISTINCT o_orderpriority) FILTER (WHERE o_orderpriority LIKE '3%') AS BIGINT) AS n_damaged,
  CASE WHEN any_value(o_orderpriority) LIKE '3%' THEN NULL ELSE count(*) END AS n_orders,
  CASE WHEN any_value(o_orderpriority) LIKE '3%' THEN 20 END AS damaged_chars
FROM orders GROUP BY o_orderpriority""")
def q_s17d(spark, sf):
    """Five runs, of which one file is cut off: it is counted and its text kept, the others are read."""
    df = S.read_results(spark, FX.damaged_runs_path(spark, sf) + "/*/*.txt", schema="n_orders long, total double")
    per = df.groupBy("run_dir").agg(F.max("n_orders").alias("n_orders"), F.max(F.length(F.regexp_replace("_corrupt_record", "\\s+$", ""))).alias("damaged_chars"))
    return S.result_health(df).join(per, "run_dir")


@query("s17_text_results", sql="""
SELECT 'run=run-' || substring(o_orderpriority, 1, 1) AS run_dir, CASE WHEN o_orderpriority LIKE '3%' THEN 'false' ELSE 'true' END AS whole,
  '{"n_orders":' || substring(CAST(count(*) AS VARCHAR), 1, 6) AS starts FROM orders GROUP BY o_orderpriority""")
def q_s17t(spark, sf):
    """The same runs' files as text outputs."""
    t = S.read_text_results(spark, FX.damaged_runs_path(spark, sf) + "/*/*.txt")
    text = F.trim(F.regexp_replace("text", "\\s+$", ""))
    return t.select("run_dir", F.endswith(text, F.lit("}")).cast("string").alias("whole"), F.substring_index(text, ",", 1).alias("starts"))


@query("s18_extract_urls", sql=r"""
SELECT page_id, unnest(regexp_extract_all(html, 'https?://\S+')) AS url FROM """ + FX.questions_sql("pages", "page_id", "html"))
def q_s18(spark, sf):
    p = FX.questions_synth(T(spark, sf, "pages").select("page_id", "html"), "page_id", "html")
    return p.select("page_id", F.explode(S.extract_urls(F.col("html"))).alias("url"))


@query("s11_zip_members", sql="""
WITH c AS (SELECT CAST(floor(c_custkey / 500) AS BIGINT) AS block,
                  length(CAST(c_custkey AS VARCHAR) || ',' || c_name || ',' || n_name) + 1 AS bytes
           FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT block, 'extracted_customers.csv' AS member, CAST(length('c_custkey,c_name,n_name') + 1 + sum(bytes) AS BIGINT) AS size,
       CAST(count(*) + 1 AS BIGINT) AS lines FROM c GROUP BY block
UNION ALL
SELECT DISTINCT block, 'extracted_notes.txt', CAST(length('block ' || block) + 1 AS BIGINT), CAST(1 AS BIGINT) FROM c""")
def q_s11(spark, sf):
    """ZIP archives -> members (directories and hidden members skipped, names
    flattened with the extracted_ prefix); line counts of the text members."""
    m = S.zip_members(spark, FX.zip_archives_dir(spark, sf))
    block = F.regexp_extract(F.url_decode("archive"), r"block=(\d+)\.zip$", 1).cast("bigint")
    text = F.decode(F.col("content"), "UTF-8")
    lines = F.size(F.split(F.regexp_replace(text, "\n$", ""), "\n")).cast("bigint")
    return m.select(block.alias("block"), "member", "size", lines.alias("lines"))
