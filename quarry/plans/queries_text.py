"""Registered queries: HTML page corpus (H*), question routing and text
matching (X*, Q7) and answers (O*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.columns import round_doubles
from quarry.operators import jsonops as J
from quarry.operators import pages as H
from quarry.plans import fixtures as FX
from quarry.plans.catalog import T, query
from quarry.session import cut_lineage
from quarry.sources import tables as TB

# ------------------------------------------------------------------ pages

PG = """WITH sup AS (SELECT s.*, n.n_regionkey, CAST(floor(s_suppkey / 50) AS BIGINT) AS block
             FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey),
pg AS (SELECT n_regionkey, block, CAST(block * 10 + n_regionkey AS BIGINT) AS page_id, count(*) AS n_sup
       FROM sup GROUP BY 1, 2),
nat AS (SELECT n_regionkey, count(*) AS n_nat FROM nation GROUP BY 1),
tb AS (
  SELECT page_id, 0 AS table_idx, 'Nations of ' || r_name AS caption, 'Rank|Name|Region' AS headers,
         1 + n_nat AS row_count, 3 AS col_count, 'wikitable sortable' AS classes, 3 * (1 + n_nat) AS cell_count,
         n_nat AS data_rows, 3 AS data_cols
  FROM pg JOIN region ON r_regionkey = pg.n_regionkey JOIN nat USING (n_regionkey)
  UNION ALL
  SELECT page_id, 1, NULL, 'Key|Supplier|Balance', 1 + n_sup, 3, '', 3 * (1 + n_sup), n_sup, 3 FROM pg
  UNION ALL
  SELECT page_id, 2, NULL, '', 2, 2, '', 4, 1, 2 FROM pg)
"""


def synth_tables(spark, sf):
    return H.page_tables(H.parse_pages(FX.pages_synth(spark, sf)))


@query("s9_read_html_files", sql=PG + """
SELECT page_id, CAST(count(*) AS INTEGER) AS n_tables, CAST(sum(row_count) AS BIGINT) AS n_rows FROM tb GROUP BY page_id""")
def q_s9(spark, sf):
    """A folder of .html files (one per synthetic page) read whole-file,
    then parsed; the page id comes back from the file name."""
    from quarry.sources import files as SRC
    docs = SRC.read_text_documents(spark, FX.html_files_dir(spark, sf))
    pid = F.regexp_extract(F.url_decode("file"), r"page_id=(\d+)/", 1).cast("bigint")
    t = H.page_tables(H.parse_pages(docs.select(pid.alias("page_id"), F.col("value").alias("html"))))
    return t.groupBy("page_id").agg(F.count(F.lit(1)).cast("int").alias("n_tables"),
                                    F.sum("row_count").cast("bigint").alias("n_rows"))


@query("h1_table_extraction", sql=PG + """
SELECT page_id, CAST(table_idx AS INTEGER) AS table_idx, caption, headers, CAST(row_count AS INTEGER) AS row_count,
       CAST(col_count AS INTEGER) AS col_count, classes FROM tb""")
def q_h1(spark, sf):
    """Synthetic pages built from region/nation/supplier parse back to their tables."""
    t = synth_tables(spark, sf)
    return t.select("page_id", "table_idx", "caption", F.array_join("headers", "|").alias("headers"),
                    "row_count", "col_count", F.array_join("classes", " ").alias("classes"))


@query("h1_supplier_cells", sql=PG + """
SELECT CAST(floor(s_suppkey / 50) * 10 + n_regionkey AS BIGINT) AS page_id, s_suppkey, s_name, s_acctbal FROM sup""")
def q_h1c(spark, sf):
    """H1 + H15: the supplier table's data rows (key filter ^\\d+$, money cleaning)
    are exactly the supplier rows."""
    t = synth_tables(spark, sf).filter(F.col("table_idx") == 1)
    rows = H.scraped_rows(t, money_col=2)
    return rows.select("page_id", F.col("cells")[0].cast("bigint").alias("s_suppkey"),
                       F.col("cells")[1].alias("s_name"), F.col("money").alias("s_acctbal"))


@query("h8_nation_cells", sql=PG + """
SELECT page_id, n_nationkey, n_name FROM pg JOIN nation USING (n_regionkey)""")
def q_h8(spark, sf):
    """Nation cells carry a link and a footnote <sup>; simplification keeps the name only."""
    t = synth_tables(spark, sf).filter(F.col("table_idx") == 0)
    rows = H.scraped_rows(t)
    return rows.select("page_id", F.col("cells")[0].cast("int").alias("n_nationkey"), F.col("cells")[1].alias("n_name"))


@query("h2_remove_blocks", sql=r"""
SELECT page_id, length(html) AS original_size,
  length(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g')) AS stripped_size FROM pages""")
def q_h2(spark, sf):
    p = T(spark, sf, "pages")
    return p.select("page_id", F.length("html").cast("bigint").alias("original_size"),
                    F.length(H.remove_blocks_regex(F.col("html"))).cast("bigint").alias("stripped_size"))


@query("h5_relevance", sql=PG + """
SELECT page_id, CAST(table_idx AS INTEGER) AS table_idx, (table_idx = 0) OR (row_count > 5) AS relevant FROM tb""")
def q_h5(spark, sf):
    return H.relevance(synth_tables(spark, sf)).select("page_id", "table_idx", "relevant")


@query("h6_section_divs", sql=PG + "SELECT page_id, 0 AS n_section_divs, 3 AS cleaned_tables FROM pg")
def q_h6(spark, sf):
    parsed = H.parse_pages(FX.pages_synth(spark, sf))
    return parsed.select("page_id", "n_section_divs", "cleaned_tables")


@query("h7_strategy", sql=PG + """
SELECT page_id, CAST(table_idx AS INTEGER) AS table_idx, CASE WHEN table_idx = 0 THEN 1 END AS strategy FROM tb""")
def q_h7(spark, sf):
    return H.strategy(synth_tables(spark, sf)).select("page_id", "table_idx", "strategy")


@query("h9_formatting_tables", sql=PG + """
SELECT page_id, CAST(table_idx AS INTEGER) AS table_idx, row_count <= 2 OR cell_count < 4 AS is_formatting FROM tb""")
def q_h9(spark, sf):
    return H.formatting_flag(synth_tables(spark, sf)).select("page_id", "table_idx", "is_formatting")


@query("h10_cleaning_metrics")
def q_h10(spark, sf):
    """Before/after tables and sizes of the page corpus (parse job)."""
    return round_doubles(H.cleaning_metrics(cut_lineage(H.parse_pages(T(spark, sf, "pages")))))


# ---- pages whose parts vary with the supplier's key (fixtures.pages_varied)

VP = """WITH vp AS (SELECT s_suppkey AS k, s_suppkey % 5 AS kind,
    CASE WHEN s_suppkey % 2 = 0 THEN 1 WHEN s_suppkey % 4 = 1 THEN 3 ELSE 0 END AS nr,
    CASE WHEN s_suppkey % 11 = 0 THEN 0 WHEN s_suppkey % 8 = 0 THEN 2 ELSE 1 END AS copies,
    CASE WHEN s_suppkey % 5 = 4 THEN s_suppkey % 3 ELSE 3 + s_suppkey % 30 END AS r FROM supplier),
vm AS (SELECT *, CAST(kind < 4 AS BIGINT) AS h, CASE WHEN kind = 4 THEN 0 WHEN kind = 3 THEN 5 ELSE 3 END AS hc, 1 + CAST(nr > 0 AS BIGINT) AS per FROM vp),
vt AS (
  SELECT k, kind, 'main' AS what, c * per AS table_idx, h + r + 3 + nr AS row_count, hc + 3 * r + 3 + 2 * nr + 4 AS cell_count, h, r, nr
  FROM (SELECT *, unnest(range(copies)) AS c FROM vm)
  UNION ALL SELECT k, kind, 'nested', c * per + 1, nr, 2 * nr, 0, 0, nr FROM (SELECT *, unnest(range(copies)) AS c FROM vm) WHERE nr > 0
  UNION ALL SELECT k, kind, 'box', copies * per, 1, 1, 0, 0, 0 FROM vm WHERE k % 13 = 1),
rel AS (SELECT *, what = 'main' AND kind IN (0, 2) OR row_count > 5 AS relevant FROM vt)
"""


def varied(spark, sf):
    # parsed once: the parts below read it more than once
    return cut_lineage(H.parse_pages(FX.pages_varied(spark, sf)))


@query("p6_page_flags", sql="""
SELECT s_suppkey AS page_id, s_suppkey % 11 <> 0 OR s_suppkey % 13 < 2 AS has_tables, s_suppkey % 7 = 0 AS has_forms,
  s_suppkey % 3 = 0 AS has_scripts FROM supplier""")
def q_p6f(spark, sf):
    from quarry.operators import profile as P
    return P.html_profile(FX.pages_varied(spark, sf)).select("page_id", "has_tables", "has_forms", "has_scripts")


@query("h1_span_cells", sql=VP + """
SELECT k AS page_id, table_idx, CAST(h + r + n AS INTEGER) AS row_idx,
  CASE n WHEN 0 THEN 'n|o|' || CASE nr WHEN 1 THEN 'xy' WHEN 3 THEN 'uvuvuv' ELSE 'none' END
    ELSE CASE WHEN k % 9 = 0 THEN 'Titanic' ELSE 'end' END || CASE n WHEN 1 THEN '|both|both' ELSE '|p|q' END END AS cells
FROM vt, (SELECT unnest([0, 1, 2]) AS n) WHERE what = 'main'""")
def q_h1s(spark, sf):
    """The last three rows of every main table: a nested table's text, spanned cells in each place."""
    t = H.page_tables(varied(spark, sf)).filter(F.size("rows") > 3 - F.lit(1)).filter("cell_count > 6 and nested_tables <= 1")
    rows = t.select("page_id", F.col("table_idx").cast("bigint").alias("table_idx"), F.posexplode("rows").alias("row_idx", "cells"), F.size("rows").alias("n"))
    return rows.filter("row_idx >= n - 3").select("page_id", "table_idx", "row_idx", F.array_join("cells", "|").alias("cells"))


@query("h4_wiki_rules", sql=VP + """
SELECT k AS page_id, k % 13 = 0 AS wiki, CAST(copies * per + CAST(k % 13 < 2 AS INTEGER) AS INTEGER) AS original_tables,
  CAST(copies * per + CAST(k % 13 = 1 AS INTEGER) AS INTEGER) AS cleaned_tables FROM vm""")
def q_h4(spark, sf):
    """Navigation boxes go from pages that name wikipedia.org, and stay elsewhere."""
    return H.parse_pages(FX.pages_varied(spark, sf)).select("page_id", "wiki", "original_tables", "cleaned_tables")


@query("h6_sections", sql=VP + """,
found AS (SELECT k, 'table' AS kind, table_idx AS idx, what FROM rel WHERE relevant
  UNION ALL SELECT k, 'div', 0, 'div' FROM vm WHERE k % 6 IN (1, 3)),
kept AS (SELECT *, false AS fallback FROM found
  UNION ALL SELECT k, 'table', table_idx, what, true FROM rel WHERE k NOT IN (SELECT k FROM found))
SELECT k AS page_id, kind, CAST(idx AS INTEGER) AS idx, fallback,
  CAST(kind = 'table' AND what <> 'box' AND k % 6 = 3 AS BIGINT) + CAST(what = 'nested' AND (SELECT count(*) FROM kept o
    WHERE o.k = kept.k AND o.what = 'main' AND o.idx = kept.idx - 1) > 0 AS BIGINT) AS within FROM kept""")
def q_h6s(spark, sf):
    """Relevant tables and divs, all tables where a page has neither, and what lies within what."""
    return H.sections(varied(spark, sf)).select("page_id", "kind", "idx", "fallback", "within")


@query("h7_strategies", sql=VP + """
SELECT k AS page_id, CAST(table_idx AS INTEGER) AS table_idx, CASE WHEN what = 'main' AND kind < 4 THEN kind + 1
  WHEN kind = 4 AND cell_count >= 10 THEN 5 WHEN what = 'box' AND k % 11 = 0 AND cell_count >= 10 THEN 5 END AS strategy FROM vt""")
def q_h7s(spark, sf):
    """All five strategies, the last one on pages where none of the others finds a table."""
    return H.strategy(H.page_tables(varied(spark, sf))).select("page_id", "table_idx", F.col("strategy").cast("bigint").alias("strategy"))


@query("h9_nested_tables", sql=VP + """
SELECT k AS page_id, CAST(table_idx - 1 AS INTEGER) AS outer_idx, CAST(table_idx AS INTEGER) AS table_idx, CAST(1 AS BIGINT) AS depth, nr = 1 AS is_formatting,
  CASE WHEN nr = 1 THEN 'xy' END AS replaced_by, nr = 1 AS gone FROM vt WHERE what = 'nested'""")
def q_h9n(spark, sf):
    return H.nested_tables(varied(spark, sf))


SCORE_SQL = """score AS (SELECT *, CASE WHEN h + r + 2 > 20 THEN 10 ELSE 0 END + CASE WHEN kind = 3 THEN 20 WHEN kind = 0 THEN 15 ELSE 0 END
  + CASE WHEN k % 9 = 0 THEN 2 ELSE 0 END AS score FROM vt WHERE what = 'main')
"""


@query("h11_best_tables", sql=VP + "," + SCORE_SQL + """
SELECT k AS page_id, CAST(min(table_idx) AS INTEGER) AS table_idx, CAST(any_value(score) AS INTEGER) AS score FROM score WHERE score > 0 GROUP BY k""")
def q_h11b(spark, sf):
    """Ties (a page with the same table twice) go to the first table; pages without a score have none."""
    return H.pick_first_best(H.best_table_score(H.page_tables(varied(spark, sf)))).select("page_id", "table_idx", "score")


@query("h14_page_titles", sql=VP + """
SELECT k AS page_id, 'Supplier ' || k AS title, CAST(copies * per + CAST(k % 13 = 1 AS INTEGER) AS INTEGER) AS total_tables FROM vm""")
def q_h14t(spark, sf):
    return H.page_summary(H.parse_pages(FX.pages_varied(spark, sf)))


@query("h15_named_cells", sql=VP + """
SELECT k AS page_id, CAST(table_idx AS INTEGER) AS table_idx, CAST(h + i - 1 AS INTEGER) AS row_idx, CAST(i AS VARCHAR) AS "Rank",
  'Item ' || i || ' of ' || s_name AS "Peak", '$' || i || ',000' AS "Title", CAST(NULL AS VARCHAR) AS "Worldwide_Gross", CAST(NULL AS VARCHAR) AS "Year"
FROM (SELECT *, unnest(range(1, r + 1)) AS i FROM vt WHERE what = 'main') JOIN supplier ON s_suppkey = k""")
def q_h15(spark, sf):
    """Data rows under positional names; the places beyond a row's cells are NULL."""
    return H.named_cells(H.scraped_rows(H.page_tables(H.parse_pages(FX.pages_varied(spark, sf)))))


@query("h16_page_metadata", sql=VP + "," + SCORE_SQL + """,
b AS (SELECT k, min(table_idx) AS idx FROM score WHERE score > 0 GROUP BY k),
item AS (SELECT k, [CAST(i AS VARCHAR) || '|Item ' || i || ' of ' || s_name || '|$' || i || ',000' for i in range(1, 1 + r)] AS items
  FROM vm JOIN supplier ON s_suppkey = k)
SELECT s.k AS page_id, (SELECT count(*) FROM vt WHERE vt.k = s.k) AS tables_found, CAST(idx AS INTEGER) AS best_table_idx,
  CAST(h + r + 2 AS INTEGER) AS best_rows, CASE WHEN kind = 3 THEN 5 ELSE 3 END AS best_cols, CAST(score AS INTEGER) AS best_score,
  CASE kind WHEN 0 THEN 'Rank,Title,Gross' WHEN 3 THEN 'Rank,Peak,Title,Worldwide,Year' ELSE 'A,B,C' END AS columns,
  array_to_string(list_slice(items, 1, 3), ';') AS sample
FROM score s JOIN b ON b.k = s.k AND b.idx = s.table_idx JOIN item ON item.k = s.k WHERE kind < 4""")
def q_h16m(spark, sf):
    """Best table per page with its first three data rows (pages whose best table has a header)."""
    m = H.extraction_metadata(H.page_tables(varied(spark, sf))).filter(F.col("page_id") % 5 != 4)
    return m.withColumn("sample", F.array_join("sample", ";"))


@query("h11_best_table", sql=PG + """
SELECT page_id, 0 AS table_idx, 15 AS score FROM pg""")
def q_h11(spark, sf):
    best = H.pick_first_best(H.best_table_score(synth_tables(spark, sf)))
    return best.select("page_id", "table_idx", "score")


@query("h12_film_score", sql=PG + """
SELECT page_id, CAST(table_idx AS INTEGER) AS table_idx,
  CASE table_idx WHEN 0 THEN 8 WHEN 1 THEN CASE WHEN row_count > 50 THEN 5 WHEN row_count > 20 THEN 3 ELSE 0 END ELSE 0 END AS film_score
FROM tb""")
def q_h12(spark, sf):
    return H.film_score(synth_tables(spark, sf)).select("page_id", "table_idx", "film_score")


@query("h13_likely_data_table", sql=PG + """
SELECT page_id, CAST(table_idx AS INTEGER) AS table_idx,
  CASE WHEN table_idx = 0 THEN 'Film-related headers, Wikipedia data table class'
       WHEN row_count > 20 THEN 'Large dataset (' || row_count || ' rows)' ELSE '' END AS reasons,
  table_idx = 0 OR row_count > 20 AS likely_data_table FROM tb""")
def q_h13(spark, sf):
    t = H.likely_data_table(synth_tables(spark, sf))
    return t.select("page_id", "table_idx", F.array_join("reasons", ", ").alias("reasons"), "likely_data_table")


@query("h14_page_summary", sql=PG + """
SELECT page_id, CAST(table_idx AS INTEGER) AS table_idx, coalesce(caption, 'None') AS caption,
  CASE WHEN headers = '' THEN 'None' ELSE replace(headers, '|', ', ') END AS headers,
  row_count || ' rows x ' || col_count || ' columns' AS dimensions,
  CASE WHEN classes = '' THEN 'None' ELSE replace(classes, ' ', ', ') END AS classes FROM tb""")
def q_h14(spark, sf):
    return H.table_summary(synth_tables(spark, sf))


@query("h16_extraction_metadata", sql=PG + """
SELECT page_id, CAST(3 AS BIGINT) AS tables_found, 0 AS best_table_idx, CAST(n_nat AS INTEGER) AS best_rows,
       3 AS best_cols, 15 AS best_score, 'Rank,Name,Region' AS columns FROM pg JOIN nat USING (n_regionkey)""")
def q_h16(spark, sf):
    t = synth_tables(spark, sf)
    found = t.groupBy("page_id").agg(F.count(F.lit(1)).alias("tables_found"))
    best = H.pick_first_best(H.best_table_score(t)).select(
        "page_id", F.col("table_idx").alias("best_table_idx"), F.col("data_rows").alias("best_rows"),
        F.col("data_cols").alias("best_cols"), F.col("score").alias("best_score"),
        F.array_join(F.col("rows")[0], ",").alias("columns"))
    return found.join(best, "page_id")


# ------------------------------------------------------------------ questions

from quarry.operators import answers as O  # noqa: E402
from quarry.operators import questions as X  # noqa: E402


def _sql_lit(w: str) -> str:
    return "'" + w.replace("'", "''") + "'"


def _sql_hits(expr: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({expr}, {_sql_lit(w)}) AS INTEGER)" for w in words) + ")"


def _sql_any(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, {_sql_lit(w)})" for w in words) + ")"


LOWTXT = "lower(coalesce(text, ''))"
CONVERSATIONS = FX.questions_sql("conversations", "conv_id + turn")
DOCUMENTS = FX.questions_sql("documents", "doc_id")
USER_TURNS = CONVERSATIONS + " WHERE role = 'user'"


def conversations(spark, sf):
    return FX.questions_synth(T(spark, sf, "conversations"), "conv_id + turn")


def documents(spark, sf):
    return FX.questions_synth(T(spark, sf, "documents"), "doc_id")




def _task_sql() -> str:
    names = list(X.TASK_VOCABULARIES)
    scores = ", ".join(f"{_sql_hits(LOWTXT, X.TASK_VOCABULARIES[n])} AS score_{n}" for n in names)
    best = "greatest(" + ", ".join(f"score_{n}" for n in names) + ")"
    pick = " ".join(f"WHEN score_{n} = {best} THEN '{n}'" for n in names)
    return f"""SELECT conv_id, turn, CASE WHEN text IS NULL OR text = '' THEN 'custom' WHEN {best} = 0 THEN 'custom' {pick} END
  AS task_type, {", ".join(f"score_{n}" for n in names)} FROM (SELECT conv_id, turn, text, {scores} FROM {USER_TURNS})"""


@query("x1_task_type", sql=_task_sql())
def q_x1(spark, sf):
    c = conversations(spark, sf).filter(F.col("role") == "user")
    return c.select("conv_id", "turn", X.task_type(F.col("text")).alias("task_type"), *X.task_scores(F.col("text")))


def _analysis_sql() -> str:
    chain = " ".join(f"WHEN {_sql_any(LOWTXT, words)} THEN '{name}'" for name, words in X.ANALYSIS_CHAIN)
    return f"SELECT conv_id, turn, CASE {chain} ELSE 'general' END AS analysis_type FROM {USER_TURNS}"


@query("x2_analysis_type", sql=_analysis_sql())
def q_x2(spark, sf):
    c = conversations(spark, sf).filter(F.col("role") == "user")
    return c.select("conv_id", "turn", X.analysis_type(F.col("text")).alias("analysis_type"))


_NO_KEYWORD = "Is there more to see?"


@query("x2_json_analysis", sql=f"""
WITH d AS (SELECT c_custkey AS id, c_custkey % 5 AS k, CASE WHEN c_custkey % 3 = 0 THEN 'Show the trend' ELSE '{_NO_KEYWORD}' END AS q FROM customer)
SELECT id, CASE WHEN id % 3 = 0 THEN 'timeseries' WHEN k IN (0, 1) THEN 'json' WHEN k = 3 AND id % 2 = 0 THEN 'timeseries'
  WHEN k = 3 THEN 'network' ELSE 'general' END AS analysis_type FROM d""")
def q_x2j(spark, sf):
    """Questions without a keyword over the JSON documents: the documents' structure and keys decide."""
    docs = FX.json_synth(spark, sf)
    # the dicts of lists get keys that name a time or an edge
    renamed = F.regexp_replace("js", '"segments"', F.when(F.col("id") % 2 == 0, '"created_on"').otherwise('"target_node"'))
    docs = docs.withColumn("js", F.when(F.col("id") % 5 == 3, renamed).otherwise(F.col("js")))
    q = F.when(F.col("id") % 3 == 0, "Show the trend").otherwise(_NO_KEYWORD)
    prof = J.json_profile(docs)
    return prof.select("id", X.analysis_type(q, X.json_analysis(F.col("suggested_analysis"), F.col("keys"), F.col("complexity"))).alias("analysis_type"))


def _keywords_sql() -> str:
    parts = ["[" + ", ".join(_sql_lit(w) for w in X.BASE_KEYWORDS) + "]"]
    for triggers, words in X.DOMAIN_KEYWORDS:
        parts.append(f"CASE WHEN {_sql_any(LOWTXT, triggers)} THEN [" + ", ".join(_sql_lit(w) for w in words)
                     + "] ELSE []::VARCHAR[] END")
    stop = ", ".join(_sql_lit(w) for w in X.STOP_WORDS)
    words = (r"list_slice(list_filter(regexp_extract_all(coalesce(text, ''), '[\pL\pN_]+'), "
             f"lambda w: regexp_full_match(w, '[a-zA-Z]+') AND length(w) > 4 AND lower(w) NOT IN ({stop})), 1, 5)")
    allw = "flatten([" + ", ".join(parts + [words]) + "])"
    return f"SELECT doc_id, array_to_string(list_sort(list_distinct({allw})), ',') AS keywords FROM {DOCUMENTS}"


@query("x3_question_keywords", sql=_keywords_sql())
def q_x3(spark, sf):
    d = documents(spark, sf)
    return d.select("doc_id", F.array_join(X.question_keywords(F.col("text")), ",").alias("keywords"))


@query("x4_numbered_lines", sql=r"""
SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '(?m)^\s*\d+\.\s')) AS INTEGER) AS numbered_lines FROM """ + DOCUMENTS)
def q_x4(spark, sf):
    return documents(spark, sf).select("doc_id", X.numbered_lines(F.col("text")).alias("numbered_lines"))


@query("x4_key_items", sql=r"""
WITH l AS (SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM """ + CONVERSATIONS + r"""),
s AS (SELECT conv_id, turn, line_no, trim(line) AS s FROM l)
SELECT conv_id, turn, CAST(line_no AS INTEGER) AS line_no,
       trim(regexp_replace(trim(split_part(substring(s, 3), ':', 1)), '^`+|`+$', '', 'g')) AS key,
       trim(regexp_extract(substring(s, 3), '^[^:]*:(.*)$', 1)) AS type
FROM s WHERE starts_with(s, '- ') AND contains(s, ':')""")
def q_x4k(spark, sf):
    c = conversations(spark, sf).withColumn("_id", F.struct("conv_id", "turn"))
    items = X.key_items(c, "_id", "text")
    return items.select(F.col("_id.conv_id").alias("conv_id"), F.col("_id.turn").alias("turn"), "line_no", "key", "type")


def _dict_sql() -> str:
    rows = ", ".join(f"({_sql_lit(c)}, {_sql_lit(k)})" for c, ks in X.TASK_VOCABULARIES.items() for k in ks)
    return f"""
WITH d AS (SELECT category, keyword, array_to_string(regexp_extract_all(lower(keyword), '[a-z0-9]+'), ' ') AS gram
           FROM (VALUES {rows}) AS v(category, keyword)),
t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS tok FROM {DOCUMENTS}),
g AS (SELECT DISTINCT doc_id, gram FROM (
  SELECT doc_id, array_to_string(list_slice(tok, i, i + n - 1), ' ') AS gram
  FROM (SELECT doc_id, tok, unnest(range(1, len(tok) + 1)) AS i FROM t), (SELECT unnest(range(1, 4)) AS n)
  WHERE i + n - 1 <= len(tok)))
SELECT doc_id, category, count(DISTINCT keyword) AS hits FROM g JOIN d USING (gram) GROUP BY 1, 2"""


@query("x7_dictionary_hits", sql=_dict_sql())
def q_x7(spark, sf):
    """Whole-word / phrase hits of the category vocabularies over all documents."""
    d = documents(spark, sf)
    return X.dictionary_hits(d, "doc_id", "text", X.vocabulary_table(spark))


def _sqlq_sql() -> str:
    low = LOWTXT
    return f"""SELECT conv_id, turn,
  (({_sql_hits(low, X.SQL_WORDS)} >= 2 AND {_sql_hits(low, X.DB_WORDS)} >= 1)
   OR regexp_matches(coalesce(text, ''), '(?i)(s3|gs)://[^\\s]+\\.(parquet|csv|json)|https?://[^\\s]+\\.(parquet|csv|json)')
   OR (contains({low}, 'install httpfs') AND contains({low}, 'load httpfs'))
   OR (contains({low}, 'read_parquet') AND contains({low}, 's3://'))) AS is_sql FROM {CONVERSATIONS}"""


@query("q7_sql_question", sql=_sqlq_sql())
def q_q7(spark, sf):
    return conversations(spark, sf).select("conv_id", "turn", X.is_sql_question(F.col("text")).alias("is_sql"))


# ------------------------------------------------------------------ SQL entry


def _views(spark, sf, names):
    from quarry.sources.tables import register_views
    register_views(spark, sf, names)


@query("q1_sql_over_views", sql="""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-12-01' GROUP BY 1, 2""")
def q_q1(spark, sf):
    _views(spark, sf, ["lineitem"])
    return spark.sql("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
                               round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
                        FROM lineitem WHERE l_shipdate <= TIMESTAMP_NTZ '2000-12-01 00:00:00' GROUP BY 1, 2""")


@query("q2_file_table_function", sql="""
SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1""")
def q_q2(spark, sf):
    """read_parquet('...')-style access: Spark SQL's direct file query."""
    return spark.sql(f"SELECT o_orderpriority, count(*) AS n FROM parquet.`{sf}/orders.parquet` GROUP BY 1")


@query("q2_sql_over_csv", sql="""
SELECT l_returnflag, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty, min(CAST(l_shipdate AS DATE)) AS first_day
FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 100 = 4) GROUP BY 1""")
def q_q2c(spark, sf):
    """read_csv('...') in a FROM clause: the folder as a view with the types that a scan infers."""
    TB.register_file(spark, "lines_csv", FX.csv_dirty_path(spark, sf))
    return spark.sql("""SELECT l_returnflag, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty, min(CAST(l_shipdate AS DATE)) AS first_day
                        FROM lines_csv GROUP BY 1""")


@query("q2_sql_over_json", sql="""
SELECT e.event_type, count(*) AS n, count(DISTINCT o.o_custkey) AS customers, CAST(max(o.o_orderkey) AS BIGINT) AS last_order
FROM events e JOIN orders o ON o.o_custkey = e.user_id GROUP BY 1""")
def q_q2j(spark, sf):
    """JSON lines joined with whole JSON documents, both by file path, in one statement."""
    TB.register_file(spark, "events_json", FX.jsonl_events_path(spark, sf), format="jsonl")
    TB.register_file(spark, "orders_json", FX.json_array_docs_path(spark, sf), format="json")
    return spark.sql("""SELECT e.event_type, count(*) AS n, count(DISTINCT o.o_custkey) AS customers, CAST(max(o.o_orderkey) AS BIGINT) AS last_order
                        FROM events_json e JOIN orders_json o ON o.o_custkey = e.user_id GROUP BY 1""")


@query("q3_q5_date_functions", sql="""
SELECT o_orderkey, CAST(datediff('day', o_orderdate, max_ship) AS INTEGER) AS ship_days,
       CAST(CAST(max_ship AS DATE) - CAST(o_orderdate AS DATE) AS INTEGER) AS minus_days, CAST(o_orderdate AS DATE) AS order_day
FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS max_ship FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def q_q35(spark, sf):
    """DATE_DIFF('day', a, b), date1 - date2 and ::DATE in Spark SQL."""
    _views(spark, sf, ["orders", "lineitem"])
    return spark.sql("""SELECT o_orderkey, CAST(datediff(DAY, o_orderdate, max_ship) AS INT) AS ship_days,
                               datediff(max_ship::DATE, o_orderdate::DATE) AS minus_days, o_orderdate::DATE AS order_day
                        FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS max_ship FROM lineitem GROUP BY 1)
                          ON l_orderkey = o_orderkey""")


@query("q6_string_agg", sql="""
SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def q_q6(spark, sf):
    _views(spark, sf, ["nation", "region"])
    return spark.sql("""SELECT r_name, string_agg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS nations
                        FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")


# ------------------------------------------------------------------ answers

SALES_KEYS = [("total_sales", "number"), ("top_nation", "string"), ("day_sales_correlation", "number"),
              ("median_sales", "number"), ("total_sales_tax", "number"), ("sales_chart", "base64 PNG string")]


@query("o1_answer_object", sql="""
WITH j AS (SELECT o.o_totalprice AS price, o.o_orderdate AS d, n.n_name FROM orders o
           JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey)
SELECT round(sum(price), 2) AS total_sales,
       (SELECT n_name FROM j GROUP BY n_name ORDER BY sum(price) DESC, n_name LIMIT 1) AS top_nation,
       round(covar_pop(dayofmonth(d), price) / nullif(stddev_pop(dayofmonth(d)) * stddev_pop(price), 0), 6) AS day_sales_correlation,
       round(median(price), 6) AS median_sales, round(sum(price) * 0.10, 3) AS total_sales_tax,
       'Missing data' AS sales_chart FROM j""")
def q_o1(spark, sf):
    """The flagship row shaped to the spec keys (the chart key is missing)."""
    from quarry.plans.queries_core import sales_report
    row = sales_report(T(spark, sf, "orders"), T(spark, sf, "customer"), T(spark, sf, "nation"))
    return O.answer_object(row, SALES_KEYS).drop("answer_json")


@query("o2_answer_array", sql="""
WITH t AS (SELECT n_name, row_number() OVER (ORDER BY count(*) DESC, n_name) AS pos FROM customer
           JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name),
p AS (SELECT unnest(range(1, 31)) AS pos)
SELECT CAST(p.pos AS INTEGER) AS pos, coalesce(t.n_name, 'No data') AS value FROM p LEFT JOIN t ON t.pos = p.pos""")
def q_o2(spark, sf):
    """Nations ranked by customer count as a 30-slot string array (padded)."""
    c = T(spark, sf, "customer").select("c_nationkey")
    n = T(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    counts = c.join(F.broadcast(n), "c_nationkey").groupBy("n_name").agg(F.count(F.lit(1)).alias("k"))
    # only the answer's 30 slots are ever gathered (distributed top-n first)
    top = counts.orderBy(F.col("k").desc(), F.col("n_name")).limit(30)
    ordered = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("k")).alias("nk"), "n_name"))).alias("s"))
    arr = ordered.select(O.answer_array(F.transform("s", lambda x: x["n_name"]), 30).alias("a"))
    return arr.select(F.posexplode("a").alias("pos", "value")).select((F.col("pos") + 1).alias("pos"), "value")


@query("o3_typed_defaults", sql="""
WITH base AS (SELECT l_returnflag, l_orderkey, l_extendedprice FROM lineitem
              UNION ALL SELECT l_returnflag, l_orderkey, l_extendedprice FROM lineitem WHERE l_orderkey % 100 = 4)
SELECT l_returnflag, CAST(sum(CASE WHEN l_orderkey % 100 IN (1, 2, 3) THEN 0 ELSE trunc(l_extendedprice) END) AS BIGINT) AS as_int,
       round(sum(CASE WHEN l_orderkey % 100 IN (1, 2, 3) THEN 0.0 ELSE l_extendedprice END), 2) AS as_double,
       count(*) FILTER (WHERE l_orderkey % 100 = 2) AS n_marker FROM base GROUP BY 1""")
def q_o3(spark, sf):
    """safe_convert on raw CSV text: int via float ('3.7' -> 3), bad -> 0 / 0.0."""
    from quarry.plans import fixtures as FX2
    from quarry.sources import files as S2
    df = S2.read_csv(spark, FX2.csv_dirty_path(spark, sf))
    raw = F.col("l_extendedprice")
    return round_doubles(df.groupBy("l_returnflag").agg(
        F.sum(O.typed(raw, "int")).alias("as_int"), F.sum(O.typed(raw, "float")).alias("as_double"),
        F.count_if(raw == "n/a").alias("n_marker")), 2)


@query("o4_json_safe", sql="""
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, value FROM events""")
def q_o4(spark, sf):
    e = T(spark, sf, "events").select("event_id", "ts", "value")
    return O.json_safe(e)
