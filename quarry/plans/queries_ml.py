"""Registered queries: machine learning (M*) and chart tables (C*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.columns import round_doubles
from quarry.operators import ml as M
from quarry.plans.catalog import T, query

DOC_FEATURES = ["n_chars", "n_lines", "mean_word_len"]


def all_features(spark, sf):
    """Text features of every document (all JVM expressions)."""
    return T(spark, sf, "documents").select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split("text", "\n")).cast("double").alias("n_lines"),
        (F.length(F.regexp_replace("text", r"\s", "")) / F.greatest(F.size(F.split(F.trim("text"), r"\s+")), F.lit(1)))
        .cast("double").alias("mean_word_len"))


def doc_features(spark, sf):
    """Label rows joined to document text features."""
    lab = T(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("label"),
                                        F.col("toxic").cast("double").alias("toxic"))
    return lab.join(all_features(spark, sf), "doc_id")


def held_out():
    """The labelled documents that no model below is fitted on."""
    return F.pmod("doc_id", F.lit(5)) == 0


@query("m1_scaling", sql="""
SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_samp(o_totalprice) FROM orders), 6) AS o_totalprice_z,
       round((o_totalprice - (SELECT min(o_totalprice) FROM orders)) / ((SELECT max(o_totalprice) FROM orders) - (SELECT min(o_totalprice) FROM orders)), 6) AS o_totalprice_minmax
FROM orders""")
def q_m1(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return round_doubles(M.zscore_minmax(o, "o_totalprice").drop("o_totalprice"))


@query("m1_standard_scaler")
def q_m1s(spark, sf):
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount")
    return M.standard_scaler(li, ["l_quantity", "l_extendedprice", "l_discount"])


@query("m2_string_index", sql="""
WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1),
r AS (SELECT p_type, CAST(row_number() OVER (ORDER BY n DESC, p_type) - 1 AS DOUBLE) AS p_type_index FROM c)
SELECT p_partkey, p_type, p_type_index FROM part JOIN r USING (p_type)""")
def q_m2(spark, sf):
    p = T(spark, sf, "part").select("p_partkey", "p_type")
    return M.encode(p, "p_type").select("p_partkey", "p_type", "p_type_index")


@query("m2_one_hot")
def q_m2o(spark, sf):
    p = T(spark, sf, "part").select("p_partkey", "p_type")
    from pyspark.ml.functions import vector_to_array
    return M.encode(p, "p_type").select("p_partkey", vector_to_array("p_type_onehot").alias("onehot"))


@query("m3_variance_selection", sql="""
SELECT 'l_quantity' AS feature, round(var_samp(l_quantity), 6) AS variance, var_samp(l_quantity) > 0.01 AS selected FROM lineitem
UNION ALL SELECT 'l_discount', round(var_samp(l_discount), 6), var_samp(l_discount) > 0.01 FROM lineitem
UNION ALL SELECT 'l_tax', round(var_samp(l_tax), 6), var_samp(l_tax) > 0.01 FROM lineitem""")
def q_m3(spark, sf):
    li = T(spark, sf, "lineitem")
    return round_doubles(M.variance_selection(li, ["l_quantity", "l_discount", "l_tax"], 0.01))


def _label_selection_sql(features, label, table, bins, top):
    cells = " UNION ALL ".join(f"""SELECT {i} AS i, '{f}' AS feature, {label} AS label,
  least(floor(({f} - (SELECT min({f}) FROM {table})) / nullif((SELECT max({f}) - min({f}) FROM {table}), 0) * {bins}), {bins - 1}) AS bin
  FROM {table}""" for i, f in enumerate(features))
    return f"""
WITH cells AS ({cells}),
n AS (SELECT i, feature, bin, label, CAST(count(*) AS DOUBLE) AS n FROM cells GROUP BY ALL),
bin AS (SELECT i, bin, sum(n) AS nb FROM n GROUP BY ALL), lab AS (SELECT i, label, sum(n) AS nl FROM n GROUP BY ALL),
tot AS (SELECT i, sum(n) AS nt FROM n GROUP BY ALL),
grid AS (SELECT t.i, nt, nb * nl / nt AS e, coalesce(n.n, 0) AS n FROM tot t JOIN bin b ON b.i = t.i JOIN lab l ON l.i = t.i
  LEFT JOIN n ON n.i = t.i AND n.bin = b.bin AND n.label = l.label),
r AS (SELECT i, sum(CASE WHEN n > 0 THEN n / nt * ln(n / e) ELSE 0 END) AS mi, sum((n - e) * (n - e) / e) AS chi FROM grid GROUP BY i)
SELECT (SELECT any_value(feature) FROM n WHERE n.i = r.i) AS feature, round(mi, 6) AS mutual_information, round(chi, 6) AS chi_square,
  ((SELECT count(*) FROM bin WHERE bin.i = r.i) - 1) * ((SELECT count(*) FROM lab WHERE lab.i = r.i) - 1) AS dof,
  row_number() OVER (ORDER BY mi DESC, i) <= {top} AS selected FROM r"""


M3_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey", "l_linenumber"]


@query("m3_label_selection", sql=_label_selection_sql(M3_FEATURES, "l_returnflag", "lineitem", 10, 3))
def q_m3l(spark, sf):
    return round_doubles(M.label_selection(T(spark, sf, "lineitem"), M3_FEATURES, "l_returnflag", 10, 3))


@query("m4_kmeans_sizes")
def q_m4(spark, sf):
    e = M.embedding_features(T(spark, sf, "embeddings"))
    return M.cluster_sizes(M.kmeans(e, 5, 1))


@query("m5_logistic_predictions")
def q_m5(spark, sf):
    """Every document scored by a model of the labelled ones outside the held-out fold."""
    docs = all_features(spark, sf).join(T(spark, sf, "labels").select(
        "doc_id", F.col("quality").cast("double").alias("label")), "doc_id", "left")
    pred = M.logistic(doc_features(spark, sf).filter(~held_out()), "label", DOC_FEATURES, docs)
    return pred.select("doc_id", "label", "prediction")


@query("m6_linear_regression", sql="""
SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
       round(regr_r2(l_extendedprice, l_quantity), 9) AS r2 FROM lineitem""")
def q_m6(spark, sf):
    out = M.linear_one_feature(T(spark, sf, "lineitem"), "l_extendedprice", "l_quantity")
    return out.select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"),
                      F.round("r2", 9).alias("r2"))


@query("m7_feature_importance")
def q_m7(spark, sf):
    return M.feature_importance(doc_features(spark, sf), "label", DOC_FEATURES)


@query("m7_correlation_ranking", sql="""
WITH d AS (SELECT l.doc_id, CAST(quality AS DOUBLE) AS label, CAST(n_chars AS DOUBLE) AS n_chars,
  CAST(len(string_split(text, chr(10))) AS DOUBLE) AS n_lines FROM labels l JOIN documents USING (doc_id))
SELECT 'n_chars' AS feature, round(abs(covar_pop(n_chars, label) / nullif(stddev_pop(n_chars) * stddev_pop(label), 0)), 6) AS abs_r FROM d
UNION ALL SELECT 'n_lines', round(abs(covar_pop(n_lines, label) / nullif(stddev_pop(n_lines) * stddev_pop(label), 0)), 6) FROM d""")
def q_m7c(spark, sf):
    return round_doubles(M.correlation_ranking(doc_features(spark, sf), "label", ["n_chars", "n_lines"]))


RULE_SQL = """WITH d AS (SELECT CAST(quality AS DOUBLE) AS label, CAST(CASE WHEN n_chars >= 2000 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS prediction
           FROM labels JOIN documents USING (doc_id))"""


def rule_predictions(spark, sf):
    """A fixed rule classifier (long documents are 'quality'), so the
    metrics and the confusion matrix have exact SQL twins."""
    f = doc_features(spark, sf)
    return f.select("label", F.when(F.col("n_chars") >= 2000, 1.0).otherwise(0.0).alias("prediction"))


@query("m8_classification_metrics", sql=RULE_SQL + """
SELECT round(count(*) FILTER (WHERE label = prediction) / count(*), 6) AS accuracy,
  round(count(*) FILTER (WHERE label = 1 AND prediction = 1) / nullif(count(*) FILTER (WHERE prediction = 1), 0), 6) AS precision,
  round(count(*) FILTER (WHERE label = 1 AND prediction = 1) / nullif(count(*) FILTER (WHERE label = 1), 0), 6) AS recall,
  round(2.0 * count(*) FILTER (WHERE label = 1 AND prediction = 1) / nullif(count(*) FILTER (WHERE prediction = 1) + count(*) FILTER (WHERE label = 1), 0), 6) AS f1
FROM d""")
def q_m8(spark, sf):
    return round_doubles(M.classification_metrics(rule_predictions(spark, sf)))


@query("m8_model_metrics")
def q_m8m(spark, sf):
    f = doc_features(spark, sf)
    pred = M.logistic(f.filter(~held_out()), "label", DOC_FEATURES, f.filter(held_out()))
    return round_doubles(M.classification_metrics(pred))


@query("m8_r2", sql="""
SELECT round(1 - sum(power(l_extendedprice - (a + b * l_quantity), 2)) / sum(power(l_extendedprice - m, 2)), 6) AS r2
FROM lineitem, (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a,
                       avg(l_extendedprice) AS m FROM lineitem)""")
def q_m8r(spark, sf):
    li = T(spark, sf, "lineitem")
    st = li.agg(F.regr_slope("l_extendedprice", "l_quantity").alias("b"), F.regr_intercept("l_extendedprice", "l_quantity").alias("a"))
    b, a = st.select("b").scalar(), st.select("a").scalar()
    pred = li.select("l_extendedprice", (a + b * F.col("l_quantity")).alias("p"))
    return round_doubles(M.r2_score(pred, "l_extendedprice", "p"))


@query("m9_confusion_matrix", sql=RULE_SQL + "SELECT label, prediction, count(*) AS n FROM d GROUP BY 1, 2")
def q_m9(spark, sf):
    return M.confusion_matrix(rule_predictions(spark, sf))


@query("m10_kfold_ols", sql="""
WITH d AS (SELECT o_orderkey % 5 AS fold, CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS x, o_totalprice AS y FROM orders),
c AS (SELECT f.fold, regr_slope(d.y, d.x) AS b, regr_intercept(d.y, d.x) AS a
      FROM (SELECT DISTINCT fold FROM d) f JOIN d ON d.fold <> f.fold GROUP BY f.fold)
SELECT d.fold, round(sqrt(avg(power(d.y - c.a - c.b * d.x, 2))), 4) AS rmse FROM d JOIN c USING (fold) GROUP BY d.fold""")
def q_m10(spark, sf):
    """5-fold CV (fold = key mod 5) of total price on order day: exact OLS per fold."""
    o = T(spark, sf, "orders").select(F.pmod("o_orderkey", F.lit(5)).alias("fold"),
                                      F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
                                      .cast("double").alias("x"), F.col("o_totalprice").alias("y"))
    return round_doubles(M.ols_kfold(o, "y", "x", "fold", 5), 4)


@query("m11_pca")
def q_m11(spark, sf):
    e = M.embedding_features(T(spark, sf, "embeddings"))
    return M.pca(e, 2).select("vec_id", "label", "pcs")


@query("m12_learning_curve")
def q_m12(spark, sf):
    return round_doubles(M.learning_curve(doc_features(spark, sf), "label", DOC_FEATURES, "doc_id"))


@query("m10_cross_validator")
def q_m10cv(spark, sf):
    """Spark ML CrossValidator with foldCol = key mod 5 (rows-only twin of m10_kfold_ols)."""
    o = T(spark, sf, "orders").select(F.pmod("o_orderkey", F.lit(5)).alias("fold"),
                                      F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
                                      .cast("double").alias("x"), F.col("o_totalprice").alias("y"))
    return round_doubles(M.cross_validate_linear(o, "y", ["x"], "fold", 5), 4)
