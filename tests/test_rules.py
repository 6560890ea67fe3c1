"""Rules that must hold at every size: no caps, one definition, no arbitrary rows."""

import math

import pytest
from pyspark.sql import functions as F

from quarry import session
from quarry.operators import graph as G
from quarry.operators import jsonops as J
from quarry.operators import ml as M
from quarry.operators import pages as H
from quarry.operators import profile as P
from quarry.operators import questions as X
from quarry.operators import stats as S
from quarry.plans import spec


@pytest.mark.parametrize("text,depth", [
    ('{"a":[1,2,3,4,5,{"b":{"c":1}}]}', 3), ('[{"a":1},{"a":{"b":{"c":2}}}]', 3), ('{"a":{}}', 1), ("{}", 0),
    ('{"{":"}}{{\\\\\\"{"}', 1), ("[1,[2]]", 0), ("3", 0), ('{"a":', None), (None, None), ('{"a":[[{"b":"é"}]]}', 2)])
def test_json_depth_counts_every_element(spark, text, depth):
    df = spark.createDataFrame([(text,)], "js string")
    assert df.select(J.nesting_depth(F.col("js")).alias("d")).first()["d"] == depth


def test_correlation_is_the_same_at_every_width(spark):
    def value(i, c):
        if c % 7 == 3:
            return 5.0                                      # constant
        return None if (i * 31 + c * 17) % 11 == 0 else math.sin(i * (c + 1)) + i * 0.01 + 1e6

    n = 61
    rows = [tuple(value(i, c) for c in range(n)) for i in range(200)]
    cols = [f"c{c}" for c in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(3)
    wide = {(r.col_a, r.col_b): r.r for r in S.correlation_matrix(df, cols).collect()}
    assert len(wide) == n * (n - 1) // 2
    narrow = {(r.col_a, r.col_b): r.r for r in S.correlation_matrix(df, cols[:20]).collect()}
    for pair, r in narrow.items():
        assert r == wide[pair] or abs(r - wide[pair]) < 1e-9
        both = [(x, y) for x, y in ((row[cols.index(pair[0])], row[cols.index(pair[1])]) for row in rows)
                if x is not None and y is not None]
        mx, my = (sum(v) / len(both) for v in zip(*both))
        sxx, syy = (sum((v - m) ** 2 for v in col) for col, m in zip(zip(*both), (mx, my)))
        if sxx < 1e-9 or syy < 1e-9:
            assert r is None
        else:
            assert abs(r - sum((x - mx) * (y - my) for x, y in both) / math.sqrt(sxx * syy)) < 1e-7


def test_spec_rejects_several_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    item = {"key": "k", "source": "t", "op": "relational.aggregate", "params": {"column": "n"}}
    assert spec.evaluate(item, {"t": df}).first()["k"] is not None
    many = {"key": "k", "source": "t", "op": "relational.group_aggregate", "params": {}}
    fn = spec.resolve
    try:
        spec.resolve = lambda op: (lambda d, **kw: d)
        with pytest.raises(Exception, match="more than one row"):
            spec.evaluate(many, {"t": df}).collect()
        assert spec.evaluate(many | {"rows": "all"}, {"t": df}).first()["k"] == '[{"n":1,"s":"a"},{"n":2,"s":"b"}]'
        assert spec.evaluate(many | {"rows": "all", "column": "s"}, {"t": df}).first()["k"] == '["a","b"]'
    finally:
        spec.resolve = fn


def test_bfs_stops_at_the_target(spark):
    edges = spark.range(30).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    seen = G.bfs(edges, spark.range(1).select(F.lit(0).cast("long").alias("source")), 4)
    assert seen.agg(F.max("dist")).first()[0] == 4
    assert G.shortest_path_length(edges, 0, 7).first()["length"] == 7


def test_key_items_keep_long_lines(spark):
    long_type = "x" * 1_200_000
    df = spark.createDataFrame([(1, f"- key: {long_type}")], "id int, text string")
    assert X.key_items(df, "id", "text").select(F.length("type")).first()[0] == len(long_type)


def test_impute(spark):
    df = spark.createDataFrame([(1.0,), (None,), (9.0,), (2.0,)], "x double")
    total = lambda **kw: P.impute(df, ["x"], **kw).agg(F.sum("x")).first()[0]
    assert total(how="constant", value=7.0) == 19.0 and total(how="median") == 14.0 and total(how="mean") == 16.0
    for bad in ({"how": "avg"}, {"how": "constant"}):
        with pytest.raises(ValueError):
            P.impute(df, ["x"], **bad)


def test_spans_fill_the_grid(spark):
    html = ("<table><tr><td rowspan=2>1</td><td>A</td><td>5</td></tr><tr><td>B</td><td>6</td></tr>"
            "<tr><td colspan=2>w</td><td rowspan='x'>7</td></tr><tr><td>p</td></tr></table>")
    rows = H.parse_page(1, html)["tables"][0]["rows"]
    assert rows == [["1", "A", "5"], ["1", "B", "6"], ["w", "w", "7"], ["p"]]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert H.parse_pages(pages).count() == 2 and spark.conf.get(key) == before
    failed = H.parse_pages(pages).withColumn("error", F.when(F.col("page_id") == 2, "ValueError: x"))
    assert [tuple(r) for r in H.failed_pages(failed).collect()] == [("ValueError: x", 1)]


def test_folds_and_held_out_accuracy(spark):
    df = spark.range(400).select("id", (F.col("id") % 97).cast("double").alias("x"),
                                 F.when(F.col("id") % 97 > 40, 1.0).otherwise(0.0).alias("label"))
    assert M.ols_kfold(df.withColumn("y", F.col("x") * 2), "y", "x", "id", 4).count() == 4
    curve = M.learning_curve(df, "label", ["x"], "id", (0.5, 1.0)).collect()
    assert all(r["accuracy"] > 0.9 for r in curve)
    scored = M.logistic(df.filter("id % 5 <> 0"), "label", ["x"], df)
    assert scored.count() == 400 and M.logistic(df, "label", ["x"], df, forest=True).count() == 400


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master, applicationId = "yarn", "x"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Session())


def test_quantiles_of_large_hot_and_null_groups(spark):
    import numpy as np

    from quarry.plans.prefix import exact_quantiles
    rng = np.random.default_rng(0)
    hot = [("a", float(x)) for x in rng.integers(0, 40, 30_000)] + [(None, float(x)) for x in rng.normal(size=25_000)]
    rows = hot + [("b", 1.0), ("b", 2.0), ("c", None), ("d", float("nan")), ("d", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 0.9999, 1.0]
    got = {r["k"]: r for r in exact_quantiles(df, "v", probs, ["k"]).collect()}
    assert set(got) == {"a", None, "b", "d"}
    for k, r in got.items():
        x = [v for kk, v in rows if kk == k and v is not None and v == v]
        assert r["n"] == len(x)
        assert all(abs(r[f"q{i}"] - np.quantile(x, p)) < 1e-12 for i, p in enumerate(probs))
    everything = exact_quantiles(df, "v", [0.5]).first()
    assert abs(everything["q0"] - np.quantile([v for _, v in rows if v is not None and v == v], 0.5)) < 1e-12
    assert exact_quantiles(df.limit(0), "v", [0.5]).first()["q0"] is None


def test_pages_of_one_split_are_parsed_by_many_tasks(spark):
    from quarry.operators import pages as H
    html = "<html><head><title>T</title></head><body><table><tr><th>a</th></tr><tr><td>b</td></tr></table></body></html>"
    rows = [(i, html if i % 3 else None) for i in range(40)] + [(7, html), (8, "<p>x")]
    parsed = H.parse_pages(spark.createDataFrame(rows, "page_id long, html string").coalesce(1))
    assert parsed.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    got = sorted((r.page_id, r.title or "", r.cleaned_tables, r.original_size, len(r.tables)) for r in parsed.collect())
    assert got == sorted((i, "T" if h == html else "", int(h == html), len(h or ""), int(h == html)) for i, h in rows)
