"""Edge inputs: empty, one row, constant, all-null, NaN/Inf,
ties, graph oddities, unsorted/missing dates, encodings, bad JSON/HTML/ZIP."""

import io
import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.functions.columns import safe_corr
from quarry.operators import answers as O
from quarry.operators import graph as G
from quarry.operators import jsonops as J
from quarry.operators import pages as H
from quarry.operators import profile as P
from quarry.operators import relational as R
from quarry.operators import stats as S
from quarry.operators import timeseries as W
from quarry.sources import files as SRC


def test_empty_and_single_row(spark):
    empty = spark.createDataFrame([], "x double, g string")
    d = S.describe(empty, ["x"]).first()
    assert d["count"] == 0 and d["mean"] is None
    assert S.histogram(empty, "x", 5).count() == 0
    one = spark.createDataFrame([(1.0, "a")], "x double, g string")
    d1 = S.describe(one, ["x"]).first()
    assert d1["count"] == 1 and d1["std"] is None and d1["mean"] == 1.0
    assert G.summary(G.canonical(spark.createDataFrame([], "src string, dst string"))).first()["n_nodes"] == 0


def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, y double")
    assert df.agg(safe_corr("x", "y").alias("r")).first()["r"] is None
    assert S.regression_line(df, "x", "y").first()["slope"] is None


def test_all_null_nan_and_infinity(spark):
    df = spark.createDataFrame([(None, float("nan")), (None, 1.0), (None, float("inf"))], "a string, b double")
    m = {r["column"]: r["missing"] for r in P.missing_values(df).collect()}
    assert m == {"a": 3, "b": 1, "__total__": 4}
    safe = O.json_safe(df.select("b")).collect()
    assert [r["b"] for r in safe] == [None, 1.0, None]


def test_ties_take_smallest_key(spark):
    df = spark.createDataFrame([("b", 88), ("a", 88), ("c", 80)], "k string, v int")
    assert R.arg_best(df, "v", ["k"], tie=["k"]).first()["k"] == "a"
    assert R.arg_best(df, "v", ["k"], tie=["k"], largest=False).first()["k"] == "c"
    top = R.top_group(spark.createDataFrame([("x", 1), ("y", 1)], "g string, m int"), "g", "m").first()
    assert top["g"] == "x"


def test_graph_self_loops_duplicates_unreachable(spark):
    raw = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), ("a", "b"), ("c", "d")], "s string, t string")
    e = G.canonical(raw, "s", "t")
    assert sorted(tuple(r) for r in e.collect()) == [("a", "b"), ("c", "d")]
    assert G.shortest_path_length(e, "a", "d").first()["length"] is None
    assert G.shortest_path_length(e, "a", "b").first()["length"] == 1
    labels = {r["node"]: r["label"] for r in G.connected_components(e).collect()}
    assert labels == {"a": "a", "b": "a", "c": "c", "d": "c"}


def test_unsorted_and_missing_dates(spark):
    rows = [("2024-01-03", 3.0), ("2024-01-01", 1.0), ("2024-01-05", 5.0)]
    df = spark.createDataFrame(rows, "d string, v double").withColumn("d", F.to_date("d"))
    s = W.resample(df, "d", "v", "day")
    filled = W.gap_fill(s).orderBy("t").collect()
    assert [r["y"] for r in filled] == [1.0, 1.0, 3.0, 3.0, 5.0]
    assert [r["filled"] for r in filled] == [False, True, False, True, False]
    cum = W.cumulative(s).orderBy("t").collect()
    assert [r["cum"] for r in cum] == [1.0, 4.0, 9.0]


def test_latin1_detection(spark, tmp_path):
    p = tmp_path / "latin.csv"
    p.write_bytes("name,city\nJosé,Málaga\nZoë,Köln\n".encode("latin-1"))
    assert SRC.detect_encoding(spark, str(p)) == "ISO-8859-1"
    df = SRC.read_csv(spark, str(p), encoding=None)
    assert sorted(r["name"] for r in df.collect()) == ["José", "Zoë"]
    q = tmp_path / "utf8.csv"
    q.write_text("name\nJosé\n", encoding="utf-8")
    assert SRC.detect_encoding(spark, str(q)) == "UTF-8"


def test_invalid_json_and_shapes(spark):
    docs = spark.createDataFrame([(1, '{"a": 1, "b": {"c": {"d": 2}}}'), (2, "[1, 2, 3]"), (3, '{"a": 1'),
                                  (4, '{"k": [1, 2, 3], "v": ["x"]}'), (5, "7")], "id long, js string")
    prof = {r["id"]: r for r in J.json_profile(docs).collect()}
    assert prof[3]["valid"] is False and prof[3]["data_type"] is None
    assert prof[1]["depth"] == 3 and prof[1]["complexity"] == "nested"
    assert prof[2]["data_type"] == "list" and prof[2]["item_type"] == "int" and prof[2]["records"] == 3
    assert prof[4]["records"] == 3
    long = J.explode_records(docs, "id").collect()
    by = {(r["id"], r["row_idx"], r["key"]): r["value"] for r in long}
    assert by[(4, 2, "k")] == "3" and (4, 1, "v") not in by      # shorter list: no cell (NULL padding)
    assert by[(2, 1, "value")] == "2" and by[(5, 0, "value")] == "7"
    assert not any(k[0] == 3 for k in by)


def test_unclosed_html_and_nested_tables():
    html = ("<html><head><title> T </title><script>x='<table>'</script></head><body>"
            "<table class='wikitable'><tr><th>Rank<th>Name<tr><td>1<td>A<sup>[1]</sup>"
            "<tr><td>2<td><a href='#'>B</a><table><tr><td>n</td></tr></table></table>"
            "<!-- c --><p>unclosed <b>bold</body></html>")
    page = H.parse_page(7, html)
    assert page["error"] is None and page["title"] == " T "
    outer = page["tables"][0]
    assert outer["headers"] == ["Rank", "Name"]
    assert outer["rows"] == [["Rank", "Name"], ["1", "A"], ["2", "Bn"]]
    assert outer["nested_tables"] == 1 and outer["classes"] == ["wikitable"]
    assert page["original_tables"] == 2
    bad = H.parse_page(8, None)
    assert bad["error"] is None and bad["tables"] == []


def test_zip_members_and_bad_zip(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as zf:
        zf.writestr("dir/", "")
        zf.writestr("dir/data.csv", "a,b\n1,2\n")
        zf.writestr(".hidden", "x")
        zf.writestr("notes.txt", "hello")
    (tmp_path / "good.zip").write_bytes(buf.getvalue())
    (tmp_path / "bad.zip").write_bytes(b"not a zip at all")
    got = sorted((r["member"], r["size"]) for r in SRC.zip_members(spark, str(tmp_path)).collect())
    assert got == [("extracted_data.csv", 8), ("extracted_notes.txt", 5)]
    rows = SRC.zip_members(spark, str(tmp_path), errors=True).filter("error is not null").collect()
    assert [(r["archive"].rsplit("/", 1)[-1], r["content"]) for r in rows] == [("bad.zip", None)]
    assert "BadZipFile" in rows[0]["error"]


def test_answer_shapes(spark):
    row = spark.createDataFrame([(2.8, "Bob", "extra")], "average_degree double, node string, junk string")
    out = O.answer_object(row, [("average_degree", "number"), ("node", "string"), ("missing", "number")]).first()
    js = json.loads(out["answer_json"])
    assert js == {"average_degree": 2.8, "node": "Bob", "missing": "Missing data"}
    arr = spark.range(1).select(O.answer_array(F.array(F.lit(1), F.lit(2)), 4).alias("a")).first()["a"]
    assert arr == ["1", "2", "No data", "No data"]
    conv = spark.createDataFrame([("3.7",), ("n/a",), (None,)], "v string").select(O.typed(F.col("v"), "int").alias("i"))
    assert [r["i"] for r in conv.collect()] == [3, 0, 0]


def test_manifest_derived_columns(spark, tmp_path):
    for name, size in [("data.csv", 10), ("result_output.json", 3), ("question.txt", 1), ("big.parquet", 2048)]:
        (tmp_path / name).write_bytes(b"x" * size)
    m = {r["name"]: r for r in SRC.manifest(spark, str(tmp_path)).collect()}
    assert m["data.csv"]["source_rank"] == 5 and m["data.csv"]["size_text"] == "10.0 B"
    assert m["result_output.json"]["source_rank"] is None
    assert m["question.txt"]["is_question_file"] is True
    assert m["big.parquet"]["size_text"] == "2.0 KB" and m["big.parquet"]["accepted"] is False
    assert math.isclose(m["big.parquet"]["size"], 2048)


def test_sanitize_name(spark):
    df = spark.createDataFrame([('  a<b>:c".txt. ',), ("",), ("x" * 300 + ".csv",)], "n string")
    out = [r[0] for r in df.select(SRC.sanitize_name(F.col("n"))).collect()]
    assert out[0] == 'a_b__c_.txt' and out[1] == "unnamed_file"
    assert out[2] == "x" * 250 + ".csv"


@pytest.mark.parametrize("z", [0.0, 1.0])
def test_histogram_constant(spark, z):
    df = spark.createDataFrame([(z,), (z,)], "x double")
    h = S.histogram(df, "x", 4).collect()
    assert sum(r["n"] for r in h) == 2


def test_wiki_rules_and_sections():
    body = ('<div class="navbox">nav</div><div class="mw-references-wrap references">refs</div>'
            '<span class="mw-editsection">[edit]</span><div id="mw-navigation">menu</div>'
            '<div class="content main">Sales data overview<table><tr><td>1</td><td>x<sup class="reference">[2]</sup>'
            '</td></tr><tr><td>2</td><td>y</td></tr><tr><td>3</td><td>z</td></tr></table></div>'
            '<div class="other">data</div>')
    wiki_tree, plain_tree = H.parse(body), H.parse(body)
    H.clean_tree(wiki_tree, wiki=True)
    H.clean_tree(plain_tree, wiki=False)
    w, p = wiki_tree.html(), plain_tree.html()
    for gone in ("navbox", "references", "mw-editsection", "mw-navigation", "[2]"):
        assert gone not in w and gone in p
    wiki = H.parse_page(1, '<html><head><link href="https://en.wikipedia.org/x"></head><body>' + body + "</body></html>")
    plain = H.parse_page(2, "<html><body>" + body + "</body></html>")
    assert wiki["wiki"] is True and plain["wiki"] is False
    assert wiki["cleaned_size"] < plain["cleaned_size"]
    # only the div whose class names a section kind and whose text holds a keyword
    assert wiki["n_section_divs"] == 1 and plain["n_section_divs"] == 1
    assert wiki["tables"][0]["rows"] == [["1", "x"], ["2", "y"], ["3", "z"]]
