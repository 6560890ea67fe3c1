"""Series fits, selection, dates, samples, pages and result files on small inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import distributions as D
from quarry.operators import ml as M
from quarry.operators import pages as H
from quarry.operators import profile as P
from quarry.operators import relational as R
from quarry.operators import stats as S
from quarry.operators import timeseries as W
from quarry.plans import prefix
from quarry.sources import files as FS


def test_ar_fit_and_forecast(spark):
    rng = random.Random(1)
    y = [3.0, 1.0, 2.0]
    while len(y) < 60:
        y.append(1.5 + 0.5 * y[-1] - 0.2 * y[-2] + 0.1 * y[-3] + rng.gauss(0, 1))
    rows = [("a", i, v) for i, v in enumerate(y)] + [("flat", i, 2.0) for i in range(30)] + [("short", i, float(i * i)) for i in range(6)]
    df = spark.createDataFrame(rows, "key string, d int, y double").select("key", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")).alias("t"), "y")
    fit = {r.key: r for r in W.ar_fit(df, 3).collect()}
    x = np.column_stack([np.ones(57)] + [y[3 - k:60 - k] for k in (1, 2, 3)])
    want = np.linalg.lstsq(x, y[3:], rcond=None)[0]
    assert np.allclose(fit["a"].coef, want, atol=1e-9) and fit["a"].n == 57
    assert fit["flat"].coef is None and fit["short"].coef is None
    past = list(y)
    for _ in range(4):
        past.append(want[0] + sum(want[k] * past[-k] for k in (1, 2, 3)))
    got = {(r.key, r.step): r.forecast for r in W.forecast_ar(df, 3, 4).collect()}
    assert np.allclose([got["a", s] for s in (1, 2, 3, 4)], past[60:]) and got["flat", 1] is None


def test_normal_and_kolmogorov(spark):
    z = [-40.0, -8.0, -7.0, -1.5, -1e-9, 0.0, 0.3, 2.0, 7.2, 39.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in z], "z double").select(D.normal_cdf(F.col("z")).alias("p")).collect()]
    assert all(abs(p - 0.5 * math.erfc(-x / math.sqrt(2))) < 1e-14 for p, x in zip(got, z))
    q = [0.0, 0.3, 0.8, 1.1799, 1.18, 1.5, 3.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in q], "x double").select(D.kolmogorov_tail(F.col("x")).alias("p")).collect()]
    for p, x in zip(got, q):
        want = 1.0 if x == 0 else 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 200))
        assert abs(p - want) < 1e-9
    rng = random.Random(2)
    v = [rng.gauss(5, 2) for _ in range(300)] + [5.0] * 20
    r = S.ks_normal(spark.createDataFrame([(x,) for x in v] + [(None,)], "v double").repartition(5), "v").first()
    m, s, srt = np.mean(v), np.std(v, ddof=1), sorted(v)
    cdf = [0.5 * math.erfc(-(x - m) / s / math.sqrt(2)) for x in srt]
    want = max(max((i + 1) / len(v) - c, c - i / len(v)) for i, (x, c) in enumerate(zip(srt, cdf)))
    assert r.n == 320 and abs(r.statistic - want) < 0.07 and 0 < r.p <= 1
    flat = S.ks_normal(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v").first()
    assert flat.statistic is None


def test_label_selection(spark):
    rows = [(float(i % 10), float(i % 7), None if i % 5 == 0 else 1.0, i % 10 > 4) for i in range(700)]
    df = spark.createDataFrame(rows, "told double, noise double, flat double, label boolean")
    got = {r.feature: r for r in M.label_selection(df, ["noise", "told", "flat"], "label", 10, 1).collect()}
    assert abs(got["told"].mutual_information - math.log(2)) < 1e-9 and abs(got["told"].chi_square - 700) < 1e-6
    assert [f for f, r in got.items() if r.selected] == ["told"] and got["told"].dof == 9
    assert abs(got["flat"].mutual_information) < 1e-12 and got["noise"].mutual_information < 0.01


def test_samples_do_not_follow_the_layout(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") * 2).alias("v"))
    one = P.table_profile(df.repartition(7), 4).first()
    assert one.sample == P.table_profile(df.coalesce(1), 4).first().sample and len(one.sample) == 4 and one.row_count == 500
    p = P.preview_table(df.repartition(3), 3).first()
    assert p.sample_rows == 3 and p.preview.split("\n")[0] == "id | v" and len(p.preview.split("\n")) == 4
    js = spark.createDataFrame([("[1, {\"a\": 2}]",), ("{\"k\": [1]}",), ("[]",), ("{",), ("\"s\"",), (None,)], "js string")
    got = [(r.data_type, r.length, r["keys"], r.error is None) for r in P.preview_json(js, "js").collect()]
    assert got == [("list", 2, None, True), ("dict", None, ["k"], True), ("list", 0, None, True), (None, None, None, False),
                   ("str", None, None, True), (None, None, None, False)]


def test_dates_by_vote(spark):
    rows = [("2024-01-02", "31.01.2024", "x"), ("2024-01-03", " 01.02.2024 ", None), ("2024/01/04", "2024-02-03", ""), (None, None, "y")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    got = {r["column"]: (r.format, r.present, r.converted, r.failed) for r in P.date_formats(df, ["a", "b", "c"]).collect()}
    assert got == {"a": ("yyyy-MM-dd", 3, 2, 1), "b": ("dd.MM.yyyy", 3, 2, 1), "c": (None, 2, 0, 2)}
    out = P.convert_dates(df, ["a", "b", "c"]).select(*[F.col(c).cast("date").cast("string") for c in "abc"]).collect()
    assert [tuple(r) for r in out] == [("2024-01-02", "2024-01-31", None), ("2024-01-03", "2024-02-01", None), (None, None, None), (None, None, None)]


def test_sections_and_nested_tables(spark):
    inner = "<table><tr><td>x</td><td>y</td></tr></table>"
    data = "<table>" + "<tr><td>u</td><td>v</td></tr>" * 3 + "</table>"
    pages = [(1, f"<div class='content'>sales</div><table><tr><td>{inner}</td><td>{data}</td></tr></table>"),
             (2, "<table><tr><td>a</td></tr></table><table><tr><td>b</td></tr></table>"), (3, "<p>none</p>"), (4, None)]
    parsed = H.parse_pages(spark.createDataFrame(pages, "page_id long, html string")).cache()
    s = sorted((r.page_id, r.kind, r.idx, r.fallback, r.within) for r in H.sections(parsed).collect())
    assert s == [(1, "div", 0, False, 0), (2, "table", 0, True, 0), (2, "table", 1, True, 0)]
    n = sorted((r.table_idx, r.outer_idx, r.is_formatting, r.replaced_by, r.gone) for r in H.nested_tables(parsed).collect())
    assert n == [(1, 0, True, "xy", True), (2, 0, False, None, False)]
    m = {r.page_id: (r.original_tables, r.cleaned_tables, r.cleaned_size) for r in H.cleaning_metrics(parsed).collect()}
    empty = len(H.CLEANED_PAGE)
    assert m[1] == (3, 0, empty + len('<div class="content">sales</div>')) and m[3] == (0, 0, empty) and m[4][1] == 0
    assert m[2] == (2, 2, empty + 2 * len('<table class="cleaned-table"><tr><td>a</td></tr></table>'))


def test_damaged_results_are_counted(spark, tmp_path):
    for run, text in (("r1", '{"n": 1}'), ("r2", '{"n": '), ("r3", '[{"n": 3}, {"n": 4}]')):
        (tmp_path / run).mkdir()
        (tmp_path / run / "result.json").write_text(text)
    for schema in ("n long", None):
        got = {r.run_dir: (r.n_rows, r.n_damaged) for r in FS.result_health(FS.read_results(spark, f"{tmp_path}/*/result.json", schema)).collect()}
        assert got == {"r1": (1, 0), "r2": (0, 1), "r3": (2, 0)}
    assert sorted(r.text for r in FS.read_text_results(spark, f"{tmp_path}/*/result.json").collect())[0].startswith("[")


def test_encodings(spark, tmp_path):
    for name, enc, want in (("a", "utf-16", "UTF-16"), ("b", "latin-1", "ISO-8859-1"), ("c", "utf-8", "UTF-8")):
        (tmp_path / name).write_bytes('[{"x": "é"}]'.encode(enc))
        assert FS.detect_encoding(spark, str(tmp_path / name)) == want
        assert FS.read_json_documents(spark, str(tmp_path / name), "x string", None).first().x == "é"


@pytest.mark.parametrize("most", [10 ** 6, 3])
def test_quantiles_with_large_brackets(spark, monkeypatch, most):
    monkeypatch.setattr(prefix, "WINDOW_VALUES", most)
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1.0, 2.5, rng.random() * 9])) for _ in range(400)]
    got = prefix.exact_quantiles(spark.createDataFrame(rows, "k string, v double").repartition(4), "v", [0.1, 0.5], ["k"]).collect()
    for r in got:
        assert np.allclose([r.q0, r.q1], np.quantile([v for k, v in rows if k == r.k], [0.1, 0.5]))


def test_date_shapes_let_every_date_pass(spark):
    from quarry.operators import profile as P
    texts = ["2024-02-03", "02/03/2024", "03.02.2024", "2024/02/03", "2024-02-03 04:05:06", "02-03-2024", "20240203", "+12024-02-03",
             "2024-2-3", "", "n/a", "2024-02-03x", "2024-02-30", "Feb 3, 2024", "٢٠٢٤-٠٢-٠٣", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for f in (*P.DATE_FORMATS, "yyyyMMdd", "MMM d, yyyy", "yyyy-MM-dd['T'HH]", "d.M.yyyy"):
        both = df.select(F.try_to_timestamp("t", F.lit(f)).cast("string"), P._parsed(F.col("t"), f).cast("string")).collect()
        assert all(plain == guarded for plain, guarded in both), f
    import re
    assert not re.match(P.date_shape("MM/dd/yyyy"), "2024-02-03") and re.match(P.date_shape("MM/dd/yyyy"), "02/03/2024")


def test_spearman_matrix_sorts_no_rows(spark, monkeypatch):
    from pyspark.ml.stat import Correlation
    methods = []
    real = Correlation.corr
    monkeypatch.setattr(Correlation, "corr", staticmethod(lambda df, column, method="pearson": (methods.append(method), real(df, column, method))[1]))
    rng = random.Random(5)
    rows = [(rng.choice([None, 1.0, 2.0, -3.5, float("nan")]) if rng.random() < 0.3 else rng.gauss(0, 1), rng.randint(0, 4), rng.random() ** 3) for _ in range(300)]
    got = {(r.col_a, r.col_b): r.r for r in S.correlation_matrix_ml(spark.createDataFrame(rows, "a double, b int, c double"), ["a", "b", "c"], "spearman").collect()}
    kept = [r for r in rows if r[0] is not None and r[0] == r[0]]
    ranks = [[sum(y < x for y in col) + (sum(y == x for y in col) + 1) / 2 for x in col] for col in zip(*kept)]
    want = np.corrcoef(ranks)
    assert all(abs(got["abc"[i], "abc"[j]] - want[i, j]) < 1e-9 for i in range(3) for j in range(i + 1, 3))
    assert methods == ["pearson"]       # of the ranks


def test_key_table_diff_grows_in_parts(spark, monkeypatch):
    monkeypatch.setattr(R, "KEYS_IN_PART", 10)
    need = [(1, 1), (1, 1), (2, 5), (2, 5), (None, 1), (None, 1), (3, None)] + [(100 + i, 1) for i in range(200)]
    have = [(1, 1), (4, 4), (4, 4), (None, 1), (None, 1)] + [(100 + i, 1) for i in range(190)]
    frames = [spark.createDataFrame(rows, "k long, l int") for rows in (need, have)]
    out = R.key_table_diff(*frames, ["k", "l"], len(need) + len(have))
    assert out.rdd.getNumPartitions() == -(-(len(need) + len(have)) // 10)
    want = [(2, 5, "missing")] * 2 + [(None, 1, "missing")] * 2 + [(3, None, "missing")] + [(100 + i, 1, "missing") for i in range(190, 200)]
    want += [(4, 4, "extra"), (None, 1, "extra")]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
