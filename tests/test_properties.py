"""Property tests against numpy / brute force on small random inputs."""

import math

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quarry.functions.columns import safe_corr
from quarry.operators import graph as G
from quarry.operators import relational as R
from quarry.operators import stats as S
from quarry.plans.prefix import exact_quantiles

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
values = st.lists(st.integers(min_value=-20, max_value=20), min_size=1, max_size=40)


@SETTINGS
@given(values, st.lists(st.floats(min_value=0, max_value=1), min_size=1, max_size=4))
def test_exact_quantiles_match_numpy(spark, xs, probs):
    df = spark.createDataFrame([(float(x),) for x in xs], "v double")
    row = exact_quantiles(df, "v", probs).first()
    for i, p in enumerate(probs):
        assert math.isclose(row[f"q{i}"], float(np.quantile(np.array(xs, dtype=float), p)), abs_tol=1e-9)


@SETTINGS
@given(st.lists(st.tuples(st.integers(-5, 5), st.integers(-5, 5)), min_size=2, max_size=30))
def test_safe_corr(spark, pairs):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "x double, y double")
    r = df.agg(safe_corr("x", "y").alias("r")).first()["r"]
    x = np.array([a for a, _ in pairs], dtype=float)
    y = np.array([b for _, b in pairs], dtype=float)
    if x.std() == 0 or y.std() == 0:
        assert r is None
    else:
        assert math.isclose(r, float(np.corrcoef(x, y)[0, 1]), abs_tol=1e-9)


@SETTINGS
@given(st.lists(st.integers(0, 100), min_size=1, max_size=30),
       st.lists(st.tuples(st.integers(0, 100), st.integers(0, 30)), min_size=1, max_size=10))
def test_band_join_equals_brute_force(spark, left, bands):
    lf = spark.createDataFrame([(i, float(v)) for i, v in enumerate(left)], "id long, v double")
    rf = spark.createDataFrame([(j, float(lo), float(lo + w)) for j, (lo, w) in enumerate(bands)],
                               "band long, lo double, hi double")
    got = sorted((r["id"], r["band"]) for r in R.band_join(lf, rf, "v", "lo", "hi", 7.0).collect())
    exp = sorted((i, j) for i, v in enumerate(left) for j, (lo, w) in enumerate(bands) if lo <= v <= lo + w)
    assert got == exp


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), min_size=0, max_size=25))
def test_canonical_edges_and_degrees(spark, edges):
    df = spark.createDataFrame(edges, "s long, t long")
    e = G.canonical(df, "s", "t")
    rows = [tuple(r) for r in e.collect()]
    assert all(a < b for a, b in rows) and len(rows) == len(set(rows))
    exp = {tuple(sorted(p)) for p in edges if p[0] != p[1]}
    assert set(rows) == exp
    deg = {r["node"]: r["degree"] for r in G.degrees(e).collect()}
    assert sum(deg.values()) == 2 * len(exp)


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.floats(-1e3, 1e3)), min_size=0, max_size=30), st.integers(1, 6))
def test_histogram_counts(spark, xs, bins):
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    h = S.histogram(df, "v", bins).collect()
    n = sum(1 for x in xs if x is not None)
    assert sum(r["n"] for r in h) == n
    assert len(h) == (bins if n else 0)


def test_wide_correlation_switch(spark):
    import random
    rnd = random.Random(2)
    cols = [f"c{i}" for i in range(62)]
    rows = [tuple(float(rnd.randint(0, 9)) for _ in cols) for _ in range(40)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))
    wide = {(r["col_a"], r["col_b"]): r["r"] for r in S.correlation_matrix(df, cols).collect()}
    assert len(wide) == 62 * 61 // 2
    arr = np.array(rows)
    assert math.isclose(wide[("c0", "c1")], float(np.corrcoef(arr[:, 0], arr[:, 1])[0, 1]), abs_tol=1e-9)
