"""Golden answers of the reference's shipped examples (rows retyped from
FIXTURES.md; the reference folder is never read)."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import graph as G
from quarry.operators import relational as R
from quarry.operators import stats as S
from quarry.plans.spec import answer

EDGES = [("Alice", "Bob"), ("Alice", "Carol"), ("Bob", "Carol"), ("Bob", "David"), ("Bob", "Eve"),
         ("Carol", "David"), ("David", "Eve")]
SALES = [(1, "2024-01-01", "East", 100), (2, "2024-01-02", "West", 200), (3, "2024-01-03", "East", 150),
         (4, "2024-01-04", "North", 50), (5, "2024-01-05", "South", 120), (6, "2024-01-06", "West", 220),
         (7, "2024-01-07", "East", 130), (8, "2024-01-08", "South", 170)]
WEATHER = [("2024-01-01", 5, 0), ("2024-01-02", 7, 1), ("2024-01-03", 6, 0), ("2024-01-04", 8, 2),
           ("2024-01-05", 6, 0), ("2024-01-06", 4, 5), ("2024-01-07", 3, 0), ("2024-01-08", 2, 0),
           ("2024-01-09", 4, 1), ("2024-01-10", 6, 0)]
ANIMALS = [("Cheetah", 120, "Grasslands", 1775), ("Pronghorn Antelope", 98, "Prairies", 1815),
           ("Springbok", 88, "Savannah", 1780), ("Quarter Horse", 88, "Grasslands", 1611),
           ("Wildebeest", 80, "Savannah", 1823), ("Lion", 80, "Grasslands", 1758),
           ("Blackbuck", 80, "Grasslands", 1828), ("Greyhound", 74, "Domesticated", 1800),
           ("Ostrich", 72, "Savannah", 1758), ("Cape Hunting Dog", 71, "Savannah", 1820)]
BUILDINGS = [("Burj Khalifa", "Dubai", "United Arab Emirates", 828, 2010),
             ("Shanghai Tower", "Shanghai", "China", 632, 2015),
             ("Abraj Al-Bait Clock Tower", "Mecca", "Saudi Arabia", 601, 2012),
             ("Ping An Finance Center", "Shenzhen", "China", 599, 2017),
             ("Lotte World Tower", "Seoul", "South Korea", 555, 2016),
             ("One World Trade Center", "New York City", "USA", 541, 2014),
             ("Guangzhou CTF Finance Centre", "Guangzhou", "China", 530, 2016),
             ("Tianjin CTF Finance Centre", "Tianjin", "China", 530, 2019),
             ("CITIC Tower", "Beijing", "China", 528, 2018),
             ("Taipei 101", "Taipei", "Taiwan", 508, 2004)]


@pytest.fixture(scope="module")
def edges(spark):
    return G.canonical(spark.createDataFrame(EDGES, "source string, target string"), "source", "target")


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(SALES, "order_id int, date string, region string, sales int") \
                .withColumn("date", F.to_date("date"))


@pytest.fixture(scope="module")
def weather(spark):
    return spark.createDataFrame(WEATHER, "date string, temperature_c int, precip_mm int") \
                .withColumn("date", F.to_date("date"))


def test_example1_network(spark, edges):
    spec = [
        {"key": "edge_count", "source": "e", "op": "graph.summary", "column": "n_edges", "type": "number"},
        {"key": "highest_degree_node", "source": "e", "op": "graph.highest_degree", "column": "node", "type": "string"},
        {"key": "average_degree", "source": "e", "op": "graph.summary", "column": "average_degree", "type": "number"},
        {"key": "density", "source": "e", "op": "graph.summary", "column": "density", "type": "number"},
        {"key": "shortest_path_alice_eve", "source": "e", "op": "graph.shortest_path_length",
         "params": {"source": "Alice", "target": "Eve"}, "column": "length", "type": "number"},
        {"key": "network_graph", "source": "e", "op": "graph.summary", "column": "n_edges", "type": "base64 PNG"},
    ]
    row = answer(spark, {"e": edges}, spec[:5]).first()
    assert row["edge_count"] == 7
    assert row["highest_degree_node"] == "Bob"
    assert row["average_degree"] == pytest.approx(2.8, abs=1e-3)
    assert row["density"] == pytest.approx(0.7, abs=1e-3)
    assert row["shortest_path_alice_eve"] == 2
    js = json.loads(row["answer_json"])
    assert list(js) == ["edge_count", "highest_degree_node", "average_degree", "density", "shortest_path_alice_eve"]


def test_example1_degrees(edges):
    got = {r["node"]: r["degree"] for r in G.degrees(edges).collect()}
    assert got == {"Bob": 4, "Carol": 3, "David": 3, "Alice": 2, "Eve": 2}
    dist = {r["degree"]: r["n_nodes"] for r in G.degree_distribution(edges).collect()}
    assert dist == {4: 1, 3: 2, 2: 2}


def test_example1_graph_scores(edges):
    tri = G.clustering_summary(edges).first()
    assert tri["triangles"] == 3  # Alice-Bob-Carol, Bob-Carol-David, Bob-David-Eve
    bc = {r["node"]: r["betweenness"] for r in G.betweenness(edges).collect()}
    # hand count: Bob lies on Alice-David (1/2), Alice-Eve (1), Carol-Eve (1/2)
    # of the 6 other pairs -> 2.0 / ((5-1)(5-2)/2) = 1/3
    assert bc["Bob"] == pytest.approx(2.0 / 6.0)
    assert bc["Alice"] == pytest.approx(0.0)
    comps = G.connected_components(edges).select("label").distinct().count()
    assert comps == 1
    pr = {r["node"]: r["pagerank"] for r in G.pagerank(edges, rounds=50).collect()}
    assert sum(pr.values()) == pytest.approx(1.0, abs=1e-9)
    assert max(pr, key=pr.get) == "Bob"


def test_example2_sales(spark, sales):
    spec = [
        {"key": "total_sales", "source": "s", "op": "relational.aggregate", "params": {"column": "sales"},
         "type": "number"},
        {"key": "top_region", "source": "s", "op": "relational.top_group",
         "params": {"group": "region", "measure": "sales"}, "column": "region", "type": "string"},
        {"key": "day_sales_correlation", "source": "s", "op": "stats.pearson", "prepare": {"op": "relational.day_of_month", "params": {"date_col": "date"}},
         "params": {"x": "day", "y": "sales"}, "type": "number"},
        {"key": "median_sales", "source": "s", "op": "relational.aggregate",
         "params": {"column": "sales", "how": "median"}, "type": "number"},
        {"key": "total_sales_tax", "source": "s", "op": "relational.aggregate",
         "params": {"column": "sales", "scale": 0.10}, "type": "number"},
    ]
    row = answer(spark, {"s": sales}, spec).first()
    assert row["total_sales"] == 1140
    assert row["top_region"] == "West"
    assert row["day_sales_correlation"] == pytest.approx(0.2228124549277306, abs=1e-3)
    assert row["median_sales"] == 140
    assert row["total_sales_tax"] == pytest.approx(114)


def test_example2_by_region_and_cumulative(sales):
    got = {r["region"]: r["total"] for r in R.grouped_total_with_top(sales, "region", "sales").collect()}
    assert got == {"West": 420, "East": 380, "South": 290, "North": 50}
    from quarry.operators import timeseries as W
    cum = W.cumulative(W.resample(sales, "date", "sales", "day")).orderBy("t").collect()
    assert [r["cum"] for r in cum][-1] == 1140


def test_example3_weather(weather):
    a = weather.agg(F.avg("temperature_c").alias("m"), F.min("temperature_c").alias("lo"),
                    F.avg("precip_mm").alias("p")).first()
    assert a["m"] == pytest.approx(5.1)
    assert a["lo"] == 2
    assert a["p"] == pytest.approx(0.9)
    wet = R.arg_best(weather, "precip_mm", ["date"], tie=["date"]).first()
    assert wet["date"] == dt.date(2024, 1, 6)
    r = S.pearson(weather, "temperature_c", "precip_mm").first()["r"]
    assert r == pytest.approx(0.0413519224, abs=1e-6)
    h = S.histogram(weather, "temperature_c", 20).collect()
    assert sum(x["n"] for x in h) == 10 and len(h) == 20


def test_example6_animals(spark):
    df = spark.createDataFrame(ANIMALS, "Animal string, TopSpeed_kmh long, Habitat string, FirstRecordedYear long")
    assert R.count_where(df, F.col("TopSpeed_kmh") > 90).first()["n"] == 2
    first = R.arg_best(df, "FirstRecordedYear", ["Animal"], tie=["Animal"], largest=False).first()
    assert first["Animal"] == "Quarter Horse"
    r = S.pearson(df, "TopSpeed_kmh", "FirstRecordedYear").first()["r"]
    assert r == pytest.approx(-0.12468106644, abs=1e-6)
    line = S.regression_line(df, "FirstRecordedYear", "TopSpeed_kmh").first()
    assert line["slope"] == pytest.approx(-0.53869938, abs=1e-6)
    assert line["intercept"] == pytest.approx(1822.64332, abs=1e-4)


def test_example7_buildings(spark):
    df = spark.createDataFrame(BUILDINGS, "Building string, City string, Country string, Height_m int, "
                                          "Year_Completed int")
    assert R.count_equal(df, "Country", "China").first()["n"] == 5
    best = R.arg_best(df, "Height_m", ["Building"], tie=["Building"], where=F.col("Year_Completed") < 2010).first()
    assert best["Building"] == "Taipei 101"
    assert S.pearson(df, "Height_m", "Year_Completed").first()["r"] == pytest.approx(-0.21658317166, abs=1e-6)
    line = S.regression_line(df, "Year_Completed", "Height_m").first()
    assert line["slope"] == pytest.approx(-0.01025653, abs=1e-6)
    assert line["intercept"] == pytest.approx(2020.10212, abs=1e-4)
