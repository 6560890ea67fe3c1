"""Question routing on a fixed question list (the reference's rules)."""

from pyspark.sql import functions as F

from quarry.operators import questions as X

QUESTIONS = [
    (1, "What is the shortest path and the degree centrality of this network graph?"),
    (2, "Plot the histogram of sales"),
    (3, "Compute the rolling average"),
    (4, ""),
    (5, "Scrape the website and extract the html table"),
    (6, "SELECT * FROM read_parquet('s3://bucket/x.parquet')"),
    (7, "select the best item from the list"),
    (8, "What are the highest grossing films of 2019?"),
    (9, "Answer:\n1. How many?\n 2. Which one?\n- `edge_count`: number\n- density: number\n3.x"),
    (10, "Show the trend over time"),
    (11, "Sometimes things happen"),
]


def _df(spark):
    return spark.createDataFrame(QUESTIONS, "id long, text string")


def test_task_type(spark):
    got = {r["id"]: r["t"] for r in _df(spark).select("id", X.task_type(F.col("text")).alias("t")).collect()}
    assert got[1] == "graph"
    assert got[2] == "statistical"
    assert got[3] == "statistical"          # 1-1 tie with timeseries: declared order wins
    assert got[4] == "custom"
    assert got[5] == "scrape"
    assert got[11] == "timeseries"         # substring rule: 'time' in 'sometimes'


def test_analysis_type(spark):
    got = {r["id"]: r["a"] for r in _df(spark).select("id", X.analysis_type(F.col("text")).alias("a")).collect()}
    assert got[1] == "network" and got[7] == "database" and got[10] == "timeseries" and got[4] == "general"
    assert got[2] == "general"


def test_keywords(spark):
    row = _df(spark).filter("id = 8").select(X.question_keywords(F.col("text")).alias("k")).first()
    expected = sorted({"table", "data", "list", "ranking", "information", "highest-grossing", "box office",
                       "worldwide", "gross", "revenue", "film", "movie", "highest", "grossing", "films"})
    assert row["k"] == expected


def test_sql_detection_and_list_items(spark):
    got = {r["id"]: r["s"] for r in _df(spark).select("id", X.is_sql_question(F.col("text")).alias("s")).collect()}
    assert got[6] is True and got[7] is False and got[1] is False
    q9 = _df(spark).filter("id = 9")
    assert q9.select(X.numbered_lines(F.col("text")).alias("n")).first()["n"] == 2
    items = [(r["key"], r["type"]) for r in X.key_items(q9, "id", "text").orderBy("line_no").collect()]
    assert items == [("edge_count", "number"), ("density", "number")]


def test_dictionary_hits(spark):
    docs = spark.createDataFrame([(1, "The moving average of the time series, a moving average again."),
                                  (2, "CSS selector and graph nodes; shortest path"), (3, "nothing here")],
                                 "doc_id long, text string")
    vocab = X.vocabulary_table(spark)
    fast = sorted(tuple(r) for r in X.dictionary_hits(docs, "doc_id", "text", vocab).collect())
    assert (1, "timeseries", 2) in fast        # 'moving average' and 'time' as whole words
    assert (1, "statistical", 1) in fast       # 'average'
    assert (2, "graph", 2) in fast             # 'graph' and 'shortest path' ('nodes' is not 'node')
    assert (2, "scrape", 1) in fast            # 'css selector'
    assert not any(r[0] == 3 for r in fast)
