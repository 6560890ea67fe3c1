"""Question routing and dictionary matching over text columns.

Fixed small vocabularies become one projection of ``contains`` flags (no
join, no Python). User-sized dictionaries are matched by an equi-join on
word n-grams, so every document meets only the dictionary entries that
share one of its n-grams.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.prefix import join_groups

# Fixed values that must equal the reference's: vocabularies (in declared
# order, which is also the tie order), trigger lists and stop words.
TASK_VOCABULARIES = {
    "graph": ["shortest path", "degree", "density", "centrality", "clustering", "network", "graph", "node",
              "edge", "connectivity", "community", "betweenness", "eigenvector", "pagerank", "diameter", "clique"],
    "statistical": ["average", "correlation", "median", "mean", "std", "variance", "distribution", "histogram",
                    "statistics", "outlier", "percentile", "regression", "anova", "t-test", "chi-square",
                    "p-value", "hypothesis", "confidence", "significance", "normal", "skewness"],
    "timeseries": ["time", "cumulative", "date", "trend", "seasonal", "forecast", "moving average", "rolling",
                   "lag", "autocorrelation", "arima", "timestamp", "temporal", "chronological", "period",
                   "frequency", "decomposition", "stationarity", "differencing"],
    "scrape": ["scrape", "website", "html", "web", "crawl", "extract", "parse", "beautifulsoup", "requests",
               "url", "http", "tag", "element", "xpath", "css selector", "dom"],
}

ANALYSIS_CHAIN = [
    ("network", ["network", "graph", "node", "edge", "connection"]),
    ("timeseries", ["time", "trend", "seasonal", "forecast", "over time"]),
    ("ml", ["cluster", "classify", "predict", "model", "machine learning"]),
    ("database", ["sql", "query", "database", "select", "from", "where"]),
    ("statistical", ["statistical", "correlation", "distribution", "mean", "median"]),
]

BASE_KEYWORDS = ["table", "data", "list", "ranking", "information"]
DOMAIN_KEYWORDS = [
    (["movie", "film", "box office", "gross", "cinema"],
     ["highest-grossing", "box office", "worldwide", "gross", "revenue", "film", "movie"]),
    (["sales", "revenue", "business", "profit", "financial"],
     ["sales", "revenue", "profit", "business", "financial", "earnings"]),
    (["sport", "team", "player", "score", "match"],
     ["team", "player", "score", "match", "season", "league"]),
    (["stock", "share", "market", "price", "trading"],
     ["stock", "share", "price", "market", "trading", "index"]),
    (["country", "region", "city", "population", "geographic"],
     ["country", "region", "population", "area", "capital"]),
]
STOP_WORDS = ["this", "that", "with", "from", "have", "been", "will", "what", "where", "when"]

SQL_WORDS = ["select", "from", "where", "group by", "order by", "install", "load", "duckdb", "read_parquet",
             "read_csv", "read_json", "create table", "insert into", "update", "delete from"]
DB_WORDS = ["s3://", "read_parquet(", "read_csv(", "read_json(", ".parquet", ".csv", ".json", "httpfs",
            "install httpfs", "load httpfs", "s3_region=", "bucket", "aws", "gcs://", "gs://"]

# One pattern for database files behind URLs (s3, gs, http; parquet, csv, json), so that a text is
# searched once.
DB_URL_PATTERN = r"(?i)(s3|gs)://[^\s]+\.(parquet|csv|json)|https?://[^\s]+\.(parquet|csv|json)"

NUMBERED_LINE = r"(?m)^\s*\d+\.\s"


def _hits(text: Column, words: Sequence[str]) -> Column:
    return sum((F.when(text.contains(w), 1).otherwise(0) for w in words), F.lit(0))


def _any(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def task_scores(text: Column) -> list[Column]:
    low = F.lower(F.coalesce(text, F.lit("")))
    return [_hits(low, words).alias(f"score_{name}") for name, words in TASK_VOCABULARIES.items()]


def task_type(text: Column) -> Column:
    """The category with most distinct keyword hits (substring match);
    all zero -> 'custom'; ties go to the earlier category (W17)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    names = list(TASK_VOCABULARIES)
    scores = [_hits(low, TASK_VOCABULARIES[n]) for n in names]
    best = F.greatest(*scores)
    pick = F.when(best == 0, F.lit("custom"))
    for n, s in zip(names, scores):
        pick = pick.when(s == best, F.lit(n))
    empty = text.isNull() | (text == "")
    return F.when(empty, F.lit("custom")).otherwise(pick)


def analysis_type(text: Column, json_suggestion: Column | None = None) -> Column:
    """First matching category of the priority chain (substring match,
    so any 'from' reads as database); then the JSON suggestion; else general."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for name, words in ANALYSIS_CHAIN:
        cond = _any(low, words)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    fallback = F.coalesce(json_suggestion, F.lit("general")) if json_suggestion is not None else F.lit("general")
    return out.otherwise(fallback)


# Fixed values that must equal the reference's: what the keys of a JSON document say.
JSON_KEY_WORDS = [
    ("timeseries", ["date", "time", "year", "month", "timestamp", "created", "updated"]),
    ("network", ["source", "target", "from", "to", "node", "edge", "connection"]),
    ("statistical", ["value", "score", "rating", "price", "amount", "quantity"]),
]


def json_analysis(suggested: Column, keys: Column, complexity: Column) -> Column:
    """What a JSON file says where the question has no keyword: the analysis its structure
    suggests, unless that is none in particular; then the first kind whose words are in its keys;
    then ``json`` for nested structures; else NULL. The arguments are ``json_profile``'s columns."""
    text = F.lower(F.array_join(F.coalesce(keys, F.array().cast("array<string>")), " "))
    out = F.when(suggested != "general", suggested)
    for name, words in JSON_KEY_WORDS:
        out = out.when(_any(text, words), F.lit(name))
    return out.when(complexity.isin("complex", "nested"), F.lit("json"))


def question_keywords(text: Column) -> Column:
    """Base words, domain lists whose trigger appears, and the first
    five ASCII words longer than four letters (not stop words), original
    case; de-duplicated and sorted. A word is a maximal run of Unicode
    letters/digits/underscore made only of ASCII letters (the reference's
    \\b[a-zA-Z]+\\b on Unicode text)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    parts = [F.array(*[F.lit(w) for w in BASE_KEYWORDS])]
    for triggers, words in DOMAIN_KEYWORDS:
        parts.append(F.when(_any(low, triggers), F.array(*[F.lit(w) for w in words]))
                      .otherwise(F.array().cast("array<string>")))
    # maximal word runs made only of ASCII letters, at least five long: the
    # lookarounds reject runs that continue with any Unicode letter/digit
    cand = F.regexp_extract_all(F.coalesce(text, F.lit("")),
                                F.lit(r"(?<![\p{L}\p{N}_])[a-zA-Z]{5,}(?![\p{L}\p{N}_])"), 0)
    words = F.filter(cand, lambda w: ~F.lower(w).isin(*STOP_WORDS))
    parts.append(F.slice(words, 1, 5))
    return F.array_sort(F.array_distinct(F.flatten(F.array(*parts))))


def numbered_lines(text: Column) -> Column:
    """Count of numbered lines ('1. ...')."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(NUMBERED_LINE))


def key_items(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """X4: '- key: type' items (key optionally in backticks), one row each."""
    lines = docs.select(id_col, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line"))
    s = F.trim(F.col("line"))
    items = lines.filter(s.startswith("- ") & s.contains(":"))
    body = F.regexp_replace(s, "^- ", "")
    key = F.trim(F.regexp_replace(F.trim(F.substring_index(body, ":", 1)), "^`+|`+$", ""))
    typ = F.trim(F.regexp_extract(body, r"^[^:]*:(.*)$", 1))
    return items.select(id_col, "line_no", key.alias("key"), typ.alias("type"))


def is_sql_question(text: Column) -> Column:
    """Q7: (>= 2 SQL words and >= 1 DB word) or a database-file URL or the
    httpfs install/load pair or read_parquet with s3://."""
    low = F.lower(F.coalesce(text, F.lit("")))
    sql_n = _hits(low, SQL_WORDS)
    db_n = _hits(low, DB_WORDS)
    return (((sql_n >= 2) & (db_n >= 1)) | F.coalesce(text, F.lit("")).rlike(DB_URL_PATTERN)
            | (low.contains("install httpfs") & low.contains("load httpfs"))
            | (low.contains("read_parquet") & low.contains("s3://")))


# ------------------------------------------------------------------ dictionaries


def vocabulary_table(spark, vocab: dict[str, list[str]] | None = None) -> DataFrame:
    vocab = vocab or TASK_VOCABULARIES
    rows = [(cat, kw) for cat, kws in vocab.items() for kw in kws]
    return spark.createDataFrame(rows, "category string, keyword string")


def _norm_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def dictionary_hits(docs: DataFrame, id_col: str, text: str, dictionary: DataFrame) -> DataFrame:
    """Per (document, category) the number of distinct dictionary
    entries present as whole words / phrases.

    One plan at every size: words with the few that follow them (as many as the longest entry needs)
    meet the entries that start with the word in an equi-join, and a phrase is verified by its
    slice. The dictionary is pinned and counted: small it is broadcast, beyond that both sides are
    shuffled; the exploded documents are never the broadcast side. Entries that a document repeats
    are made distinct by the aggregate.
    """
    d = dictionary.select("category", "keyword", _norm_tokens(F.col("keyword")).alias("gram")) \
        .filter(F.size("gram") > 0).select("category", "keyword", "gram", F.col("gram")[0].alias("first"))
    longest = int(d.agg(F.max(F.size("gram"))).first()[0] or 1)
    tok = docs.select(id_col, _norm_tokens(F.col(text)).alias("tok"))
    words = tok.select(id_col, F.inline(F.transform(
        "tok", lambda w, i: F.struct(w.alias("first"), F.slice("tok", i + 1, longest).alias("tail")))))
    met = join_groups(words, d, "first").filter(F.slice("tail", F.lit(1), F.size("gram")) == F.col("gram"))
    return met.groupBy(id_col, "category").agg(F.count_distinct("keyword").alias("hits"))
