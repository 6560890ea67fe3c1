"""Operator 3: URL filter by character language models, in DataFrame operations only.

Rules (host and path prefix) judge what they fit. The other URLs are judged by two variable-order
Markov models of characters, of the URLs that rules allow and of those that they block. Contexts
of up to ``order`` characters are counted over all judged URLs and smoothed by Witten-Bell
interpolation from the longest context down to a uniform distribution. A URL's score is the
difference of the two log-likelihoods divided by its length. The threshold is calibrated on judged
URLs that the models have not seen (three sixteenths, by hash): the middle of the thresholds with
the best balanced accuracy on a grid.

Only distinct URLs are scored, and counts are aggregated before every shuffle; the n-gram tables
are joined, never broadcast by hint, so the models may grow with the data.

Defined results: a null URL or one without ``://`` has an empty host and path and fits no rule; a
URL without characters scores 0; if rules allow or block nothing, every score is 0 and the
threshold 0, which allows; repeated rows are judged each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START = "\x02"
# Probability of a character below all contexts: uniform over code points.
FLOOR = 1.0 / 0x110000
# Steps of the calibration grid per unit of score.
GRID = 100


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; empty without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(u, pattern, 1), UPPER, LOWER), F.regexp_extract(u, pattern, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest of ``rules`` (verdict, host and path) that fits, and its verdict; else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: len(x[1])):
        h, slash, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def grams(urls: DataFrame, order: int) -> DataFrame:
    """``urls`` (h1, h2, url, ...) with one row per character: ``gram`` ends with it."""
    padded = F.concat(F.lit(START * order), F.col("url"))
    at = F.explode(F.sequence(F.lit(1), F.length("url"))).alias("at")
    return urls.filter(F.length("url") > 0).select("*", at).select(
        *[c for c in urls.columns if c != "url"], F.substring(padded, F.col("at"), F.lit(order + 1)).alias("gram"))


def log_ratios(counts: DataFrame, order: int) -> DataFrame:
    """(gram, llr) of every n-gram in ``counts`` (gram, allowed, blocked)."""
    lower = None
    for k in range(order + 1):
        level = counts.groupBy(F.substring("gram", order + 1 - k, k + 1).alias("g")) \
            .agg(F.sum("allowed").alias("na"), F.sum("blocked").alias("nb")) \
            .select("g", "na", "nb", F.substring("g", 1, k).alias("c"))
        ctx = level.groupBy("c").agg(
            F.sum("na").alias("ca"), F.sum("nb").alias("cb"),
            F.count(F.when(F.col("na") > 0, 1)).alias("ta"), F.count(F.when(F.col("nb") > 0, 1)).alias("tb"))
        rows = level.join(ctx, "c")
        if lower is None:
            rows = rows.withColumns({"la": F.lit(FLOOR), "lb": F.lit(FLOOR)})
        else:
            rows = rows.withColumn("s", F.substring("g", 2, k)).join(
                lower.select(F.col("g").alias("s"), F.col("pa").alias("la"), F.col("pb").alias("lb")), "s")
        smooth = lambda n, c, t, low: F.when(F.col(c) > 0, (F.col(n) + F.col(t) * F.col(low)) / (F.col(c) + F.col(t))) \
            .otherwise(F.col(low))
        lower = rows.select("g", smooth("na", "ca", "ta", "la").alias("pa"), smooth("nb", "cb", "tb", "lb").alias("pb"))
    return lower.select(F.col("g").alias("gram"), (F.ln("pa") - F.ln("pb")).alias("llr"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row, ``t``: the calibrated threshold from judged rows (score, verdict)."""
    bins = scored.groupBy(F.floor(F.col("score") * GRID).alias("bin")).agg(
        F.count(F.when(F.col("verdict") == "allow", 1)).alias("a"), F.count(F.when(F.col("verdict") == "block", 1)).alias("b"))
    # the grid has at most some thousand steps: a character's log ratio is bounded by the floor
    cuts = bins.selectExpr(
        "bin", "try_divide(sum(a) over (order by bin desc), sum(a) over ()) as kept",
        "try_divide(coalesce(sum(b) over (order by bin rows between unbounded preceding and 1 preceding), 0), sum(b) over ()) as cut")
    best = cuts.selectExpr("bin", "round(kept + cut, 9) as value").selectExpr("bin", "value", "max(value) over () as top") \
        .filter("value = top")
    return best.agg(F.coalesce((F.min("bin") + F.max("bin")) / (2.0 * GRID), F.lit(0.0)).alias("t"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], order: int = 4, id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict, score): one row per page; score is null under a rule."""
    host, path = host_path(F.col(url_col))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(id_col), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
                        host.alias("host"), path.alias("path")) \
        .withColumns({"rule": rule, "verdict": verdict}) \
        .withColumns({"h1": F.xxhash64("url"), "h2": F.xxhash64(F.lit(1), F.col("url"))})
    urls = rows.select("h1", "h2", "url", "verdict").distinct() \
        .withColumn("held", F.substring(F.md5("url"), 1, 1).isin("0", "1", "2"))
    chars = grams(urls, order)
    learn = ~F.col("held")
    counts = chars.groupBy("gram").agg(
        F.count(F.when(learn & (F.col("verdict") == "allow"), 1)).alias("allowed"),
        F.count(F.when(learn & (F.col("verdict") == "block"), 1)).alias("blocked"))
    ratios = log_ratios(counts, order)
    both = counts.agg(((F.sum("allowed") > 0) & (F.sum("blocked") > 0)).alias("both"))
    asked = chars.filter(F.col("verdict").isNull() | F.col("held")).select("h1", "h2", "verdict", "gram")
    scores = asked.join(ratios, "gram").groupBy("h1", "h2", "verdict").agg(F.round(F.avg("llr"), 9).alias("score"))
    scores = scores.withColumn("score", F.when(both.scalar(), F.col("score")).otherwise(0.0))
    cut = threshold(scores.filter("verdict is not null"))
    other = scores.filter("verdict is null").select("h1", "h2", "score")
    return rows.join(other, ["h1", "h2"], "left").select(
        id_col, "host", "path", "rule",
        F.coalesce("verdict", F.when(F.coalesce("score", F.lit(0.0)) >= cut.scalar(), "allow").otherwise("block"))
        .alias("verdict"),
        F.when(F.col("rule").isNull(), F.coalesce("score", F.lit(0.0))).alias("score"))
