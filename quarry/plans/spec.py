"""Declarative question spec: operators combined into one JSON answer.

A spec is a list of items; each names a source frame, an operator
(``module.function`` under ``quarry.operators``), its parameters, the
result column that answers the item, the answer key and the declared
type. ``answer`` evaluates every item (each a DataFrame job), merges the
one-row results without a cross join, and shapes them with O1. There is
no text-to-plan step: the spec is the plan.

    spec = [
      {"key": "edge_count", "source": "edges", "op": "graph.summary", "column": "n_edges", "type": "number"},
      {"key": "highest_degree_node", "source": "edges", "op": "graph.highest_degree", "column": "node",
       "type": "string"},
    ]
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.columns import combine_rows
from quarry.operators.answers import answer_object


def resolve(op: str) -> Callable[..., DataFrame]:
    from quarry.registry import resolve as registry_resolve
    return registry_resolve(op)


def evaluate(item: Mapping[str, Any], sources: Mapping[str, DataFrame]) -> DataFrame:
    """One item -> a one-row frame with the answer column named by ``key``."""
    fn = resolve(item["op"])
    df = sources[item["source"]]
    prep = item.get("prepare")
    if prep:
        prep = {"op": prep} if isinstance(prep, str) else prep
        df = resolve(prep["op"])(df, **dict(prep.get("params", {})))
    out = fn(df, **dict(item.get("params", {})))
    col = item.get("column")
    if col is None:
        col = out.columns[0]
    if item.get("rows") == "all":
        # a list, chart table or group result: every row, in order, as one JSON array
        row = F.struct(*[F.col(c) for c in out.columns]) if item.get("column") is None else F.col(col)
        return out.agg(F.to_json(F.array_sort(F.collect_list(row))).alias(item["key"]))
    several = F.raise_error(F.lit(f"answer {item['key']!r} has more than one row; ask for rows='all'"))
    return out.agg(F.first(col).alias("v"), F.count(F.lit(1)).alias("n")).select(
        F.when(F.col("n") <= 1, F.col("v")).otherwise(several).alias(item["key"]))


def answer(spark: SparkSession, sources: Mapping[str, DataFrame], spec: Sequence[Mapping[str, Any]]) -> DataFrame:
    """All items of a spec as one row: the typed keys plus ``answer_json``."""
    parts = [evaluate(item, sources) for item in spec]
    row = combine_rows(*parts) if parts else spark.range(1).select()
    return answer_object(row, [(item["key"], item.get("type", "string")) for item in spec])
