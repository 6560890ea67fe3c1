"""Registry of named queries over the input tables.

Each query is ``fn(spark, sf_dir) -> DataFrame``; an optional DuckDB SQL
twin (same column names, run over the same parquet tables) is the
correctness oracle. Query modules register themselves on import.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.sources.tables import load

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
BENCH: list[str] = []


def _sig_sql(x: str, digits: int = 10) -> str:
    """SQL twin of ``round_sig``: the same steps, written for DuckDB."""
    v = f"CAST(({x}) AS DOUBLE)"
    e = f"floor(log10(abs({v})))"
    k = f"({digits - 1} - {e})"
    return (f"(CASE WHEN {v} IS NULL OR isnan({v}) OR isinf({v}) OR {v} = 0 THEN {v} "
            f"WHEN {k} >= 0 THEN round({v} * pow(10.0, {k})) / pow(10.0, {k}) "
            f"ELSE round({v} / pow(10.0, -{k})) * pow(10.0, -{k}) END)")


def _split_args(body: str) -> list[str]:
    depth, cur, out, quote = 0, [], [], False
    for ch in body:
        if ch == "'":
            quote = not quote
        if not quote:
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 0:
                out.append("".join(cur))
                cur = []
                continue
        cur.append(ch)
    out.append("".join(cur))
    return out


def significant_sql(sql: str) -> str:
    """Rewrite every ``round(x, 6)`` of a twin into 10-significant-digit
    rounding, matching ``round_doubles`` on the Spark side."""
    import re
    out, i = [], 0
    pat = re.compile(r"(?<![A-Za-z0-9_])round\(", re.IGNORECASE)
    while True:
        m = pat.search(sql, i)
        if not m:
            out.append(sql[i:])
            return "".join(out)
        start = m.end()
        depth, j, quote = 1, start, False
        while depth:
            ch = sql[j]
            if ch == "'":
                quote = not quote
            elif not quote:
                depth += ch == "("
                depth -= ch == ")"
            j += 1
        body = sql[start:j - 1]
        args = _split_args(body)
        inner = significant_sql(args[0])
        out.append(sql[i:m.start()])
        if len(args) == 2 and args[1].strip() == "6":
            out.append(_sig_sql(inner))
        else:
            out.append("round(" + ",".join([inner] + [significant_sql(a) for a in args[1:]]) + ")")
        i = j


def query(name: str, sql: str | None = None, bench: bool = False):
    """Register ``fn`` under ``name`` with an optional SQL twin."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = significant_sql(sql.strip())
        if bench:
            BENCH.append(name)
        return fn
    return deco


def T(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load(spark, sf_dir, name)


def load_all() -> None:
    """Import every query module so that the registry is complete."""
    from quarry.plans import (  # noqa: F401
        queries_charts,
        queries_core,
        queries_graph,
        queries_ml,
        queries_profile,
        queries_sources,
        queries_stats,
        queries_text,
        queries_time,
    )
