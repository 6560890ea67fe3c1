"""Projections, filters, arg-max/min, top-k, set operations, joins and
aggregations (SURVEY R*, J*, A*).

Every function takes DataFrames and returns a DataFrame; nothing is
collected. Arg-max style answers use ``orderBy(...).limit(1)``, which
Spark plans as TakeOrderedAndProject: each task keeps its own top rows
and only those are merged, so there is no full sort and no single-task
shuffle of the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of both tables in one part of ``key_table_diff``, about.
KEYS_IN_PART = 500_000


# ---------------------------------------------------------------- R: rows


def count_where(df: DataFrame, predicate: Column, name: str = "n") -> DataFrame:
    """Number of rows satisfying a predicate (one row)."""
    return df.agg(F.count_if(predicate).alias(name))


def count_equal(df: DataFrame, column: str, value, name: str = "n") -> DataFrame:
    """R2: rows whose ``column`` equals ``value``."""
    return count_where(df, F.col(column) == F.lit(value), name)


def _order(value: str, ascending: bool, tie: Sequence[str]) -> list[Column]:
    first = F.col(value).asc() if ascending else F.col(value).desc()
    return [first] + [F.col(t).asc_nulls_last() for t in tie]


def arg_best(df: DataFrame, value: str, keep: Sequence[str], tie: Sequence[str] = (),
             largest: bool = True, where: Column | None = None) -> DataFrame:
    """The row with the largest (or smallest) ``value``.

    NULL values never win. Ties go to the smallest ``tie`` key, which
    replaces pandas' "first row" rule with an explicit, order-free one.
    """
    src = df.filter(F.col(value).isNotNull())
    if where is not None:
        src = src.filter(where)
    return (src.orderBy(*_order(value, not largest, tie))
               .limit(1)
               .select(*[F.col(k) for k in dict.fromkeys([*keep, value])]))


def top_k_frequency(df: DataFrame, column: str, k: int = 10, count_name: str = "n") -> DataFrame:
    """The k most frequent values (ties by value ascending).

    The count is a partial (map-side) aggregate, so a value holding a
    third of the rows costs one counter per task, not a hot shuffle key.
    """
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias(count_name))
    return counts.orderBy(F.col(count_name).desc(), F.col(column).asc_nulls_last()).limit(k)


def rename_positional(df: DataFrame, names: Sequence[str], extra_prefix: str = "Column_") -> DataFrame:
    """Rename columns by position; surplus columns become Column_6, Column_7, ..."""
    n = len(df.columns)
    new = list(names[:n]) + [f"{extra_prefix}{i + 1}" for i in range(len(names), n)]
    return df.toDF(*new)


def regex_filter(df: DataFrame, column: str, pattern: str = r"^\d+$") -> DataFrame:
    """Keep rows whose column (as text) matches ``pattern``."""
    return df.filter(F.col(column).cast("string").rlike(pattern))


def distinct_sorted(arr: Column) -> Column:
    """De-duplicated, sorted keyword array."""
    return F.array_sort(F.array_distinct(arr))


def sort_by_count(df: DataFrame, key: str, count_name: str = "n") -> DataFrame:
    """Grouped count ordered by count desc, key asc."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias(count_name))
              .orderBy(F.col(count_name).desc(), F.col(key).asc_nulls_last()))


def union_first_strategy(candidates: DataFrame, key: Sequence[str], rank_col: str = "strategy") -> DataFrame:
    """Union of candidate lists where a later strategy adds only what earlier ones lack: per
    key the whole row with the lowest strategy rank (several such rows: the smallest by the other
    columns). A minimum over rows, so a key with many candidates is reduced before the shuffle."""
    rest = [c for c in candidates.columns if c not in (*key, rank_col)]
    best = candidates.groupBy(*key).agg(F.min(F.struct(rank_col, *rest)).alias("_best"))
    return best.select(*key, "_best.*").select(*candidates.columns)


def key_set_diff(present: Column, required: Column) -> tuple[Column, Column]:
    """(missing, extra) key arrays against a required set."""
    return (F.array_sort(F.array_except(required, present)),
            F.array_sort(F.array_except(present, required)))


def key_table_diff(required: DataFrame, present: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """R13 (table form): the rows of ``required`` whose keys ``present`` lacks (``kind`` missing), and
    once each the keys of ``present`` that ``required`` lacks (extra). A key with a NULL is found nowhere.

    Both tables, of about ``rows`` rows in all, are dealt once into parts whose number grows with the
    rows and which are not merged again, so that a task's sorts stay small however large the tables are;
    one outer join of the parts finds both kinds.
    """
    parts = max(int(required.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // KEYS_IN_PART))
    req = required.select(*keys).repartition(parts, *keys)
    have = present.select(*keys).repartition(parts, *keys).distinct()
    required_here, present_here = "_required", "_present"
    met = req.withColumn(required_here, F.lit(True)).join(have.withColumn(present_here, F.lit(True)).hint("merge"), list(keys), "full")
    missing, extra = F.col(present_here).isNull(), F.col(required_here).isNull()
    return met.filter(missing | extra).select(*keys, F.when(missing, "missing").otherwise("extra").alias("kind"))


def head_ordered(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """First n rows in a declared order (distributed top-n)."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(n)


# ---------------------------------------------------------------- J: joins


def equi_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Equi-join; Catalyst/AQE choose broadcast vs sort-merge from
    the measured sizes (autoBroadcastJoinThreshold is the size check)."""
    return left.join(right, on=on, how=how)


def band_join(left: DataFrame, right: DataFrame, left_value: str, right_lo: str, right_hi: str,
              bucket_width: float) -> DataFrame:
    """Rows of ``left`` whose value lies in [right_lo, right_hi].

    The band is turned into an equi-join: every right row is exploded over
    the value buckets its band covers, the left row joins on its own
    bucket, and the exact band predicate filters. Work is
    O(|left| + |right| * band/bucket), never |left| x |right|.
    """
    w = float(bucket_width)
    lb = F.floor(F.col(left_value) / F.lit(w)).cast("bigint")
    lo_b = F.floor(F.col(right_lo) / F.lit(w)).cast("bigint")
    hi_b = F.floor(F.col(right_hi) / F.lit(w)).cast("bigint")
    r = right.withColumn("_bucket", F.explode(F.sequence(lo_b, hi_b)))
    lft = left.withColumn("_bucket", lb)
    joined = lft.join(r, on="_bucket", how="inner")
    return joined.filter((F.col(left_value) >= F.col(right_lo)) & (F.col(left_value) <= F.col(right_hi))).drop("_bucket")


def asof_join(points: DataFrame, grid: DataFrame, key: str, ts: str, grid_ts: str,
              value_cols: Sequence[str]) -> DataFrame:
    """For each grid row, the last point at or before it (same key).

    Grid and points are one frame (points sort before a grid row at the
    same instant); the grid rows take the last non-NULL point values by a
    keyed carry-forward over range partitions, so a series that holds a
    large share of the rows is still split across tasks.
    """
    from quarry.plans.prefix import carry_forward
    p = points.select(F.col(key), F.col(ts).alias("_t"), F.lit(0).alias("_g"),
                      *[F.col(v) for v in value_cols])
    g = grid.select(F.col(key), F.col(grid_ts).alias("_t"), F.lit(1).alias("_g"),
                    *[F.lit(None).cast(points.schema[v].dataType).alias(v) for v in value_cols])
    filled = carry_forward(p.unionByName(g), [key], ["_t", "_g"], list(value_cols))
    return filled.filter(F.col("_g") == 1).drop("_g").withColumnRenamed("_t", grid_ts)


# ---------------------------------------------------------------- A: aggregates


def grouped_total_with_top(df: DataFrame, group: str, measure: str,
                           total_name: str = "total") -> DataFrame:
    """Total per group (partial aggregation before the shuffle)."""
    return df.groupBy(group).agg(F.sum(measure).alias(total_name))


def grouped_count_avg(df: DataFrame, group: str, measure: str) -> DataFrame:
    """Count and mean per group, ordered by count."""
    return (df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(measure).alias("mean"))
              .orderBy(F.col("n").desc(), F.col(group).asc_nulls_last()))


def rollup_totals(df: DataFrame, keys: Sequence[str], measure: str, kind: str = "rollup") -> DataFrame:
    """Grouping sets (rollup or cube) with grouping id."""
    g = df.rollup(*keys) if kind == "rollup" else df.cube(*keys)
    return g.agg(F.sum(measure).alias("total"), F.count(F.lit(1)).alias("n"),
                 F.grouping_id().alias("gid"))


def crosstab_long(df: DataFrame, a: str, b: str) -> DataFrame:
    """A12 long form: one row per (a, b) pair with its count."""
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def crosstab_wide(df: DataFrame, a: str, b: str, values: Sequence) -> DataFrame:
    """A12 wide form: pivot over a declared value list (no distinct pass)."""
    return df.groupBy(a).pivot(b, list(values)).agg(F.count(F.lit(1)))


_AGGS = {"sum": F.sum, "mean": F.avg, "median": F.median, "min": F.min, "max": F.max,
         "count": F.count, "count_distinct": F.count_distinct, "std": F.stddev_samp, "var": F.var_samp}


def aggregate(df: DataFrame, column: str, how: str = "sum", scale: float | None = None) -> DataFrame:
    """One-row ``value`` = how(column) (times ``scale``, e.g. 0.10 for tax)."""
    if how == "median":
        from quarry.plans.prefix import exact_quantiles
        m = exact_quantiles(df, column, [0.5], names=["value"]).select("value")
        return m.select((F.col("value") * F.lit(scale)).alias("value")) if scale is not None else m
    v = _AGGS[how](F.col(column))
    if scale is not None:
        v = v * F.lit(scale)
    return df.agg(v.alias("value"))


def top_group(df: DataFrame, group: str, measure: str, how: str = "sum") -> DataFrame:
    """A2: the group with the largest total (ties: smallest group value)."""
    g = df.groupBy(group).agg(_AGGS[how](F.col(measure)).alias("total"))
    return g.orderBy(F.col("total").desc(), F.col(group).asc_nulls_last()).limit(1)


def day_of_month(df: DataFrame, date_col: str, out: str = "day") -> DataFrame:
    """T3 helper: adds the day of month of a date column."""
    return df.withColumn(out, F.dayofmonth(F.col(date_col)))


def group_mode(df: DataFrame, group: str, value: str, out: str = "mode") -> DataFrame:
    """Most frequent value per group, smallest value on ties.

    Counts per (group, value), the best count per group, then the smallest
    value at that count: three partial aggregates and one join, no window,
    so a group with many distinct values is never sorted in one task.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_k"))
    best = counts.groupBy(group).agg(F.max("_k").alias("_k"))
    return counts.join(best, [group, "_k"]).groupBy(group).agg(F.min(value).alias(out))
