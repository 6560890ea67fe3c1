"""Order-dependent computations without a single-partition window.

A window with an ORDER BY and no PARTITION BY (running totals, global
rank) moves every row into one task. Here the rows are range-partitioned
instead; each range partition is numbered in order and computes its own
running values, and the total of every earlier partition is added as an
offset. The offsets table has one row per partition (bounded by the
partition count, not the data), so it is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import cut_lineage


def _parts(df: DataFrame, order: Sequence[str], num_partitions: int | None) -> DataFrame:
    """Range-partition and tag each row with its partition number.

    Range bounds are sampled from the input, whose row order after a
    shuffle is not deterministic; two evaluations could therefore disagree
    on partition numbers. The tagged frame is written once with a
    reliable checkpoint (shared folder, survives executor loss), so the
    per-partition totals and the local running values read the same rows.
    """
    ordered = [F.col(c).asc_nulls_first() for c in order]
    # without an explicit count the range shuffle uses spark.sql.shuffle.partitions
    # and AQE may merge neighbouring ranges by size (order is preserved)
    ranged = df.repartitionByRange(num_partitions, *ordered) if num_partitions else df.repartitionByRange(*ordered)
    return cut_lineage(ranged.withColumn("_pid", F.spark_partition_id()))


def running_sums(df: DataFrame, order: Sequence[str], values: dict[str, str | Column],
                 num_partitions: int | None = None) -> DataFrame:
    """Running sums ``{out: value}`` in ``order`` (which must be a unique key).

    One range shuffle for all outputs; the per-partition totals are a
    partial aggregate and the offsets a broadcast of #partitions rows.
    """
    tmp = {out: f"_v{i}" for i, out in enumerate(values)}
    src = df
    for out, v in values.items():
        src = src.withColumn(tmp[out], F.col(v) if isinstance(v, str) else v)
    parts = _parts(src, order, num_partitions)
    w = (Window.partitionBy("_pid").orderBy(*[F.col(c).asc_nulls_first() for c in order])
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = parts.select("*", *[F.sum(t).over(w).alias(f"{t}_l") for t in tmp.values()])
    totals = parts.groupBy("_pid").agg(*[F.sum(t).alias(f"{t}_t") for t in tmp.values()])
    ow = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *[F.coalesce(F.sum(f"{t}_t").over(ow), F.lit(0)).alias(f"{t}_o")
                                      for t in tmp.values()])
    joined = local.join(F.broadcast(offsets), "_pid")
    for out, t in tmp.items():
        joined = joined.withColumn(out, F.col(f"{t}_l") + F.col(f"{t}_o"))
    drop = ["_pid"] + [c for t in tmp.values() for c in (t, f"{t}_l", f"{t}_o")]
    return joined.drop(*drop)


def running_sum(df: DataFrame, order: Sequence[str], value: str | Column, out: str,
                num_partitions: int | None = None) -> DataFrame:
    """Running sum of ``value`` in ``order`` (which must be a unique key)."""
    return running_sums(df, order, {out: value}, num_partitions)


def value_ranks(df: DataFrame, value: str, num_partitions: int | None = None) -> DataFrame:
    """Per distinct value: count, rank (1 + rows below), dense rank and
    average rank (the tie-averaged rank used by Spearman).

    Rows are first reduced to one row per distinct value with a partial
    aggregate, so a value that holds a third of the rows is a single
    counter; the prefix sums then run over distinct values only.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("cnt"))
    with_dense = running_sums(counts, [value], {"cum": "cnt", "dense_rank": F.lit(1)}, num_partitions)
    return with_dense.select(
        value, "cnt",
        (F.col("cum") - F.col("cnt") + 1).alias("rank"),
        F.col("dense_rank"),
        ((F.col("cum") - F.col("cnt") + 1 + F.col("cum")) / 2.0).alias("avg_rank"),
    )


def global_row_number(df: DataFrame, order: Sequence[str], out: str = "row_number",
                      num_partitions: int | None = None) -> DataFrame:
    """1-based position in ``order`` (a unique key) across the whole frame."""
    return running_sum(df, order, F.lit(1), out, num_partitions)


def previous_row(df: DataFrame, order: Sequence[str], value: str, out: str,
                 num_partitions: int | None = None) -> DataFrame:
    """``lag(value)`` in a global ``order`` (a unique key) without moving
    every row into one task.

    Inside a range partition the lag is a window partitioned by the
    partition number; the first row of each partition takes the last value
    of the previous non-empty partition from a broadcast table with one
    row per partition.
    """
    parts = _parts(df, order, num_partitions)
    ordered = [F.col(c).asc_nulls_first() for c in order]
    w = Window.partitionBy("_pid").orderBy(*ordered)
    local = parts.select("*", F.lag(value).over(w).alias("_lag"), F.row_number().over(w).alias("_rn"))
    last = parts.groupBy("_pid").agg(F.max_by(value, F.struct(*[F.col(c) for c in order])).alias("_last"))
    carry = last.select("_pid", F.lag("_last").over(Window.orderBy("_pid")).alias("_carry"))
    j = local.join(F.broadcast(carry), "_pid")
    return (j.withColumn(out, F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_lag")))
             .drop("_pid", "_lag", "_rn", "_carry"))


# percentile_approx is off by at most n / ACCURACY ranks; brackets reach four times as far, which
# is over three ranks more than that from SMALL_GROUP values on. Smaller groups are bracketed whole.
ACCURACY = 10_000
SMALL_GROUP = 10_000
# Groups whose brackets are few enough to broadcast.
BROADCAST_GROUPS = 100_000
# Values of one group that one task may count up in order.
WINDOW_VALUES = 1_000_000


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (),
                    names: Sequence[str] | None = None) -> DataFrame:
    """Exact interpolated quantiles (``quantile_cont``) per key, without moving the rows or
    buffering any group's values in one task.

    One pass sketches a bracket of two values around each probability (partial aggregates). A
    second pass counts what lies below each bracket and gathers the distinct values inside with
    their counts, some ten-thousandths of the rows. For probability p with n values, position
    h = (n - 1) p; the answer interpolates the values at ranks floor(h) + 1 and floor(h) + 2,
    found by running counts inside the bracket. The table of brackets has one row per key; it is
    broadcast while its counted size is small. A rank outside its bracket would be an error.
    """
    names = list(names or [f"q{i}" for i in range(len(probs))])
    keys = list(keys)
    base = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v"))
    reach = 4.0 / ACCURACY
    wanted = sorted({min(max(p + d, 0.0), 1.0) for p in probs for d in (-reach, reach)})
    sketch = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", F.array(*[F.lit(w) for w in wanted]), ACCURACY).alias("_s"))

    def end(p: float, d: float, whole: str) -> Column:
        w = p + d
        near = F.col("_s")[wanted.index(w)] if 0.0 < w < 1.0 else F.col(whole)
        return F.when(F.col("_n") < SMALL_GROUP, F.col(whole)).otherwise(near)

    brackets = cut_lineage(sketch.select(
        *keys, "_n", F.array(*[F.struct(end(p, -reach, "_min").alias("lo"), end(p, reach, "_max").alias("hi"))
                               for p in probs]).alias("_b")))
    if keys:
        own = brackets.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_b")
        if brackets.count() <= BROADCAST_GROUPS:
            own = F.broadcast(own)
        on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        met = base.join(own, on).select(*keys, "_v", "_b")
    else:
        row = brackets.first()   # one row
        if row["_n"] == 0:
            return brackets.select(F.col("_n").alias("n"), *[F.lit(None).cast("double").alias(nm) for nm in names])
        met = base.withColumn("_b", F.array(*[F.struct(F.lit(x["lo"]).alias("lo"), F.lit(x["hi"]).alias("hi"))
                                              for x in row["_b"]]))
    below = met.groupBy(*keys).agg(*[F.count_if(F.col("_v") < F.col("_b")[i]["lo"]).alias(f"_below{i}")
                                     for i in range(len(probs))])
    inside = met.select(*keys, "_v", F.explode(F.filter(
        F.sequence(F.lit(0), F.lit(len(probs) - 1)),
        lambda i: F.col("_v").between(F.get(F.col("_b"), i)["lo"], F.get(F.col("_b"), i)["hi"]))).alias("_i")) \
        .groupBy(*keys, "_i", "_v").agg(F.count(F.lit(1)).alias("_c"))
    running = _counted_up(inside, [*keys, "_i"])
    n_below = brackets.select(*keys, "_n").alias("a")
    per_key = _join_keys(n_below, below, keys)
    r = _join_keys(running, per_key, keys)
    aggs = [F.max("_n").alias("_n")]
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(float(p))
        k = F.floor(h)
        cum = F.col(f"_below{i}") + F.col("_upto")
        at = lambda rank: F.max(F.when((F.col("_i") == i) & (cum - F.col("_c") < rank) & (rank <= cum), F.col("_v")))  # noqa: E731, B023
        aggs += [at(k + 1).alias(f"_lo{i}"), at(F.least(k + 2, F.col("_n"))).alias(f"_hi{i}"), F.max(h - k).alias(f"_f{i}")]
    g = r.groupBy(*keys).agg(*aggs)
    missed = F.raise_error(F.lit("a quantile lies outside its bracket"))
    outs = [F.when(F.col(f"_lo{i}").isNull() | F.col(f"_hi{i}").isNull(), missed.cast("double"))
            .otherwise(F.col(f"_lo{i}") + F.col(f"_f{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(nm)
            for i, nm in enumerate(names)]
    return g.select(*keys, F.col("_n").alias("n"), *outs)


def _counted_up(values: DataFrame, group: list[str]) -> DataFrame:
    """``_upto``: running count ``_c`` by ``_v`` within each group. While the largest group is small
    that is a window; a larger one is spread over range partitions, and the count before the group
    is taken off again."""
    values = cut_lineage(values)
    largest = values.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= WINDOW_VALUES:
        return values.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*group).orderBy("_v")))
    total = running_sum(values, [*group, "_v"], "_c", "_total")
    before = total.groupBy(*group).agg(F.min(F.col("_total") - F.col("_c")).alias("_before"))
    return _join_keys(total, before, group).withColumn("_upto", F.col("_total") - F.col("_before")).drop("_total", "_before")


def join_groups(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row per group. The table is pinned and
    counted: while it is small it is broadcast and no row moves; beyond that it is a plain
    equi-join, whose hot groups Spark splits."""
    table = cut_lineage(table)
    return rows.join(F.broadcast(table) if table.count() <= BROADCAST_GROUPS else table, key)


def _join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join of per-key tables, null keys included; without keys both have what one row joins to."""
    renamed = right.withColumnsRenamed({k: f"_j{i}" for i, k in enumerate(keys)})
    if not keys:
        row = renamed.first()    # one row
        return left.select("*", *[F.lit(row[c]).alias(c) for c in renamed.columns])
    on = [left[k].eqNullSafe(F.col(f"_j{i}")) for i, k in enumerate(keys)]
    return left.join(renamed, on).drop(*[f"_j{i}" for i in range(len(keys))])


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str],
                  num_partitions: int | None = None) -> DataFrame:
    """Per key, replace every value by the last non-NULL value at or before
    the row in ``order`` (``last(ignoreNulls)`` over an unbounded frame),
    without one task per key.

    Rows are range-partitioned on (keys, order), so a key holding a third
    of the rows spans many partitions. Each partition fills locally; the
    first rows of a key in a partition take the last non-NULL value of
    that key from earlier partitions (a window over the small
    (partition, key) table, partitioned by key).
    """
    keys, order, values = list(keys), list(order), list(values)
    parts = _parts(df, [*keys, *order], num_partitions)
    ordered = [F.col(c).asc_nulls_first() for c in order]
    w = (Window.partitionBy("_pid", *keys).orderBy(*ordered)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = parts.select("*", *[F.last(v, ignorenulls=True).over(w).alias(f"_l_{v}") for v in values])
    pos = F.struct(*[F.col(c) for c in order])
    tails = parts.groupBy("_pid", *keys).agg(
        *[F.max_by(F.col(v), F.when(F.col(v).isNotNull(), pos)).alias(f"_t_{v}") for v in values])
    cw = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select("_pid", *keys, *[F.last(f"_t_{v}", ignorenulls=True).over(cw).alias(f"_c_{v}")
                                          for v in values])
    j = local.join(carry, ["_pid", *keys])
    for v in values:
        j = j.withColumn(v, F.coalesce(F.col(f"_l_{v}"), F.col(f"_c_{v}")))
    return j.drop("_pid", *[f"_{p}_{v}" for v in values for p in ("l", "c")])


def keyed_ranks(df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str], descending: bool = True,
                buckets: int = 4, num_partitions: int | None = None) -> DataFrame:
    """rank / dense_rank / row_number / ntile within each key, without one
    task per key.

    Ordering is (value desc or asc, tie). rank and dense_rank come from
    per-(key, value) counts and their running sums (the key's start is
    subtracted); row_number is the running count over (key, value, tie);
    ntile follows from row_number and the key's size (first n % b buckets
    get one extra row, the SQL rule).
    """
    keys, tie = list(keys), list(tie)
    sval = F.col(value) * (-1 if descending else 1)
    base = df.withColumn("_sv", sval)
    counts = base.groupBy(*keys, "_sv").agg(F.count(F.lit(1)).alias("_c"))
    rk = running_sums(counts, [*keys, "_sv"], {"_g": "_c", "_d": F.lit(1)}, num_partitions)
    start = rk.groupBy(*keys).agg(F.min(F.col("_g") - F.col("_c")).alias("_gs"), F.min(F.col("_d") - 1).alias("_ds"),
                                  F.sum("_c").alias("_n"))
    vr = rk.join(start, keys).select(*keys, "_sv", "_n", (F.col("_g") - F.col("_c") - F.col("_gs") + 1).alias("rank"),
                                     (F.col("_d") - F.col("_ds")).alias("dense_rank"))
    rows = running_sums(base.withColumn("_one", F.lit(1)), [*keys, "_sv", *tie], {"_rn": "_one"}, num_partitions)
    rstart = rows.groupBy(*keys).agg(F.min("_rn").alias("_r0"))
    out = rows.join(rstart, keys).withColumn("row_number", F.col("_rn") - F.col("_r0") + 1).join(vr, [*keys, "_sv"])
    n, rn, b = F.col("_n"), F.col("row_number"), F.lit(buckets)
    q, r = F.floor(n / b), n % b
    big = r * (q + 1)
    ntile = F.when(q == 0, rn).when(rn <= big, F.floor((rn - 1) / (q + 1)) + 1) \
             .otherwise(F.floor((rn - 1 - big) / F.greatest(q, F.lit(1))) + r + 1)
    return out.withColumn("ntile", ntile.cast("bigint")).drop("_sv", "_one", "_rn", "_r0", "_n")
