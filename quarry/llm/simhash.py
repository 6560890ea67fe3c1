"""Operator 5: SimHash near-duplicates by the generalised pigeonhole principle.

1. Fingerprint: lower-case A-Z, words ``[^\\x20\\x09-\\x0D]+``, shingles of ``k`` words, XXH64
   (seed 42) of each; a bit is 1 if set in over half of the hashes.
2. Equal fingerprints collapse into one class before anything is compared.
3. The 64 bits are grouped by correlation into parts, measured on a bounded sample. A dynamic
   program allots each part a threshold (-1: unused) from the estimated number of candidates:
   if the thresholds sum to ``distance - parts + 1``, a linked pair is within the threshold of
   at least one part. The number of parts with the lowest estimated cost is taken.
4. Index rows hold a class's own part value, probe rows the values within the threshold. Rows
   with the same (part, value) are compared exactly. A bucket that is too large for one task is
   cut into blocks and every pair of blocks is compared, so no link is lost; each comparison
   returns a spanning forest of its links, never all pairs.
5. Components of the links by alternating large-star / small-star rounds until nothing changes.

Defined results: null and empty texts have no words and fingerprint zero, linked like any other;
fewer words than ``k`` make one shingle; rows that repeat a ``doc_id`` keep their own fingerprint
each; rows with a null ``doc_id`` get component null only if nothing else is linked to them
(null is never the smallest id); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import arrow_slices, free_names, materialize
from quarry.llm.components import connected_components

BITS = 64
# Fingerprints taken to measure bit correlation and candidate counts.
SAMPLE = 2048
# Rows of a bucket that one comparison task holds at most on each side.
BLOCK = 4096
# Cost of a probe row against the cost of one comparison.
PROBE_COST = 200.0


def fingerprint(text: str | None, k: int) -> int:
    """SimHash of one text (unsigned)."""
    from xxhash import xxh64_intdigest
    # bytes.lower() and bytes.split() work on ASCII letters and ASCII white space only
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= k:
        return xxh64_intdigest(b" ".join(words), 42)
    hashes = np.fromiter((xxh64_intdigest(b" ".join(s), 42) for s in zip(*(words[i:] for i in range(k)))),
                         np.uint64, len(words) - k + 1)
    counts = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 65536):
        part = hashes[a:a + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 3, doc_col: str = "doc_id", text_col: str = "text",
                 key_cols: tuple = ()) -> DataFrame:
    """(doc_id, fp) and the 64-bit integers ``key_cols``: one row per document, the fingerprint as
    a signed 64-bit integer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in arrow_slices(texts):
                fp = np.fromiter((fingerprint(t, k) for t in texts.slice(a, b - a).to_pylist()), np.uint64, b - a)
                keys = [batch.column(2 + i).slice(a, b - a) for i in range(len(key_cols))]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(fp.view(np.int64)), *keys],
                                                 names=["doc_id", "fp", *key_cols])

    return docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *key_cols) \
        .mapInArrow(run, ", ".join(["doc_id long, fp long", *[f"`{c}` long" for c in key_cols]]))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """``parts`` groups of bits of about equal size; a group takes the bit that is most
    correlated with its members next."""
    if len(sample) < 2:
        corr = np.zeros((BITS, BITS))
    else:
        cols = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(float)
        cols -= cols.mean(axis=0)
        norm = np.sqrt((cols ** 2).sum(axis=0))
        norm[norm == 0] = np.inf
        corr = np.abs((cols / norm).T @ (cols / norm))
    left, groups = set(range(BITS)), []
    for g in range(parts):
        size = (BITS - sum(map(len, groups))) // (parts - g)
        first = min(left, key=lambda b: (-sum(corr[b, c] for c in left if c != b), b))
        group = [first]
        left.remove(first)
        while len(group) < size:
            nxt = min(left, key=lambda b: (-sum(corr[b, c] for c in group), b))
            group.append(nxt)
            left.remove(nxt)
        groups.append(sorted(group))
    return groups


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def probes(width: int, t: int) -> int:
    """Values within ``t`` bits of one value of ``width`` bits."""
    total, term = 0, 1
    for i in range(t + 1):
        total += term
        term = term * (width - i) // (i + 1)
    return total if t >= 0 else 0


def allocate(cost: list[list[float]], total: int) -> list[int]:
    """Thresholds per part (each from -1) that sum to ``total`` at the lowest summed cost, by
    dynamic programming; ``cost[i][t + 1]`` is part i's cost at threshold t."""
    best = {0: (0.0, [])}
    for c in cost:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (v, chosen) in best.items():
            for j, x in enumerate(c):
                key, got = used + j, (v + x, [*chosen, j - 1])
                if key not in nxt or got < nxt[key]:
                    nxt[key] = got
        best = nxt
    return best[total + len(cost)][1]


def plan(sample: np.ndarray, n: int, distance: int, most_parts: int = 8) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each used part, for ``n`` distinct fingerprints."""
    found = None
    a = sample[: len(sample) // 2]
    b = sample[len(sample) // 2: 2 * len(a)]
    for parts in range(1, min(most_parts, distance + 2) + 1):
        groups = group_bits(sample, parts)
        cost = []
        for bits in groups:
            mask = np.uint64(mask_of(bits))
            near = np.zeros(distance + 1)
            for i in range(len(a)):
                d = popcount((a[i] ^ b) & mask)
                near += np.bincount(d[d <= distance], minlength=distance + 1)[: distance + 1]
            # a pair that the sample does not show still meets with the chance of random bits
            share = (np.cumsum(near) + 0.5) / max(len(a) * len(b), 1)
            random = np.array([probes(len(bits), t) / 2.0 ** len(bits) for t in range(distance + 1)])
            pairs = np.where(np.cumsum(near) > 0, share, random) * (float(n) * n / 2)
            cost.append([0.0, *(pairs[t] + PROBE_COST * n * probes(len(bits), t) for t in range(distance + 1))])
        chosen = allocate(cost, distance - parts + 1)
        value = sum(c[t + 1] for c, t in zip(cost, chosen))
        if found is None or value < found[0]:
            found = (value, [(bits, t) for bits, t in zip(groups, chosen) if t >= 0])
    return found[1]


def flips(bits: list[int], t: int) -> list[int]:
    """Signed masks of 1 to ``t`` of the given bits."""
    out = []
    for r in range(1, t + 1):
        out += [signed(mask_of(list(c))) for c in combinations(bits, r)]
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def forest(left: np.ndarray, right: np.ndarray | None, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks, or within one if ``right`` is None.

    Breadth-first: each reached fingerprint is compared with those not reached yet, so a block
    of n fingerprints needs at most n passes and returns fewer than n links.
    """
    nodes = left if right is None else np.concatenate([left, right])
    side = np.zeros(len(nodes), np.int8)
    side[len(left):] = 1
    open_ = np.arange(len(nodes))
    out: list[tuple[int, int]] = []
    while len(open_):
        queue, open_ = [open_[0]], open_[1:]
        while queue and len(open_):
            x = queue.pop()
            hit = popcount(nodes[open_] ^ nodes[x]) <= distance
            if right is not None:
                hit &= side[open_] != side[x]
            if hit.any():
                got = open_[hit]
                out += [(int(nodes[x]), int(nodes[y])) for y in got]
                queue += got.tolist()
                open_ = open_[~hit]
    return out


def compare_block(fp: np.ndarray, own: np.ndarray, x: np.ndarray, lo: int, hi: int, distance: int) -> list:
    """Links of one bucket, or of one pair of its blocks. A probe need only meet own members."""
    if own.all():
        return forest(fp, None, distance) if lo == hi else forest(fp[x == lo], fp[x == hi], distance)
    if lo == hi:
        return forest(fp[own], None, distance) + forest(fp[own], fp[~own], distance)
    return forest(fp[own & (x == lo)], fp[~own & (x == hi)], distance) \
        + forest(fp[own & (x == hi)], fp[~own & (x == lo)], distance) \
        + forest(fp[own & (x == lo)], fp[own & (x == hi)], distance)


def compare_groups(pdf: pd.DataFrame, keys: list[str], distance: int, small: int = 16) -> pd.DataFrame:
    """Links of whole buckets that follow each other in ``pdf``. Small ones are compared together,
    each row with the next 1, 2, ... rows of its bucket."""
    fp = pdf["fp"].to_numpy().view(np.uint64)
    own, x = pdf["own"].to_numpy(), pdf["x"].to_numpy()
    lo, hi = pdf["lo"].to_numpy(), pdf["hi"].to_numpy()
    first = np.ones(len(pdf), bool)
    if len(pdf) > 1:
        first[1:] = False
        for k in keys:
            v = pdf[k].to_numpy()
            first[1:] |= v[1:] != v[:-1]
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(pdf)))
    group = np.repeat(np.arange(len(starts)), sizes)
    simple = (sizes <= small) & (lo[starts] == hi[starts])
    found: list[np.ndarray] = []
    rows = np.flatnonzero(simple[group])
    for step in range(1, small):
        i, j = rows[:-step], rows[step:]
        same = group[i] == group[j]
        if not same.any():
            break
        i, j = i[same], j[same]
        hit = (popcount(fp[i] ^ fp[j]) <= distance) & (own[i] | own[j])
        found.append(np.stack([fp[i[hit]], fp[j[hit]]], axis=1))
    for g in np.flatnonzero(~simple):
        a, b = starts[g], starts[g] + sizes[g]
        got = compare_block(fp[a:b], own[a:b], x[a:b], int(lo[a]), int(hi[a]), distance)
        found.append(np.array(got, np.uint64).reshape(-1, 2))
    pairs = (np.concatenate(found) if found else np.zeros((0, 2), np.uint64)).view(np.int64)
    return pd.DataFrame({"a": pairs.min(axis=1, initial=2 ** 63 - 1), "b": pairs.max(axis=1, initial=-2 ** 63)})


def links(classes: DataFrame, distance: int = 3, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints ``classes.fp`` that connect whatever is
    within ``distance`` bits of each other, directly or over other fingerprints."""
    spark = classes.sparkSession
    n = classes.count()
    picked = classes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()
    parts = plan(np.array([r.fp for r in picked], np.int64).view(np.uint64), n, distance)
    rows = None
    for i, (bits, t) in enumerate(parts):
        key = F.col("fp").bitwiseAND(F.lit(signed(mask_of(bits))))
        own = classes.select(F.lit(i).alias("part"), key.alias("value"), "fp", F.lit(True).alias("own"))
        rows = own if rows is None else rows.unionByName(own)
        if t >= 1:
            masks = F.array(*(F.lit(m) for m in flips(bits, t)))
            near = classes.select(key.alias("v"), "fp", F.explode(masks).alias("m")) \
                .select(F.lit(i).alias("part"), F.col("v").bitwiseXOR(F.col("m")).alias("value"), "fp",
                        F.lit(False).alias("own"))
            rows = rows.unionByName(near)
    # buckets with a pair to compare, in blocks of about ``block`` rows
    sizes = rows.groupBy("part", "value").agg(F.count(F.lit(1)).alias("size"), F.max("own").alias("any_own")) \
        .filter("size > 1 and any_own").select("part", "value", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    placed = rows.join(sizes, ["part", "value"]).select(
        "part", "value", "fp", "own", "blocks", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int").alias("x"))
    dealt = placed.select(
        "part", "value", "fp", "own", "x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y")) \
        .select("part", "value", "fp", "own", "x", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"))

    keys = ["part", "value", "lo", "hi"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            if rest is not None and len(rest):
                pdf = pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = pdf[keys].iloc[-1]
            whole = int((pdf[keys] != last).any(axis=1).to_numpy().nonzero()[0].max(initial=-1)) + 1
            rest = pdf.iloc[whole:]
            if whole:
                yield compare_groups(pdf.iloc[:whole], keys, distance)
        if rest is not None and len(rest):
            yield compare_groups(rest, keys, distance)

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(compare, "a long, b long").distinct()


def labelled(classes: DataFrame, distance: int) -> DataFrame:
    """``classes`` (fp, first) with ``label``, the smallest fingerprint of the component."""
    labels = connected_components(links(classes, distance), "a", "b")
    return classes.join(labels, classes.fp == labels.node, "left") \
        .select("fp", "first", F.coalesce("label", "fp").alias("label"))


def one_per_component(docs: DataFrame, k: int = 3, distance: int = 3, doc_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component of the rows' fingerprints: the smallest id (null is
    last), then text hash, then hash of the row. Rows are judged one by one, whatever ids they share."""
    key = free_names(docs.columns, "id", "th", "row")
    id_, th, row = key
    rows = docs.select("*", F.col(doc_col).cast("long").alias(id_), F.xxhash64(F.col(text_col).cast("string")).alias(th),
                       F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias(row))
    fps = materialize(fingerprints(rows, k, doc_col, text_col, (th, row)), "simhash-rows")
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias(id_), th, row)
    classes = materialize(fps.groupBy("fp").agg(F.min(place).alias("first")), "simhash-classes")
    stay = labelled(classes, distance).groupBy("label").agg(F.min("first").alias("first")).select(
        *[F.col("first")[c].alias(f"{c}_stays") for c in key])
    same = rows[id_].eqNullSafe(stay[f"{id_}_stays"]) & (rows[th] == stay[f"{th}_stays"]) & (rows[row] == stay[f"{row}_stays"])
    # rows that are equal in every column have the same key
    return rows.join(stay, same, "left_semi").dropDuplicates(key).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(docs: DataFrame, k: int = 3, distance: int = 3,
                    doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest
    doc_id reachable over links of at most ``distance`` differing bits)."""
    fps = materialize(fingerprints(docs, k, doc_col, text_col), "simhash")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    of = labelled(classes, distance)
    smallest = of.groupBy("label").agg(F.min("first").alias("component_id"))
    by_fp = of.select("fp", "label").join(smallest, "label").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
