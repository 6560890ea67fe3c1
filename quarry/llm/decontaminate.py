"""Operator 8: benchmark decontamination with a distributed positional inverted index.

``build_index`` stores every token of the training texts as postings. The index is cut by
document into segments, as search engines do: a segment is one row with its documents, its
sorted terms and, term after term, the ascending token positions (delta-coded, zstd). No shuffle
is needed to build it, and a common word's postings are spread over all segments.

``phrase_matches`` looks up the windows of the test items. For each window the postings of its
rarest term (by the count over all segments) give the candidate places; the other terms, rarest
first, keep the places where the term has a posting at its own offset (exact phrase) or within
``slack`` words of it (proximity match). The test set is read in blocks of bounded size; each
block is broadcast and meets every segment.

Words: lower-case A-Z, then runs of ASCII letters and digits and non-ASCII characters. A window
is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window.

Defined results: null and empty texts have no words, so nothing hits; items without words match
nothing; repeated items with one id count once; a null item id is written as ``null``; repeated
document rows are reported each; empty tables give no matches; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import arrow_slices, fresh_path

# Characters of test items in one block; a longer item is a block alone.
BLOCK_CHARS = 4_000_000
# Text of one segment.
SEGMENT_BYTES = 8_000_000
# Words between two documents of a segment on its position axis: more than any phrase can bridge.
GAP = 1 << 12

_KEEP = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))

SEGMENT = ("segment string, doc_ids binary, known binary, n_words binary, starts binary, terms binary, "
           "counts binary, postings binary")


def words(text: str | None) -> list[bytes]:
    """Words of a text; bytes.lower changes ASCII letters only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_KEEP).split()


def pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


def segment_of(doc_ids: pa.Array, texts: list) -> list:
    """The columns of a segment after its name."""
    by_doc = [words(t) for t in texts]
    sizes = np.fromiter(map(len, by_doc), np.int64, len(by_doc))
    starts = np.concatenate([[0], np.cumsum(sizes + GAP)[:-1]]) if len(sizes) else sizes
    tokens = pa.array([w for d in by_doc for w in d], pa.binary())
    coded = tokens.dictionary_encode()
    terms = coded.dictionary.to_pylist()
    order = sorted(range(len(terms)), key=terms.__getitem__)
    rank = np.empty(len(terms), np.int32)
    rank[order] = np.arange(len(terms), dtype=np.int32)
    codes = rank[coded.indices.to_numpy()] if len(terms) else np.zeros(0, np.int32)
    # token i of the segment lies in its document, which starts at starts[doc]
    at = np.arange(len(codes)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    by_term = np.argsort(codes, kind="stable")
    counts = np.bincount(codes, minlength=len(terms)).astype(np.int32)
    postings = at[by_term].astype(np.int64)
    deltas = np.diff(postings, prepend=0).astype(np.int32)
    known = doc_ids.is_valid().to_numpy(zero_copy_only=False)
    ids = doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return [pack(ids), pack(known), pack(sizes), pack(starts), zstandard.ZstdCompressor(level=1).compress(
        b"\n".join(terms[i] for i in order)), pack(counts), pack(deltas)]


def build_index(docs: DataFrame, path: str, doc_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the index of ``docs`` as Parquet under ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        name = TaskContext.get().partitionId()
        n = 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in arrow_slices(texts, SEGMENT_BYTES):
                cols = segment_of(ids.slice(a, b - a), texts.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{name}-{n}"])] + [pa.array([c], pa.binary()) for c in cols],
                    names=["segment", "doc_ids", "known", "n_words", "starts", "terms", "counts", "postings"])
                n += 1

    docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, SEGMENT).write.option("compression", "none").parquet(path)


class Block:
    """Windows of a block of items over the block's own term numbers, -1 after a short one's end."""

    def __init__(self, items: list[tuple], window: int):
        number: dict[bytes, int] = {}
        rows, owner = [], []
        for item, text in items:
            w = [number.setdefault(x, len(number)) for x in words(text)]
            if not w:
                continue
            found = [w[i:i + window] for i in range(len(w) - window + 1)] or [w + [-1] * (window - len(w))]
            rows += found
            owner += [item] * len(found)
        self.terms = list(number)
        self.windows = np.array(rows, np.int64).reshape(-1, window)
        self.items = owner
        # rarest term first, set once the counts over the whole index are known
        self.order = np.tile(np.arange(window), (len(rows), 1))

    def rank(self, counts: dict[bytes, int]) -> None:
        of = np.array([counts.get(t, 0) for t in self.terms] + [2 ** 62], np.int64)
        self.order = np.argsort(of[self.windows], axis=1, kind="stable")


def item_blocks(items: DataFrame, item_col: str, text_col: str, most: int = BLOCK_CHARS):
    """The distinct items, on the driver one block at a time."""
    rows = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")) \
        .filter("text is not null").distinct()
    block, size = [], 0
    for r in rows.toLocalIterator():
        if block and size + len(r.text) > most:
            yield block
            block, size = [], 0
        block.append(("null" if r.item is None else r.item, r.text))
        size += len(r.text)
    if block:
        yield block


def term_counts(index: DataFrame, terms: list[bytes]) -> dict[bytes, int]:
    """Tokens of each given term in the whole index; at most one row per term comes back."""
    wanted = index.sparkSession.sparkContext.broadcast(frozenset(terms))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t, c in zip(pdf["terms"], pdf["counts"]):
                names = zstandard.ZstdDecompressor().decompress(t).split(b"\n")
                found = [(n, k) for n, k in zip(names, unpack(c, np.int32).tolist()) if n in wanted.value]
                yield pd.DataFrame(found, columns=["term", "n"])

    rows = index.select("terms", "counts").mapInPandas(run, "term binary, n long") \
        .groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.term): r.n for r in rows}


def places(block: Block, names: list[bytes], counts: np.ndarray, deltas: np.ndarray, slack: int):
    """(window row, first token position) of every match in one segment."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    here = {t: i for i, t in enumerate(names)}
    # the block's terms that the segment has, in ascending segment order, with their postings
    local = np.array([here.get(t, -1) for t in block.terms] + [-2], np.int64)
    w = local[block.windows]
    rows = np.flatnonzero((w != -1).all(axis=1))
    if not len(rows):
        return none
    begin = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    positions = np.cumsum(deltas, dtype=np.int64)
    used = np.unique(w[rows])
    used = used[used >= 0]
    place = {int(t): i for i, t in enumerate(used)}
    span = int(positions.max()) + GAP
    # one ascending key per posting: (term, position)
    keys = np.concatenate([positions[begin[t]:begin[t + 1]] + i * span for i, t in enumerate(used)])
    first = np.concatenate([[0], np.cumsum(counts[used], dtype=np.int64)])
    w = np.array([[place.get(int(t), -1) for t in r] for r in w[rows]], np.int64)
    order = block.order[rows]
    anchor = order[:, 0]
    term = w[np.arange(len(rows)), anchor]
    n = first[term + 1] - first[term]
    row = np.repeat(np.arange(len(rows)), n)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = keys[first[term[row]] + inside] - term[row] * span - anchor[row]
    for r in range(1, w.shape[1]):
        if not len(row):
            return none
        off = order[row, r]
        t = w[row, off]
        want = start + off + t * span
        if slack:
            i = np.searchsorted(keys, want - slack)
            ok = (keys[np.minimum(i, len(keys) - 1)] <= want + slack) & (i < len(keys))
            # the neighbour must be a posting of the same term
            ok &= keys[np.minimum(i, len(keys) - 1)] // span == t
        else:
            i = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            ok = keys[i] == want
        ok |= t < 0
        row, start = row[ok], start[ok]
    return rows[row], start


def phrase_matches(index: DataFrame, items: DataFrame, window: int = 10, slack: int = 0,
                   item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per document with a match and block of items: segment, row (its place in the
    segment), spans (word ranges [from, to) of the matched places, merged), items.

    With ``slack`` every term may lie up to so many words from its place relative to the
    window's rarest term; a span then covers the window's nominal place.
    """
    spark = index.sparkSession
    schema = "segment string, row int, spans array<struct<from: int, to: int>>, items array<string>"
    out = spark.createDataFrame([], schema)
    for items_of_block in item_blocks(items, item_col, text_col):
        block = Block(items_of_block, window)
        if not len(block.windows):
            continue
        block.rank(term_counts(index, block.terms))
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            b = sent.value
            length = (b.windows >= 0).sum(axis=1)
            for pdf in batches:
                for seg in pdf.itertuples(index=False):
                    names = zstandard.ZstdDecompressor().decompress(seg.terms).split(b"\n")
                    counts = unpack(seg.counts, np.int32)
                    if not len(counts):
                        continue
                    row, start = places(b, names, counts, unpack(seg.postings, np.int32), slack)
                    if not len(row):
                        continue
                    starts, sizes = unpack(seg.starts, np.int64), unpack(seg.n_words, np.int64)
                    doc = np.searchsorted(starts, start + (slack and length[row] // 2), side="right") - 1
                    a = np.maximum(start - starts[doc], 0)
                    z = np.minimum(start + length[row] - starts[doc], sizes[doc])
                    by = np.lexsort((a, doc))
                    doc, a, z, row = doc[by], a[by], z[by], row[by]
                    cuts = np.flatnonzero(np.diff(doc)) + 1
                    yield pd.DataFrame([
                        (seg.segment, int(doc[g[0]]), merged(a[g], z[g]), sorted({b.items[i] for i in np.unique(row[g])}))
                        for g in np.split(np.arange(len(doc)), cuts)], columns=["segment", "row", "spans", "items"])

        out = out.unionByName(index.select("segment", "n_words", "starts", "terms", "counts", "postings")
                              .mapInPandas(run, schema))
    return out


def merged(a: np.ndarray, z: np.ndarray) -> list[dict]:
    """The union of ranges [a, z) that are sorted by ``a``."""
    top = np.maximum.accumulate(z)
    new = np.concatenate([[True], a[1:] > top[:-1]])
    ends = np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)
    return [{"from": int(x), "to": int(y)} for x, y in zip(a[new], top[ends])]


def index_documents(index: DataFrame) -> DataFrame:
    """(segment, row, doc_id, n_words) of every indexed document."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for seg in pdf.itertuples(index=False):
                ids, known = unpack(seg.doc_ids, np.int64), unpack(seg.known, np.bool_)
                n = unpack(seg.n_words, np.int64)
                yield pd.DataFrame({"segment": seg.segment, "row": np.arange(len(ids), dtype=np.int32),
                                    "doc_id": ids, "known": known, "n_words": n})

    return index.select("segment", "doc_ids", "known", "n_words") \
        .mapInPandas(run, "segment string, row int, doc_id long, known boolean, n_words long") \
        .select("segment", "row", F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "n_words")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, slack: int = 0, doc_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside a match), n_items, items
    (ids as strings, sorted), contaminated."""
    spark = docs.sparkSession
    path = fresh_path(spark, "positions")
    build_index(docs, path, doc_col, text_col)
    index = spark.read.schema(SEGMENT).parquet(path)
    found = phrase_matches(index, items, window, slack, item_col, item_text_col)
    # the blocks' spans of one document, merged; a document has at most one row per block
    by_doc = found.groupBy("segment", "row").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("top")),
        lambda s, x: F.struct((s["n"] + F.greatest(x["to"] - F.greatest(x["from"], s["top"]), F.lit(0))).alias("n"),
                              F.greatest(s["top"], x["to"]).alias("top")), lambda s: s["n"])
    hits = by_doc.select("segment", "row", covered.cast("long").alias("n_hit"), "items")
    return index_documents(index).join(hits, ["segment", "row"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))
