"""Operator 6: quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage of the whole text becomes a feature vector;
gated attention (Ilse, Tomczak and Welling, 2018) weighs the passages,
``a_k = softmax_k(w . (tanh(V h_k) * sigmoid(U h_k)))``, and a logistic output scores the weighted
sum of the encoded passages ``h_k = tanh(E x_k)``. Only document labels train it.

Passages are encoded by Spark tasks. The fit runs on a bounded sample of labelled documents
(``sample`` rows, the first by hash of the id; the passages of one sampled document are drawn to
the driver as feature vectors, never as text) and gives a few thousand weights, which is what is
broadcast. Scoring streams over all documents.

Defined results: null and empty texts are one empty passage and get a score like any other; a
document of any length is scored by all its passages; labels other than 0 and 1 (null included)
are not learned from; repeated rows are scored each, and a document with several labels
contributes a row per label; without rows of both labels every score is the share of label 1
(0.5 without any); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import arrow_slices, free_names, materialize

# Words of a passage; labelled documents of a fit; passages that all of them may bring.
PASSAGE_WORDS, SAMPLE, SAMPLE_PASSAGES = 128, 2500, 200_000

# Classes of UTF-8 bytes whose shares describe a passage.
_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>@^~_={}[]\\/", b"!?", b".", b",;:", b"()'\"-",
            b"abcdefghijklmnopqrstuvwxyz", bytes(range(0x80, 0xc0)), bytes(range(0xc0, 0x100)))
_SHARES = np.zeros((256, len(_CLASSES)))
for _i, _c in enumerate(_CLASSES):
    _SHARES[list(_c), _i] = 1
FEATURES = len(_CLASSES) + 17


def bag(text: str | None, words: int = PASSAGE_WORDS) -> np.ndarray:
    """One row of features for each passage of ``words`` words; no word gives one empty passage.

    Shares of byte classes, word lengths, shapes and repetition of the passage, and the
    document's line lengths and repeated lines."""
    text = text or ""
    w = text.split()
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    per_line = [np.log1p(len(w) / max(len(lines), 1)), len(set(lines)) / max(len(lines), 1), np.log1p(len(lines))]
    rows = []
    for a in range(0, max(len(w), 1), words):
        part = w[a:a + words]
        n = max(len(part), 1)
        raw = np.frombuffer(" ".join(part).encode("utf-8", "surrogatepass"), np.uint8)
        lens = np.fromiter(map(len, part), np.float64, len(part)) if part else np.zeros(1)
        seen: dict[str, int] = {}
        for x in part:
            seen[x] = seen.get(x, 0) + 1
        rows.append([
            *(np.bincount(raw, minlength=256) @ _SHARES / max(len(raw), 1)),
            np.log1p(len(part)), lens.mean(), lens.std(), lens.max() ** 0.5,
            np.count_nonzero(lens <= 3) / n, np.count_nonzero(lens >= 12) / n,
            len(seen) / n, max(seen.values(), default=0) / n,
            len(set(zip(part, part[1:]))) / max(len(part) - 1, 1),
            len(set(zip(part, part[1:], part[2:]))) / max(len(part) - 2, 1),
            sum(map(str.isupper, part)) / n, sum(map(str.istitle, part)) / n, sum(map(str.isalpha, part)) / n,
            float(not part), *per_line])
    return np.array(rows, np.float32)


def bags(docs: DataFrame, words: int, doc_col: str, text_col: str) -> DataFrame:
    """(doc_id, passage, x): the feature vectors of every passage."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, t in zip(pdf["doc_id"], pdf["text"]):
                x = bag(t, words)
                yield pd.DataFrame({"doc_id": i, "passage": np.arange(len(x), dtype=np.int32),
                                    "x": [v.tobytes() for v in x]})

    return docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInPandas(run, "doc_id long, passage int, x binary")


class AttentionModel:
    """Gated attention over passages with a logistic output, in numpy."""

    def __init__(self, hidden: int = 16, gate: int = 8, seed: int = 0):
        rng = np.random.default_rng(seed)
        s = lambda *d: rng.normal(0, 1 / np.sqrt(d[-1]), d)
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.p = {"E": s(hidden, FEATURES), "e": np.zeros(hidden), "V": s(gate, hidden), "U": s(gate, hidden),
                  "w": s(gate), "c": s(hidden), "b": np.zeros(1)}
        self.constant: float | None = None

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict:
        """x: passages of all bags one after the other; starts: each bag's first."""
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["E"].T + p["e"])
        t, g = np.tanh(h @ p["V"].T), 1 / (1 + np.exp(-(h @ p["U"].T)))
        s = (t * g) @ p["w"]
        sizes = np.diff(np.append(starts, len(x)))
        of = np.repeat(np.arange(len(starts)), sizes)
        a = np.exp(s - np.maximum.reduceat(s, starts)[of])
        a /= np.add.reduceat(a, starts)[of]
        z = np.add.reduceat(a[:, None] * h, starts)
        out = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "of": of, "out": out}

    def score(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(starts), self.constant)
        return self.forward(x.astype(float), starts)["out"]

    def fit(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, epochs: int = 250, rate: float = 0.03,
            decay: float = 1e-4) -> AttentionModel:
        if len(set(y.tolist())) < 2:
            self.constant = float(y[0]) if len(y) else 0.5
            return self
        x = x.astype(float)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        p = self.p
        # both labels weigh the same
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
        m = {k: np.zeros_like(v) for k, v in p.items()}
        v2 = {k: np.zeros_like(v) for k, v in p.items()}
        for step in range(1, epochs + 1):
            f = self.forward(x, starts)
            d = weight * (f["out"] - y)
            dz = d[:, None] * p["c"]
            da = (dz[f["of"]] * f["h"]).sum(axis=1)
            ds = f["a"] * (da - np.add.reduceat(f["a"] * da, starts)[f["of"]])
            dt, dg = ds[:, None] * p["w"] * f["g"], ds[:, None] * p["w"] * f["t"]
            dpt, dpg = dt * (1 - f["t"] ** 2), dg * f["g"] * (1 - f["g"])
            dh = f["a"][:, None] * dz[f["of"]] + dpt @ p["V"] + dpg @ p["U"]
            dph = dh * (1 - f["h"] ** 2)
            grad = {"E": dph.T @ f["x"], "e": dph.sum(axis=0), "V": dpt.T @ f["h"], "U": dpg.T @ f["h"],
                    "w": (ds[:, None] * f["t"] * f["g"]).sum(axis=0), "c": f["z"].T @ d, "b": np.array([d.sum()])}
            lr = rate * 0.5 * (1 + np.cos(np.pi * step / epochs))
            for k, gk in grad.items():
                gk = gk + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * gk
                v2[k] = 0.999 * v2[k] + 0.001 * gk ** 2
                p[k] -= lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v2[k] / (1 - 0.999 ** step)) + 1e-8)
        return self


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", words: int = PASSAGE_WORDS,
        sample: int = SAMPLE, doc_col: str = "doc_id", text_col: str = "text",
        most_passages: int = SAMPLE_PASSAGES) -> AttentionModel:
    """Learn from whole labelled documents (``labels``: doc_col, label_col): the first ``sample`` by a
    hash of the id, and of those, in that order, as many as have ``most_passages`` passages together.
    These bounds are what the driver holds; the choice does not depend on how the tables lie."""
    picked = labels.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")) \
        .filter("y in (0, 1) and doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    texts = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # at most ``sample`` ids, so the broadcast is bounded; only their texts are encoded
    few = texts.join(F.broadcast(picked.select("doc_id").distinct()), "doc_id", "left_semi")
    every = materialize(bags(few, words, "doc_id", "text"), "mil-bags")
    # one row per picked document
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    fits = every.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", upto).filter(F.col("upto") <= most_passages)
    rows = every.join(F.broadcast(fits.select("doc_id")), "doc_id", "left_semi").join(F.broadcast(picked), "doc_id") \
        .toPandas().sort_values(["doc_id", "y", "passage", "x"], kind="stable")
    model = AttentionModel()
    if not len(rows):
        return model.fit(np.zeros((0, FEATURES)), np.zeros(0, int), np.zeros(0))
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(len(rows), FEATURES)
    first = (rows["doc_id"].diff().ne(0) | rows["y"].diff().ne(0)).to_numpy()
    starts = np.flatnonzero(first)
    return model.fit(x, starts, rows["y"].to_numpy()[starts].astype(float))


def score(docs: DataFrame, model: AttentionModel, words: int = PASSAGE_WORDS, text_col: str = "text",
          keep: tuple = ("doc_id",), score_col: str = "score") -> DataFrame:
    """The ``keep`` columns and the score (0 to 1) of every whole text; of the kept columns, one with
    the score's name is left out."""
    keep = [c for c in keep if c != score_col]     # a column of that name gives way to the score
    types = dict(docs.dtypes)
    own = text_col in keep and types[text_col] == "string"
    at = keep.index(text_col) if own else len(keep)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            for a, b in arrow_slices(texts):
                xs = [bag(t, words) for t in texts.slice(a, b - a).to_pylist()]
                starts = np.cumsum([0, *map(len, xs)])[:-1]
                scores = pa.array(sent.value.score(np.concatenate(xs), starts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(a, b - a) for i in range(len(keep))] + [scores], names=[*keep, score_col])

    return docs.select(*keep, *([] if own else [F.col(text_col).cast("string").alias(*free_names(keep, "text"))])).mapInArrow(
        run, ", ".join([f"`{c}` {types[c]}" for c in keep] + [f"`{score_col}` double"]))


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
