"""Operator 10: quality rules with an n-gram perplexity band.

Base rules count words, symbols, repeated lines and repeated word windows of the whole text. Then a
modified Kneser-Ney model (Chen and Goodman, 1998) of characters, of order 5 and one for each
language, gives every document's perplexity per character; a document outside its language's lower
and upper perplexity is rejected. Each half of a language's documents (by hash of the text) is
scored by the model of the other half, so that no document vouches for its own n-grams.

``unit="word"`` takes a model of words, of order 3, instead, and the perplexity per word: n-grams are
rows of word hashes, counts of both halves stand side by side, every level is a grouping and joins,
and documents are scored by an equi-join of their n-grams with the model; nothing of it passes the
driver. The registered query does not use it: n-grams of words do not fit its disk budget (README).

All documents are counted: tasks count the n-grams of slices of text, Spark sums them and derives
continuation counts, discounts and interpolated probabilities by grouping and joins. For scoring,
the model becomes sorted arrays of 64-bit hashes with log probabilities and back-off weights. An
n-gram and its contexts that predict after one character lie in one pack of bounded size; every
pack is broadcast in turn and adds the log-likelihood of the positions after its characters, so
the model may be larger than what a task holds.

Bands: per language, the median log-perplexity of the documents that pass the base rules, plus and
minus ``width`` times the normalised median absolute deviation, from histograms of steps 1/200. With
``good`` documents the lower and the upper width are calibrated for each language: so narrow that,
with some certainty, at most ``tail`` of such documents that pass the base rules lie beyond that side
(``edges``). A language with fewer than ``enough`` of them takes the widths of all together.

Defined results: null and empty texts have no words and fail the base rules; a null language is a
language of its own; where the other half of a language is empty there is no perplexity and the
base rules decide; bands are at least ``floor`` wide to either side; rows that repeat id and text get the same result each; a null id is kept; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import arrow_slices, materialize

ORDER = 5
START, END = 2, 3
# Entries of one broadcast pack of the model: 16 bytes each.
PACK_ENTRIES = 1_500_000
# Text that is scored at once.
SCORE_BYTES = 1_000_000
GRID = 200
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
_P = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- base rules

def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    text = text or ""
    # bytes.split knows ASCII white space only
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    windows = list(zip(words, words[1:], words[2:]))
    repeat = 0
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        upto = 0
        for i, x in enumerate(windows):
            if seen[x] > 1:
                repeat += i + 3 - max(i, upto)
                upto = i + 3
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat


# ---------------------------------------------------------------- counting

def padded(text: str | None) -> str:
    """The text with white space runs as one space, after start symbols and before the end symbol."""
    return "\x02" * (ORDER - 1) + " ".join((text or "").split()) + "\x03"


def codes_of(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4")


def count_grams(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """[(n-grams as rows of code points, counts)] of all windows that end with a character."""
    alphabet = np.flatnonzero(np.bincount(codes))
    if len(alphabet) ** ORDER >= 2 ** 63:
        # too many characters for one number per window: count two overlapping halves
        half = len(codes) // 2
        return count_grams(codes[:half + ORDER - 1]) + count_grams(codes[half:])
    dense = np.zeros(int(alphabet[-1]) + 1, np.int64)
    dense[alphabet] = np.arange(len(alphabet))
    c, a = dense[codes], len(alphabet)
    n = len(c) - ORDER + 1
    number = np.zeros(n, np.int64)
    for i in range(ORDER):
        number = number * a + c[i:i + n]
    number = number[codes[ORDER - 1:] != START]
    found, counts = np.unique(number, return_counts=True)
    grams = np.empty((len(found), ORDER), np.uint32)
    for i in range(ORDER - 1, -1, -1):
        grams[:, i] = alphabet[found % a]
        found = found // a
    return [(grams, counts)]


def strings_of(grams: np.ndarray) -> list[str]:
    s = np.ascontiguousarray(grams, "<u4").tobytes().decode("utf-32-le", "surrogatepass")
    k = grams.shape[1]
    return [s[i:i + k] for i in range(0, len(s), k)]


def by_language(langs: pa.Array, texts: pa.Array, most: int | None = None):
    """(language, row numbers, texts) of slices of a batch."""
    for a, b in arrow_slices(texts, most) if most else arrow_slices(texts):
        part = langs.slice(a, b - a).to_pylist()
        rows: dict[str, list[int]] = {}
        for i, lang in enumerate(part):
            rows.setdefault(lang, []).append(i)
        t = texts.slice(a, b - a).to_pylist()
        for lang, at in rows.items():
            yield lang, [a + i for i in at], [t[i] for i in at]


def model_key(half) -> Column:
    """The name of the model of a half of a language's documents."""
    return F.concat("lang", F.lit("\x1f"), half.cast("string")).alias("lang")


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, g, c): occurrences of every n-gram of the highest order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, _, texts in by_language(batch.column(0), batch.column(1)):
                # a window over the border of two documents ends with a start symbol or has one inside
                for grams, counts in count_grams(codes_of("".join(map(padded, texts)))):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(counts), pa.string()), pa.array(strings_of(grams)), pa.array(counts)],
                        names=["lang", "g", "c"])

    return docs.select(model_key(F.col("half")), "text").mapInArrow(run, "lang string, g string, c long") \
        .groupBy("lang", "g").agg(F.sum("c").alias("c"))


# ---------------------------------------------------------------- model

def discounts(levels: DataFrame) -> DataFrame:
    """(lang, k, d1, d2, d3) from the numbers of n-grams with count 1 to 4."""
    n = [F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    ok = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
    d = {f"d{i}": F.when(ok, F.greatest(F.lit(0.05), F.least(F.lit(float(i)), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"))))
         .otherwise(0.5 * i) for i in (1, 2, 3)}
    return levels.groupBy("lang", "k").agg(*n).select("lang", "k", *[v.alias(k) for k, v in d.items()])


def train(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, kind, k, g, value): log probabilities ('p') of n-grams of k characters and log
    back-off weights ('b') of contexts of k characters."""
    levels = materialize(counts.withColumn("k", F.lit(order)), f"kn-{order}")
    all_levels = levels
    for k in range(order - 1, 0, -1):
        # continuation counts: characters that stand before
        levels = materialize(levels.groupBy("lang", F.substring("g", 2, k).alias("g")).agg(
            F.count(F.lit(1)).alias("c")).withColumn("k", F.lit(k)), f"kn-{k}")
        all_levels = all_levels.unionByName(levels)
    symbols = levels.groupBy("lang").agg((F.count(F.lit(1)) + 1).alias("v"))
    rows = all_levels.join(discounts(all_levels), ["lang", "k"]).withColumn("h", F.expr("substring(g, 1, k - 1)"))
    rows = rows.withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
    ctx = rows.groupBy("lang", "k", "h").agg(F.sum("c").alias("s"), (F.sum("d") / F.sum("c")).alias("gamma"))
    rows = materialize(rows.select("lang", "k", "g", "h", (F.col("c") - F.col("d")).alias("left")).join(
        ctx, ["lang", "k", "h"]).select("lang", "k", "g", (F.col("left") / F.col("s")).alias("own"), "gamma"), "kn-terms")
    lower, out = None, None
    for k in range(1, order + 1):
        level = rows.filter(F.col("k") == k)
        if lower is None:
            p = level.join(symbols, "lang").select("lang", "g", (F.col("own") + F.col("gamma") / F.col("v")).alias("p"))
            out = symbols.select("lang", F.lit("u").alias("kind"), F.lit(0).alias("k"), F.lit("").alias("g"),
                                 (-F.ln("v")).alias("value"))
        else:
            low = lower.select("lang", F.col("g").alias("tail"), F.col("p").alias("q"))
            p = level.withColumn("tail", F.substring("g", 2, k - 1)).join(low, ["lang", "tail"]) \
                .select("lang", "g", (F.col("own") + F.col("gamma") * F.col("q")).alias("p"))
        lower = materialize(p, f"kn-p{k}")
        out = out.unionByName(lower.select("lang", F.lit("p").alias("kind"), F.lit(k).alias("k"), "g", F.ln("p").alias("value")))
    weights = ctx.select("lang", F.lit("b").alias("kind"), (F.col("k") - 1).alias("k"), F.col("h").alias("g"),
                         F.ln("gamma").alias("value"))
    return materialize(out.unionByName(weights), "kn-model")


def hashes(grams: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of code points."""
    h = np.zeros(len(grams), np.uint64)
    for i in range(grams.shape[1]):
        h = h * _P + grams[:, i]
    return scramble(h)


def scramble(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def hashed(model: DataFrame) -> DataFrame:
    """(lang, kind, k, h, value, after) of the model's entries: the hash stands for the n-gram, and
    ``after`` is the character that the entry predicts after (null: any)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, ks = batch.column(1).to_pylist(), batch.column(2).to_numpy()
            h, after = np.zeros(len(ks), np.uint64), np.full(len(ks), -1, np.int64)
            own = np.array([x == "p" for x in kinds], np.int64)
            for k in np.unique(ks):
                at = np.flatnonzero(ks == k)
                if k:
                    grams = codes_of("".join(batch.column(3).take(pa.array(at)).to_pylist())).reshape(len(at), k)
                    # of an n-gram the last but one, of a context the last character
                    place = k - 1 - own[at]
                    after[at] = np.where(place >= 0, grams[np.arange(len(at)), np.maximum(place, 0)].astype(np.int64), -1)
                else:
                    grams = np.zeros((len(at), 0), np.uint32)
                h[at] = hashes(grams)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(h.view(np.int64)), pa.array(batch.column(4).to_numpy().astype(np.float32)),
                 pa.array(after, mask=after < 0)], names=["lang", "kind", "k", "h", "value", "after"])

    return model.select("lang", "kind", "k", "g", "value").mapInArrow(
        run, "lang string, kind string, k int, h long, value float, after long")


class Pack:
    """Sorted hash arrays of a part of the model: for each language, kind and length the hashes
    and, in the same order, the values. ``after``: the characters it predicts after, by language
    (None: after all). ``others``: for the first pack of a language, the characters of its other
    packs; it also predicts after the characters that the model has never seen."""

    def __init__(self, after: dict[str, set[int] | None], others: dict[str, set[int]]):
        self.after = {k: None if v is None else np.array(sorted(others.get(k, v)), np.uint32) for k, v in after.items()}
        self.first = set(others)
        self.arrays: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, lang: str, rows: pa.Table) -> None:
        kinds, ks = rows["kind"].to_numpy(), rows["k"].to_numpy()
        h, value = rows["h"].to_numpy().view(np.uint64), rows["value"].to_numpy()
        for kind in ("p", "b", "u"):
            for k in range(ORDER + 1):
                at = np.flatnonzero((kinds == kind) & (ks == k))
                if len(at):
                    at = at[np.argsort(h[at])]
                    self.arrays[lang, kind, k] = h[at], value[at]

    def look(self, lang: str, kind: str, k: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value) of each hash."""
        keys, values = self.arrays.get((lang, kind, k), (None, None))
        if keys is None:
            return np.zeros(len(h), bool), np.zeros(len(h), np.float32)
        i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return keys[i] == h, values[i]

    def log_likelihoods(self, lang: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text, the summed log probability and the number of the positions of this pack."""
        strings = [padded(t) for t in texts]
        codes = codes_of("".join(strings))
        rolling = [codes.astype(np.uint64)]
        for _ in range(ORDER - 1):
            h = np.zeros(len(codes), np.uint64)
            h[1:] = rolling[-1][:-1] * _P + rolling[0][1:]
            rolling.append(h)
        use = codes != START
        if self.after[lang] is not None:
            use[1:] &= np.isin(codes[:-1], self.after[lang], invert=lang in self.first)
        at = np.flatnonzero(use)
        total = np.zeros(len(at), np.float64)
        open_ = np.arange(len(at))
        for k in range(ORDER, 0, -1):
            found, value = self.look(lang, "p", k, scramble(rolling[k - 1][at[open_]]))
            total[open_[found]] += value[found]
            open_ = open_[~found]
            if not len(open_):
                break
            before = scramble(rolling[k - 2][at[open_] - 1]) if k > 1 else scramble(np.zeros(len(open_), np.uint64))
            found, value = self.look(lang, "b", k - 1, before)
            total[open_[found]] += value[found]
        if len(open_):
            # a character that the language does not have
            total[open_] += self.look(lang, "u", 0, scramble(np.zeros(1, np.uint64)))[1][0]
        ends = np.cumsum([0, *map(len, strings)])
        upto = np.concatenate([[0.0], np.cumsum(total)])
        place = np.searchsorted(at, ends)
        return upto[place[1:]] - upto[place[:-1]], np.diff(place)


def packs(model: DataFrame, most: int = PACK_ENTRIES):
    """The model on the driver, one pack at a time. Small languages share a pack; the entries of a
    large one are dealt to several by the character that they predict after."""
    rows = materialize(hashed(model), "kn-hashed")
    # one row per language and character
    sizes: dict[str, list[tuple[int, int]]] = {}
    for r in rows.filter("after is not null").groupBy("lang", "after").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes.setdefault(r.lang, []).append((r.after, r.n))
    groups: list[dict[str, set[int] | None]] = [{}]
    room = most
    for lang in sorted(sizes):
        n = sum(x for _, x in sizes[lang])
        if n <= most:
            if n > room:
                groups.append({})
                room = most
            groups[-1][lang] = None
            room -= n
            continue
        for c, x in sorted(sizes[lang]):
            if x > room or groups[-1].get(lang, ()) is None:
                groups.append({})
                room = most
            groups[-1].setdefault(lang, set()).add(c)
            room -= x
    spark = model.sparkSession
    begun: set[str] = set()
    for group in filter(None, groups):
        starts = {x for x, v in group.items() if v is not None} - begun
        pack = Pack(group, {x: {c for c, _ in sizes[x]} - group[x] for x in starts})
        begun |= starts
        for lang, after in group.items():
            own = rows.filter(F.col("lang") == lang)
            if after is not None:
                chosen = F.broadcast(spark.createDataFrame([(c,) for c in sorted(after)], "after long"))
                own = own.join(chosen, "after", "left_semi").unionByName(own.filter("after is null"))
            pack.add(lang, own.select("kind", "k", "h", "value").toArrow())
        yield pack


# ---------------------------------------------------------------- verdicts

def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in arrow_slices(batch.column(3)):
            cols = list(zip(*map(base_counts, batch.column(3).slice(a, b - a).to_pylist())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).slice(a, b - a) for i in range(3)] + [pa.array(c, pa.int64()) for c in cols],
                names=["doc_id", "th", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


def log_perplexities(docs: DataFrame, model: DataFrame, most: int = PACK_ENTRIES) -> DataFrame:
    """(doc_id, th, lang, logppl): the mean negative log probability per character of distinct rows."""
    keyed = docs.select("doc_id", "th", "lang", model_key(1 - F.col("half")).alias("key"), "text")
    schema = "doc_id long, th long, lang string, ll double, chars long"
    parts, seen = None, set()
    for n, pack in enumerate(packs(model, most)):
        sent = docs.sparkSession.sparkContext.broadcast(pack)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lang, rows, texts in by_language(batch.column(3), batch.column(4), SCORE_BYTES):
                    ll, count = sent.value.log_likelihoods(lang, texts)
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(3)), pa.array(ll),
                                                      pa.array(count)], names=["doc_id", "th", "lang", "ll", "chars"])

        own = keyed.filter(F.col("key").isin(list(pack.after)))
        seen |= set(pack.after)
        part = own.mapInArrow(run, schema).withColumn("pack", F.lit(n))
        parts = part if parts is None else parts.unionByName(part)
    # documents whose other half is empty have no model
    none = keyed.filter(~F.col("key").isin(sorted(seen))).select(
        "doc_id", "th", "lang", F.lit(None).cast("double").alias("ll"), F.lit(1).cast("long").alias("chars"), F.lit(-1).alias("pack"))
    parts = none if parts is None else parts.unionByName(none)
    # rows that repeat id and text have the same likelihood in a pack
    once = parts.groupBy("doc_id", "th", "lang", "pack").agg(F.max("ll").alias("ll"), F.max("chars").alias("chars"))
    return once.groupBy("doc_id", "th", "lang").agg((-F.sum("ll") / F.sum("chars")).alias("logppl"))


def word_grams(docs: DataFrame) -> DataFrame:
    """(th, lang, half, w1, w2, w3): hashes of the words of every window, after two start marks
    and up to the end mark; one row per word and end."""
    words = F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda x: x != "")
    marks = [F.array(*[F.lit(m).cast("long")] * n) for m, n in ((START, 2), (END, 1))]
    hashed_words = F.concat(marks[0], F.transform(words, lambda x: F.xxhash64(x)), marks[1])
    rows = docs.select("th", "lang", "half", hashed_words.alias("a"))
    windows = F.transform(F.sequence(F.lit(2), F.size("a") - 1), lambda i: F.struct(
        *[F.get(F.col("a"), i - (3 - n)).alias(f"w{n}") for n in (1, 2, 3)]))
    return rows.select("th", "lang", "half", F.explode(windows).alias("g")).select("th", "lang", "half", "g.*")


def gram_name() -> Column:
    return F.xxhash64("lang", "w1", "w2", "w3").alias("g")


def word_model(docs: DataFrame) -> DataFrame:
    """(g, l0, l1): for every n-gram of the documents its log probability by the models of either
    half of its language, null where that half is empty."""
    w = ["w1", "w2", "w3"]
    level = materialize(word_grams(docs).groupBy("lang", *w).agg(
        *[F.count(F.when(F.col("half") == h, 1)).alias(f"c{h}") for h in (0, 1)]), "kn-words-3")
    levels = {3: level}
    for k in (2, 1):
        # continuation counts: words that stand before
        levels[k] = materialize(levels[k + 1].groupBy("lang", *w[3 - k:]).agg(
            *[F.count(F.when(F.col(f"c{h}") > 0, 1)).alias(f"c{h}") for h in (0, 1)]), f"kn-words-{k}")
    counts = None
    for k, rows in levels.items():
        for h in (0, 1):
            part = rows.filter(F.col(f"c{h}") > 0).select(model_key(F.lit(h)), F.lit(k).alias("k"), F.col(f"c{h}").alias("c"))
            counts = part if counts is None else counts.unionByName(part)
    d = discounts(counts)
    for_half = [d.select(F.col("lang").alias("key"), "k", *[F.col(f"d{i}").alias(f"d{i}_{h}") for i in (1, 2, 3)]) for h in (0, 1)]
    d = materialize(levels[1].select("lang").distinct().crossJoin(docs.sparkSession.range(1, 4).select(F.col("id").cast("int").alias("k")))
                    .join(for_half[0].withColumnRenamed("k", "k_0"), (F.col("key") == model_key(F.lit(0))) & (F.col("k") == F.col("k_0")), "left").drop("key", "k_0")
                    .join(for_half[1].withColumnRenamed("k", "k_1"), (F.col("key") == model_key(F.lit(1))) & (F.col("k") == F.col("k_1")), "left").drop("key", "k_1"), "kn-words-d")
    low = levels[1].groupBy("lang").agg(*[(1 / (F.count(F.when(F.col(f"c{h}") > 0, 1)) + 1)).alias(f"q{h}") for h in (0, 1)])
    for k in (1, 2, 3):
        own = ["lang", *w[3 - k:]]
        # one row per language and level, so it is sent along
        rows = levels[k].join(F.broadcast(d.filter(F.col("k") == k).drop("k")), "lang")
        for h in (0, 1):
            c = F.col(f"c{h}")
            rows = rows.withColumn(f"d_{h}", F.when(c == 0, 0.0).when(c == 1, F.col(f"d1_{h}")).when(c == 2, F.col(f"d2_{h}")).otherwise(F.col(f"d3_{h}")))
        rows = rows.select(*own, "c0", "c1", "d_0", "d_1")
        # written, so that the joins below are between plain inputs and Spark can split a hot word
        ctx = materialize(rows.groupBy(*own[:-1]).agg(
            *[F.sum(f"c{h}").alias(f"s{h}") for h in (0, 1)],
            *[(F.sum(f"d_{h}") / F.nullif(F.sum(f"c{h}"), F.lit(0))).alias(f"b{h}") for h in (0, 1)]), f"kn-words-ctx{k}")
        rows = rows.join(low, ["lang", *w[4 - k:]]).join(ctx, own[:-1])
        # a context that the half does not have leaves the lower order
        p = [F.when(F.col(f"s{h}") > 0, (F.col(f"c{h}") - F.col(f"d_{h}")) / F.col(f"s{h}") + F.col(f"b{h}") * F.col(f"q{h}"))
             .otherwise(F.col(f"q{h}")) for h in (0, 1)]
        if k < 3:
            low = materialize(rows.select(*own, *[p[h].alias(f"q{h}") for h in (0, 1)]), f"kn-words-p{k}")
    there = levels[1].groupBy("lang").agg(*[(F.sum(f"c{h}") > 0).alias(f"any{h}") for h in (0, 1)])
    return materialize(rows.join(F.broadcast(there), "lang").select(
        gram_name(), *[F.when(F.col(f"any{h}"), F.ln(p[h])).alias(f"l{h}") for h in (0, 1)]), "kn-words-model")


def word_log_perplexities(docs: DataFrame) -> DataFrame:
    """(th, lang, logppl): the mean negative log probability per word of distinct texts."""
    grams = word_grams(docs).select("th", "lang", "half", gram_name())
    ll = F.when(F.col("half") == 0, F.col("l1")).otherwise(F.col("l0"))
    # repeats of a text add to the sum and to the number alike
    return grams.join(word_model(docs), "g").groupBy("th", "lang").agg((-F.avg(ll)).alias("logppl"))


def histogram_median(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Per language, the lower median of ``value`` on a grid; the histogram is what is sorted."""
    bins = rows.groupBy("lang", F.floor(F.col(value) * GRID).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    cum = bins.selectExpr("lang", "bin", "sum(n) over (partition by lang order by bin) as upto",
                          "sum(n) over (partition by lang) as total")
    return cum.filter("2 * upto >= total").groupBy("lang").agg(((F.min("bin") + 0.5) / GRID).alias(out))


def edges(rows: DataFrame, tail: float, most: float = 20.0) -> DataFrame:
    """Per language, ``n`` rows and the deviations (``below``, ``above`` the median) beyond which, with
    some certainty, at most ``tail`` of such rows lie: on either side so many of the given ones lie
    beyond as are two standard deviations less than ``tail`` of them. On a grid of 2 * ``most`` * GRID
    bins a language, which are what is sorted."""
    z = F.greatest(F.lit(-most), F.least(F.lit(most), F.col("z")))
    bins = rows.groupBy("lang", F.floor(z * GRID).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    c = bins.selectExpr("lang", "bin", "sum(n) over (partition by lang order by bin) as up",
                        "sum(n) over (partition by lang order by bin desc) as down", "sum(n) over (partition by lang) as total")
    few = F.greatest(F.lit(0.0), F.floor(tail * F.col("total") - 2 * F.sqrt(tail * F.col("total"))))
    return c.groupBy("lang").agg(F.max("total").alias("n"), (-F.min(F.when(F.col("up") > few, F.col("bin"))) / GRID).alias("below"),
                                 ((F.max(F.when(F.col("down") > few, F.col("bin"))) + 1) / GRID).alias("above"))


def quality_rules(docs: DataFrame, width: float = 6.0, floor: float = 0.05, doc_col: str = "doc_id",
                  text_col: str = "text", lang_col: str = "lang", pack_entries: int = PACK_ENTRIES,
                  unit: str = "character", good: DataFrame | None = None, tail: float = 0.02, enough: int = 50) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, perplexity, lower, upper. ``good``: the ids (doc_id) of documents known to be
    good; where some of them pass the base rules, they set the width of either side, in languages
    with ``enough`` of them by themselves, in the others all together."""
    src = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("th"),
                      F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")) \
        .withColumn("half", F.pmod("th", F.lit(2)))
    base = src.select("doc_id", "th", "lang", "text").mapInArrow(_measure, "doc_id long, th long, lang string, n_words long, word_chars long, n_symbols long, "
                                    "n_dup_lines long, n_repeat_words long") \
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    if unit == "word":
        p = word_log_perplexities(src).withColumnsRenamed({"th": "t", "lang": "l"}).withColumn("i", F.lit(None))
        same = (base.th == p.t) & (base.lang == p.l)
    else:
        ppl = log_perplexities(src, train(gram_counts(src)), pack_entries)
        p = ppl.withColumnsRenamed({"doc_id": "i", "th": "t", "lang": "l"})
        same = base.doc_id.eqNullSafe(p.i) & (base.th == p.t) & (base.lang == p.l)
    rows = materialize(base.join(p, same).drop("i", "t", "l"), "kn-scored")
    passed = rows.filter(~F.col("base_failed") & F.col("logppl").isNotNull())
    middle = histogram_median(passed, "logppl", "mid")
    spread = histogram_median(passed.join(middle, "lang").withColumn("dev", F.abs(F.col("logppl") - F.col("mid"))), "dev", "mad")
    scale = materialize(middle.join(spread, "lang").select("lang", "mid", (1.4826 * F.col("mad")).alias("dev")), "kn-scale")
    if good is None:
        sides = scale.select("lang", "mid", "dev", F.lit(width).alias("below"), F.lit(width).alias("above"))
    else:
        known = materialize(passed.join(good.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
                            .join(scale, "lang").select("lang", ((F.col("logppl") - F.col("mid")) / F.nullif("dev", F.lit(0.0))).alias("z"))
                            .filter("z is not null"), "kn-known")
        every = edges(known.withColumn("lang", F.lit("")), tail).first()
        own = edges(known, tail).filter(F.col("n") >= enough).drop("n")
        sides = scale.join(own, "lang", "left").select(
            "lang", "mid", "dev", F.coalesce("below", F.lit(every.below if every else width)).alias("below"),
            F.coalesce("above", F.lit(every.above if every else width)).alias("above"))
    reach = [F.greatest(F.lit(float(floor)), F.col(x) * F.col("dev")) for x in ("below", "above")]
    bands = sides.select("lang", (F.col("mid") - reach[0]).alias("lo"), (F.col("mid") + reach[1]).alias("hi"))
    return rows.join(bands, "lang", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("logppl").between(F.col("lo"), F.col("hi")), F.lit(True))).alias("kept"),
        F.exp("logppl").alias("perplexity"), F.exp("lo").alias("lower"), F.exp("hi").alias("upper"))
