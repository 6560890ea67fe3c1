"""Operator 12: periodic runs of words by an online search along sparse diagonals.

A diagonal is a lag p; its match length at word i counts the words up to i that equal the word p
before them. Reading the words in order, an earlier occurrence of the word at hand opens its lag,
every next word lengthens the open lags or ends them, and a lag that ends with a match of at least
``min_exponent - 1`` periods (and ``min_length`` words in all) is a run, emitted there and then.

Not every earlier occurrence has to open a lag, which keeps the diagonals sparse on long texts and
frequent words, without losing a run:
- lags go in classes from L to 2 L - 1; a run of such a lag matches over at least 3 L words in a
  row, so looking back from every (3 L)th word meets each run, and its match is followed back to
  where it began;
- of the words a lag still needs at least half lie together on one side of the word, so a lag that
  matches over less on both sides does not open;
- where a known run of a shorter period q holds the word, the one p before it and q - 1 more words
  on either side, lag p can only be that run again, and does not open.
A class looks at no more than a third as many pairs as there are words, whatever the word counts.

Periods found are smallest periods: a run whose smallest period is q also ends on the lags that q
divides, with the same first and last word, but those lags come later and are then known.

Defined results: a null or empty text has no words, no runs and an empty collapsed text; a null
``doc_id`` is kept; repeated rows are judged each by itself; an empty table gives no rows; columns
of ``docs`` other than the two named ones are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import arrow_slices
from quarry.llm.words import Words

RUN = "struct<start: bigint, length: bigint, period: bigint>"
SCHEMA = f"doc_id long, n_words long, runs array<{RUN}>, collapsed string"

# Pairs of words compared at a time, which bounds the memory of one step.
PAIRS = 1_000_000


class Search:
    """Runs of all rows of a slice. Positions are numbered over the whole slice; ``lo`` and ``hi``
    of a position are the first word of its row and the first of the next one."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, min_exponent: int, min_length: int):
        self.ids, self.rows = ids, rows
        self.min_exponent, self.min_length = min_exponent, min_length
        n = np.diff(rows)
        self.lo, self.hi = np.repeat(rows[:-1], n), np.repeat(rows[1:], n)
        self.words = memoryview(np.ascontiguousarray(ids))
        # the run known around each word: none yet
        self.run_from = np.arange(1, len(ids) + 1)
        self.run_to = np.full(len(ids), -1, np.int64)
        self.run_period = np.ones(len(ids), np.int64)
        self.found: dict[tuple[int, int], int] = {}         # (start, length): period
        self.occurrences = self.order = None

    def least(self, lag: int) -> int:
        """Words that a run of period ``lag`` has at least."""
        return max(self.min_length, self.min_exponent * lag)

    def match(self, low: int, high: int) -> int:
        """Words in a row that match at least, in a run of any period from ``low`` to ``high``."""
        turn = self.min_length // self.min_exponent         # up to here min_length decides
        return min(self.least(p) - p for p in {low, high, *(x for x in (turn, turn + 1) if low <= x <= high)})

    def all(self) -> list[tuple[int, int, int]]:
        longest = int(np.diff(self.rows).max(initial=0))
        low = 1
        while self.least(low) <= longest:
            for at, lags in self.openings(low):
                self.follow(at, lags)
            low *= 2
        return sorted((s, n, p) for (s, n), p in self.found.items())

    def openings(self, low: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, lag) pairs in word order at which the lags from ``low`` to 2 ``low`` - 1 open."""
        stride = self.match(low, 2 * low - 1)
        at = np.arange(stride - 1, len(self.ids), stride)
        lo, hi = self.lo[at], self.hi[at]
        short = self.run_period[at] - 1
        known = (self.run_from[at] + short <= at - 2 * low + 1) & (self.run_to[at] - short >= at)
        at = at[(at - low >= lo) & (hi - lo >= self.least(low)) & ~known]
        if low < 8:
            here = np.repeat(at, low)
            lags = np.tile(np.arange(low, 2 * low), len(at))
            fits = (here - lags >= self.lo[here])
            here, lags = here[fits], lags[fits]
            same = self.ids[here] == self.ids[here - lags]
            yield self.long_enough(here[same], lags[same])
            return
        if self.occurrences is None:
            # earlier occurrences of a word: neighbours in the order by (word, position)
            self.order = np.argsort(self.ids, kind="stable")
            self.occurrences = self.ids[self.order].astype(np.int64) * len(self.ids) + self.order
        base = self.ids[at].astype(np.int64) * len(self.ids)
        first = np.searchsorted(self.occurrences, base + np.maximum(at - 2 * low + 1, self.lo[at]))
        last = np.searchsorted(self.occurrences, base + at - low, side="right")
        many = last - first
        upto = np.cumsum(many)
        a = 0
        while a < len(at):
            done = upto[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(upto, done + PAIRS, side="right")))
            n = many[a:b]
            here = np.repeat(at[a:b], n)
            inside = np.arange(len(here)) - np.repeat(np.cumsum(n) - n, n)
            # from the latest occurrence back
            lags = here - self.order[np.repeat(last[a:b], n) - 1 - inside]
            yield self.long_enough(here, lags)
            a = b

    def long_enough(self, at: np.ndarray, lags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without the pairs whose match cannot become long enough: the row is too short for the
        lag, a known run of a shorter period explains the match, or neither the words behind nor
        those before match over half of what the lag needs beside the word itself."""
        least = np.maximum(self.min_exponent * lags, self.min_length)
        short = self.run_period[at] - 1
        known = (self.run_from[at] + short <= at - lags) & (self.run_to[at] - short >= at)
        fits = (least <= self.hi[at] - self.lo[at]) & ~known
        at, lags, half = at[fits], lags[fits], ((least - lags) // 2)[fits]
        ids, good = self.ids, np.zeros(len(at), bool)
        for step, bound in ((1, self.hi[at]), (-1, self.lo[at] + lags)):
            left = np.flatnonzero(~good)
            k = 0
            while len(left):
                k += 1
                i = at[left] + step * k
                inside = i < bound[left] if step > 0 else i >= bound[left]
                left, i = left[inside], i[inside]
                left = left[ids[i] == ids[i - lags[left]]]
                done = half[left] <= k
                good[left[done]] = True
                left = left[~done]
        return at[good], lags[good]

    def follow(self, at: np.ndarray, lags: np.ndarray) -> None:
        """Read on from the openings: lengthen the open lags word by word, emit what ends."""
        words, least = self.words, self.least
        opened = list(zip(at.tolist(), lags.tolist()))
        active: dict[int, int] = {}         # lag -> match length up to the word before i
        new: list[tuple[int, int, int]] = []
        e, i, end = 0, 0, 0

        def close(lag: int, i: int) -> None:
            n = active.pop(lag) + lag
            if n >= least(lag) and (i - n, n) not in self.found:
                self.found[i - n, n] = lag
                new.append((i - n, n, lag))

        while e < len(opened) or active:
            if not active:
                i = opened[e][0]
                end = int(self.hi[i])
            for lag in [lag for lag in active if i == end or words[i] != words[i - lag]]:
                close(lag, i)
            for lag in active:
                active[lag] += 1
            while e < len(opened) and opened[e][0] == i and i < end:
                lag = opened[e][1]
                e += 1
                # lag i - j is a multiple of an open one that holds back to there: the same run
                if lag not in active and not any(lag % q == 0 and m >= lag for q, m in active.items()):
                    low, j = int(self.lo[i]) + lag, i
                    while j > low and words[j - 1] == words[j - 1 - lag]:
                        j -= 1
                    active[lag] = i - j + 1
            i += 1
        for start, n, period in new:
            self.run_from[start:start + n] = start
            self.run_to[start:start + n] = start + n - 1
            self.run_period[start:start + n] = period


def _search(min_exponent: int, min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, column = batch.column(0), batch.column(1)
            for a, b in arrow_slices(column):
                words = Words(column.slice(a, b - a))
                rows = words.rows
                runs = Search(words.ids, rows, min_exponent, min_length).all()
                keep = np.ones(len(words.ids), bool)
                for start, n, period in runs:
                    keep[start + period:start + n] = False
                table = np.array(runs, np.int64).reshape(-1, 3)
                ends = np.searchsorted(table[:, 0], rows).astype(np.int32)
                first = rows[np.searchsorted(rows, table[:, 0], side="right") - 1]
                structs = pa.StructArray.from_arrays([pa.array(table[:, 0] - first), pa.array(table[:, 1]), pa.array(table[:, 2])],
                                                     names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [names.slice(a, b - a), pa.array(np.diff(rows)), pa.ListArray.from_arrays(pa.array(ends), structs),
                     words.joined(keep).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])
    return run


def periodic_runs(docs: DataFrame, min_exponent: int = 4, min_length: int = 6, doc_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs and collapsed of every row.

    ``runs``: the maximal stretches of at least ``min_length`` words and ``min_exponent`` (4 or
    more) periods, as start, length and smallest period, by start, then period. ``collapsed``: the
    words that no run contains behind its first period, joined by one space.
    """
    if min_exponent < 4 or min_length < min_exponent:
        raise ValueError("min_exponent has to be 4 or more and min_length no less than it")
    src = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_search(min_exponent, min_length), SCHEMA)


def strongest(runs: str | Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equals the first."""
    runs = F.col(runs) if isinstance(runs, str) else runs
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.try_element_at(runs, F.lit(1)),
                       lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
