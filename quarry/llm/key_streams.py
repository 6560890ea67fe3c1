"""Which keys of many blocks come up often, from sorted streams of short keys.

Every block sends its distinct keys with their counts, sorted and as differences, one row per key
range; a range merges what it gets and returns to each block those of its keys whose sum over all
blocks reaches a minimum. A key has only as many bits as the number of things in the table asks
for, so that by chance few share one; a stream then takes some three bytes a key. What has a key
that comes back still has to be told apart by itself: keys only choose.

A range holds a share of the keys that the caller bounds by their number; a key that a third of all
things have is one entry in each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Values of a key for each thing in the table.
SPARE = 256
# Keys that a range merges at a time, about.
MERGED = 500_000


def key_bits(things: int) -> int:
    """Bits of a key for so many things."""
    return min(64, max(1, int(SPARE * things).bit_length()))


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Unsigned numbers as planes of their low bytes, as many as the largest needs, after that number."""
    wide = np.ascontiguousarray(numbers, "<u8")
    width = max(1, -(-int(wide.max(initial=0)).bit_length() // 8))
    return bytes([width]) + wide.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack_numbers(data: bytes) -> np.ndarray:
    width = data[0]
    out = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1).T
    return out.view("<u8").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Rising keys as the first one and the differences, which are far smaller."""
    return np.ascontiguousarray(keys[:1], "<u8").tobytes() + pack_numbers(np.diff(keys)) if len(keys) else b""


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(data, "<u8", 1), unpack_numbers(data[8:])]), dtype=np.uint64)


def runs_of(keys: np.ndarray) -> np.ndarray:
    """Where the stretches of equal keys begin in sorted keys."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _send(keys_of: Callable, ranges: int, bits: int):
    edges = np.array([(r << bits) // ranges for r in range(1, ranges)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, keys in keys_of(batches):
            keys = np.sort(keys)
            first = runs_of(keys)
            counts = np.diff(np.append(first, len(keys)))
            keys = keys[first]
            at = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
            some = [r for r in range(ranges) if at[r] < at[r + 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array([block] * len(some), pa.int64()),
                 pa.array([pack_sorted(keys[at[r]:at[r + 1]]) for r in some], pa.binary()),
                 pa.array([pack_numbers(counts[at[r]:at[r + 1]]) for r in some], pa.binary())],
                names=["range", "block", "keys", "counts"])
    return run


def _merge_range(least: int):
    def merge(rows: pa.Table) -> pa.Table:
        streams = [unpack_sorted(k.as_buffer().to_pybytes()) for k in rows["keys"]]
        counts = [unpack_numbers(c.as_buffer().to_pybytes()) for c in rows["counts"]]
        counts = [c.astype(np.min_scalar_type(int(c.max(initial=0)))) for c in counts]
        # in stretches of the range, so that only the streams themselves are held whole
        low = min((int(s[0]) for s in streams if len(s)), default=0)
        high = max((int(s[-1]) for s in streams if len(s)), default=0)
        pieces = max(1, -(-sum(map(len, streams)) // MERGED))
        edges = np.array([low + (high - low) * i // pieces for i in range(1, pieces)], np.uint64)
        cuts = [[0, *np.searchsorted(s, edges).tolist(), len(s)] for s in streams]
        back: list[list[np.ndarray]] = [[] for _ in streams]
        for i in range(pieces):
            keys = np.concatenate([s[c[i]:c[i + 1]] for s, c in zip(streams, cuts)])
            if not len(keys):
                continue
            n = np.concatenate([x[c[i]:c[i + 1]] for x, c in zip(counts, cuts)]).astype(np.int64)
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = runs_of(keys)
            chosen = keys[first][np.add.reduceat(n[order], first) >= least]
            for s, c, out in zip(streams, cuts, back):
                part = s[c[i]:c[i + 1]]
                out.append(part[has(chosen, part)[0]])
        some = [i for i, parts in enumerate(back) if any(map(len, parts))]
        return pa.table({"block": rows["block"].to_numpy()[some],
                         "keys": pa.array([pack_sorted(np.concatenate(back[i])) for i in some], pa.binary())})
    return merge


def has(chosen: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are among the sorted chosen ones, and where those stand there."""
    if not len(chosen):
        return np.zeros(len(keys), bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(chosen, keys), len(chosen) - 1)
    found = chosen[at] == keys
    return found, at[found]


def repeated_keys(blocks: DataFrame, keys_of: Callable, bits: int, ranges: int, least: int) -> DataFrame:
    """(block, keys): of each block and key range, the keys (packed) that occur ``least`` times or
    more over all blocks. ``keys_of`` gives (block, its keys of ``bits`` bits) for Arrow batches of
    ``blocks``."""
    sent = blocks.mapInArrow(_send(keys_of, ranges, bits), "range int, block long, keys binary, counts binary")
    return sent.groupBy("range").applyInArrow(_merge_range(least), "block long, keys binary")
