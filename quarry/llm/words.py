"""Words of whole columns: runs of bytes that are no ASCII white space."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quarry.llm.byte_bpe import byte_strings, text_bytes


class Words:
    """The words of the rows of one slice: ``ids`` (equal words have equal ids, places in
    ``vocabulary``), ``rows`` (where the words of each row begin and end), their bytes, and where
    they stand in the slice's bytes (``places``, ``raw``, ``raw_rows``). ``lower``: A-Z lower-cased."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        raw, at = text_bytes(texts)
        if lower:
            raw = np.where((raw >= 0x41) & (raw <= 0x5A), raw | 0x20, raw)
        self.raw, self.raw_rows = raw, at
        solid = ~((raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D)))
        begin = solid.copy()
        if len(raw):
            new_row = np.zeros(len(raw) + 1, bool)
            new_row[at] = True
            begin[1:] &= ~solid[:-1] | new_row[1:-1]
        self.places = places = np.flatnonzero(begin)
        self.rows = np.searchsorted(places, at)
        self.bytes = raw[solid]
        starts = (np.cumsum(solid) - 1)[places] if len(places) else np.zeros(0, np.int64)
        self.sizes = np.diff(np.append(starts, len(self.bytes)))
        coded = byte_strings(self.bytes, starts).dictionary_encode()
        self.ids, self.vocabulary = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary

    def joined(self, keep: np.ndarray) -> pa.Array:
        """The kept words of each row, joined by one space."""
        row = np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))[keep]
        sizes = self.sizes[keep]
        per_row = np.bincount(row, minlength=len(self.rows) - 1)
        rows_before = np.cumsum(per_row > 0) - (per_row > 0)
        spaces = np.arange(len(row)) - rows_before[row]
        out = np.full(int(sizes.sum() + np.maximum(per_row - 1, 0).sum()), 0x20, np.uint8)
        out[np.arange(int(sizes.sum())) + np.repeat(spaces, sizes)] = self.bytes[np.repeat(keep, self.sizes)]
        bytes_per_row = np.bincount(row, weights=sizes, minlength=len(self.rows) - 1).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(bytes_per_row + np.maximum(per_row - 1, 0))]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(out)])
