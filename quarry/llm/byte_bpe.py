"""Byte-level BPE of whole columns: every distinct stretch of text of a slice is looked up once.

The pre-tokenizer of the byte-level vocabularies cuts a text at white space: a run of white space
keeps its last space for the word behind it. So a text may be cut, without changing its ids,
- before a space or line feed that follows a character that is no white space,
- before a space that a character other than white space follows, and
- behind a line feed that stands alone between two such characters.
The stretches between those places are found in the bytes of a whole Arrow slice, made distinct by
Arrow's dictionary encoding, and their ids, remembered per worker, are gathered by one index.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Encodings remembered per Python worker and generation, of which the last two are kept; longer
# stretches are not remembered.
CACHE_ENTRIES = 500_000
CACHE_BYTES = 64


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the places where its rows begin and end in them
    (one more than rows); null is an empty text."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, places, data = texts.buffers()
    if len(texts) == 0 or places is None or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def byte_strings(raw: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The stretches of ``raw`` that begin at ``starts``, without a copy of the bytes."""
    wide = len(raw) >= 2 ** 31
    at = np.append(starts, len(raw)).astype(np.int64 if wide else np.int32)
    return pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(starts),
                                 [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(raw))])


def cut_places(raw: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where the stretches of the rows begin."""
    solid = raw > 0x20                      # surely no white space
    # white space beyond ASCII begins with one of these bytes; its neighbours are left uncut
    lead = np.flatnonzero((raw == 0xC2) | ((raw >= 0xE1) & (raw <= 0xE3)))
    for k in range(3):
        solid[np.minimum(lead + k, len(raw) - 1)] = False
    space, feed = raw == 0x20, raw == 0x0A
    begins, ends = rows[:-1], rows[1:]
    some = ends > begins
    cut = np.zeros(len(raw), bool)
    cut[1:] = (space[1:] | feed[1:]) & solid[:-1]
    before_solid = np.zeros(len(raw), bool)
    before_solid[:-1] = space[:-1] & solid[1:]
    before_solid[ends[some] - 1] = False    # the byte behind it belongs to the next row
    cut |= before_solid
    if len(raw) > 2:
        cut[2:] |= solid[2:] & feed[1:-1] & solid[:-2]
    cut[begins[some]] = True
    return np.flatnonzero(cut)


class BatchEncoder:
    """Ids of whole rows by the tokenizers library, each distinct stretch once."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        # strings of special tokens inside a document are ordinary text
        self.tokenizer.encode_special_tokens = True
        vocab = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocab.values()) + 1, bool)
        self.spaced[[i for t, i in vocab.items() if t[:1] == "Ġ"]] = True   # byte-level form of a space
        self.entries = entries
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _learn(self, keys: list[bytes]) -> None:
        known = self.known
        one, rest = [], []
        for k in keys:
            (one if k[:1] == b" " and k[1:].split() == [k[1:]] else rest).append(k)
        for a in range(0, len(one), 1000):
            # each begins with the only space in it, so with the only token that has one
            part = one[a:a + 1000]
            text = b"".join(part).decode("utf-8", "replace")
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.spaced[ids]).tolist()
            data = ids.tobytes()
            for k, i, j in zip(part, at, [*at[1:], len(ids)], strict=True):
                known[k] = data[4 * i:4 * j]
        for a in range(0, len(rest), 1000):
            part = rest[a:a + 1000]
            done = self.tokenizer.encode_batch_fast([k.decode("utf-8", "replace") for k in part], add_special_tokens=False)
            for k, e in zip(part, done):
                known[k] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column in order, and where each row's begin and end (one more than
        rows). A null text has none."""
        raw, rows = text_bytes(texts)
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(rows), np.int64)
        starts = cut_places(raw, rows)
        coded = byte_strings(raw, starts).dictionary_encode()
        which, keys = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        if len(self.known) > self.entries:
            self.old, self.known = self.known, {}
        new = [k for k in keys if k not in self.known]
        if self.old:
            kept = [k for k in new if k in self.old]
            self.known.update(zip(kept, map(self.old.__getitem__, kept)))
            new = [k for k in new if k not in self.old]
        self._learn(new)
        found = list(map(self.known.__getitem__, keys))
        for k in new:
            if len(k) > CACHE_BYTES:
                del self.known[k]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<i4")
        first = np.cumsum(sizes) - sizes
        per = sizes[which]
        upto = np.concatenate([[0], np.cumsum(per)])
        ids = flat[np.arange(upto[-1]) + np.repeat(first[which] - upto[:-1], per)]
        return ids, upto[np.searchsorted(starts, rows)]


_ENCODERS: dict[str, BatchEncoder] = {}


def batch_encoder(path: str) -> BatchEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = BatchEncoder(path)
    return _ENCODERS[path]
