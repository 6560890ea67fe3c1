"""Operator 9: SentencePiece encoding and decoding by a streaming Viterbi search.

``Lattice`` reads characters, keeps for every boundary the best piece that ends there (its
backpointer), and looks back over at most the longest piece. When all backpointer paths that can
still grow meet in one boundary, the ids before it are committed and forgotten, so a text of any
length is encoded in a window.

Two kinds of model. *Unigram*: a boundary's best piece has the highest summed score. *BPE*: the
sum of scores does not give the model's ids (its scores are merge ranks), so a path is valid only
if every two neighbouring pieces come out of the merges as they are; each boundary then has
exactly one valid last piece, and the same search finds it. Both use byte pieces for unknown
characters.

No piece continues across the start of a run of spaces, so all paths meet there. The stretch
between two such places is remembered with its ids; texts are mostly repeated words.

Defined results: null and empty texts have no ids; the space mark U+2581 in a text decodes as a
space, as the model's format has it; ids outside the vocabulary and control pieces decode to
nothing; invalid byte sequences decode to U+FFFD; rows with the same id are encoded each; other
columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import arrow_slices

MARK = "▁"
# Stretches remembered per Python worker and generation (the last two are kept), the longest that
# is remembered, and piece pairs.
CACHE_ENTRIES, CACHE_CHARS, PAIR_ENTRIES = 250_000, 64, 300_000
_RUNS = re.compile(MARK + "+[^" + MARK + "]*|[^" + MARK + "]+")


# Stands before the first piece of a text.
START_ID = -1


class Pieces:
    """The vocabulary of a model: normal pieces with scores, byte pieces, and the kind of model."""

    def __init__(self, scores: dict[str, tuple[int, float]], byte_ids: list[int], bpe: bool,
                 dummy_prefix: bool = True, unknown: int = 0):
        self.scores, self.byte_ids, self.bpe = scores, byte_ids, bpe
        self.dummy_prefix, self.unknown = dummy_prefix, unknown
        self.split: dict[str, tuple[str, str] | None] = {}
        self.longest = max(map(len, scores), default=1)
        self.lowest = min((s for _, s in scores.values()), default=0.0)
        self.names = {i: p for p, (i, _) in scores.items()}
        # a pair of characters that is inside no piece parts every text
        self.inside = {p[i:i + 2] for p in scores for i in range(len(p) - 1)}
        self.automaton = ahocorasick.Automaton()
        for p, (i, score) in scores.items():
            self.automaton.add_word(p, (len(p), i, score))
        self.automaton.make_automaton()
        crossing = [p for p in scores if MARK in p.lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces continue over a space: {crossing[:3]}")

    @classmethod
    def load(cls, path: str) -> tuple[Pieces, list[bytes]]:
        """The vocabulary of a model file, and the bytes that each id decodes to."""
        from sentencepiece import sentencepiece_model_pb2 as pb
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kind = model.normalizer_spec, model.trainer_spec.model_type
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or kind not in (1, 2):
            raise ValueError("only unigram and BPE models without text normalisation are handled")
        kinds = pb.ModelProto.SentencePiece
        scores, table, byte_ids, unknown = {}, [], [0] * 256, 0
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                byte_ids[int(p.piece[3:5], 16)] = i
                table.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type in (kinds.NORMAL, kinds.USER_DEFINED):
                scores[p.piece] = (i, p.score)
                table.append(p.piece.replace(MARK, " ").encode())
            else:
                unknown = i if p.type == kinds.UNKNOWN else unknown
                table.append(b"")
        return cls(scores, byte_ids if any(byte_ids) else [], kind == 2, norm.add_dummy_prefix, unknown), table

    def name(self, number: int) -> str:
        """A piece by its id; ids below START_ID stand for characters that are no piece."""
        return "" if number == START_ID else self.names[number] if number >= 0 else chr(START_ID - 1 - number)

    def ids_of(self, number: int) -> list[int]:
        if number >= 0:
            return [number]
        return [self.byte_ids[b] for b in self.name(number).encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The pieces that the merges of a BPE model make of a short text (the adjacent pair with
        the best score first, the leftmost of equals), and the pair merged last."""
        parts, last = list(text), None
        while len(parts) > 1:
            best = None
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s[1] > best[0]):
                    best = (s[1], i)
            if best is None:
                break
            i = best[1]
            last = parts[i], parts[i + 1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts, last

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge makes ``piece``; None if no merges lead to it."""
        if piece not in self.split:
            parts, last = self.merged(piece)
            self.split[piece] = last if len(parts) == 1 else None
        return self.split[piece]

    def fits(self, left: str, right: str) -> bool:
        """Whether the merges leave two neighbouring pieces as they are: no merge across their
        border is due before the merges that made them. Their merges are undone, latest first,
        and each pair that then meets at the border is looked at."""
        if len(right) > 1 and self.halves(right) is None:
            return False
        due = None
        while left:
            crossing = self.scores.get(left + right)
            if crossing is not None and (due is None or crossing[1] > due[0] or crossing[1] == due[0] and due[1]):
                return False
            a = self.scores[left][1] if len(left) > 1 else None
            b = self.scores[right][1] if len(right) > 1 else None
            if a is None and b is None:
                break
            # a lower score is merged later; of equals the left one comes first
            if b is None or a is not None and a < b:
                due, left = (a, False), self.halves(left)[1]
            else:
                due, right = (b, True), self.halves(right)[0]
        return True


class Lattice:
    """The search over one text; ``push`` takes characters and returns the ids they commit."""

    def __init__(self, pieces: Pieces, pairs: dict | None = None):
        self.p = pieces
        self.pairs = {} if pairs is None else pairs
        self.text = ""                                # characters after the committed boundary
        self.best: list = [(0.0, 0, START_ID)]        # per boundary: score, previous boundary, piece

    def _fits(self, left: int, piece: int) -> bool:
        """Whether the merges of a BPE model leave the two neighbours as they are."""
        got = self.p.fits(self.p.name(left), self.p.name(piece))
        if len(self.pairs) >= PAIR_ENTRIES:
            self.pairs.clear()
        self.pairs[(left << 32) + piece] = got
        return got

    def _character(self, end: int, found):
        """The better of ``found`` and the last character alone, if that is no piece."""
        c, before = self.text[end - 1], self.best[end - 1]
        if before is None or c in self.p.scores or found is not None and self.p.bpe:
            return found
        alone = (before[0] + self.p.lowest - 10.0, end - 1, START_ID - 1 - ord(c))
        return alone if found is None or alone[0] > found[0] else found

    def _extend(self, begin: int, stop: int) -> None:
        """Find the best piece that ends at each of the boundaries ``begin + 1`` to ``stop``, among
        the pieces that the automaton sees end there."""
        best, bpe, pairs = self.best, self.p.bpe, self.pairs
        end, found = begin + 1, None
        for last, (n, piece, value) in self.p.automaton.iter(self.text, max(0, begin + 1 - self.p.longest), stop):
            if last < begin:
                continue
            while end <= last:
                best.append(self._character(end, found))
                end, found = end + 1, None
            before = best[last + 1 - n]
            if before is None:
                continue
            if bpe:
                if found is None:
                    fits = pairs.get((before[2] << 32) + piece)
                    if fits or fits is None and self._fits(before[2], piece):
                        found = (0.0, last + 1 - n, piece)
            elif found is None or before[0] + value > found[0]:
                found = (before[0] + value, last + 1 - n, piece)
        while end <= stop:
            best.append(self._character(end, found))
            end, found = end + 1, None

    def _commit(self, boundary: int) -> list[int]:
        """The ids up to ``boundary``, which is then the new start."""
        parts, at = [], boundary
        while at > 0:
            parts.append(self.best[at][2])
            at = self.best[at][1]
        base = self.best[boundary][0]
        self.text = self.text[boundary:]
        self.best = [None if b is None else (b[0] - base, b[1] - boundary, b[2]) for b in self.best[boundary:]]
        return [i for piece in reversed(parts) for i in self.p.ids_of(piece)]

    def push(self, chars: str) -> list[int]:
        out: list[int] = []
        step = 2 * self.p.longest
        for a in range(0, len(chars), step):
            begin = len(self.text)
            self.text += chars[a:a + step]
            self._extend(begin, len(self.text))
            if len(self.text) >= step:
                out += self._settle(len(self.text))
        return out

    def _settle(self, n: int) -> list[int]:
        """Commit up to the boundary where all paths that can still grow meet."""
        live = {b for b in range(max(0, n - self.p.longest + 1), n + 1) if self.best[b] is not None}
        while len(live) > 1:
            top = max(live)
            live.remove(top)
            live.add(self.best[top][1])
        return self._commit(live.pop()) if max(live, default=0) > 0 else []

    def finish(self) -> list[int]:
        return self._commit(len(self.text))


class Codec:
    def __init__(self, path: str):
        self.pieces, self.table = Pieces.load(path)
        self.bytes_of = pa.array([*self.table, b""], pa.binary())
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pairs: dict = {}

    def _stretch(self, key: str) -> bytes:
        """Ids of a stretch that ``known`` lacks. Keys have no mark in front; a stretch without a
        mark has a space instead, with which no other key starts. A stretch that parts into others
        is not remembered itself."""
        found = self.old.get(key)
        if not found:
            if len(key) > 1 and not key.isalpha():
                inside = self.pieces.inside
                if key[-2] != " " and key[-2:] not in inside:
                    # a word and a final mark
                    return self._look(key[:-1]) + self._look(" " + key[-1])
                s = key[1:] if key[0] == " " else MARK + key
                cuts = [i for i in range(1, len(s)) if s[i - 1:i + 1] not in inside]
                if cuts:
                    keys = [key[:len(key) - len(s) + cuts[0]]]
                    keys += [" " + s[a:b] for a, b in zip(cuts, [*cuts[1:], len(s)])]
                    return b"".join(map(self._look, keys))
            lattice = Lattice(self.pieces, self.pairs)
            ids = lattice.push(key[1:] if key[:1] == " " else MARK + key) + lattice.finish()
            found = np.array(ids, dtype="<i4").tobytes()
        if len(key) <= CACHE_CHARS:
            if len(self.known) >= CACHE_ENTRIES:
                self.old, self.known = self.known, {}
            self.known[key] = found
        return found

    def _look(self, key: str) -> bytes:
        return self.known.get(key) or self._stretch(key)

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        if not text:
            return b""
        if "  " in text or text[0] == " " or MARK in text or not self.pieces.dummy_prefix:
            marked = (MARK if self.pieces.dummy_prefix else "") + text.replace(" ", MARK)
            parts = [s[1:] if s[0] == MARK else " " + s for s in _RUNS.findall(marked)]
        else:
            parts = text.split(" ")
        return b"".join([self.known.get(s) or self._stretch(s) for s in parts])

    def decode(self, ids) -> str:
        return self.decode_lists(pa.array([ids], pa.list_(pa.int32())))[0]

    def decode_lists(self, lists: pa.ListArray) -> list[str]:
        """The text of each list of ids."""
        lists = lists.fill_null([]) if lists.null_count else lists
        bounds = lists.offsets.to_numpy()
        ids = lists.values.to_numpy(zero_copy_only=False)[bounds[0]:bounds[-1]]
        # the entry after the last stands for ids outside the vocabulary
        pieces = self.bytes_of.take(pa.array(np.where((ids < 0) | (ids >= len(self.table)), len(self.table), ids)))
        at = np.concatenate([[0], np.cumsum(pc.binary_length(pieces).to_numpy(), dtype=np.int64)])[bounds - bounds[0]]
        raw = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces), b"")[0].as_py()
        skip = b" " if self.pieces.dummy_prefix else b""
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if skip and raw[a:a + 1] == skip:
                a += 1
            out.append(raw[a:b].decode("utf-8", "replace"))
        return out


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _schema(df: DataFrame, keep: list[str], name: str, kind: str) -> str:
    types = dict(df.dtypes)
    return ", ".join([f"`{c}` {types[c]}" for c in keep] + [f"`{name}` {kind}"])


def encode(docs: DataFrame, model_path: str, text_col: str = "text", keep: tuple = ("doc_id",),
           ids_col: str = "ids") -> DataFrame:
    """The ``keep`` columns and the ids of the text."""
    keep = [c for c in keep if c != ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            texts = batch.column(len(keep))
            for a, b in arrow_slices(texts):
                rows = [c.encode_bytes(t) for t in texts.slice(a, b - a).to_pylist()]
                offsets = np.cumsum([0, *(len(r) // 4 for r in rows)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), "<i4")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(a, b - a) for i in range(len(keep))] + [lists], names=[*keep, ids_col])

    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")) \
        .mapInArrow(run, _schema(docs, keep, ids_col, "array<int>"))


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", keep: tuple = ("doc_id",),
           text_col: str = "text") -> DataFrame:
    """The ``keep`` columns and the text of the ids (null ids: empty)."""
    keep = [c for c in keep if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = c.decode_lists(part.column(len(keep)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(keep))] + [pa.array(texts, pa.string())], names=[*keep, text_col])

    return rows.select(*keep, F.col(ids_col).alias("__ids")) \
        .mapInArrow(run, _schema(rows, keep, text_col, "string"))
