"""Operator 1: chat formatting with prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the context, and only
its reply is trainable. The expansion is kept by reference, since written out it grows with the
square of a conversation: ``format_turns`` writes every turn once, as the segment that the
template makes of it, with its character offset in the conversation; an example is the
conversation's text up to the end of its reply (``context_to``) and the range of the reply
(``loss_from``, ``loss_to``). ``render_examples`` writes chosen examples out in full.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts ``&`` becomes ``&amp;`` and
``<|`` becomes ``&lt;|``, in roles also a line break ``&#10;``, so no text can open or close a
turn; ``unescape`` restores them.

Offsets are running sums over a conversation in two levels (inside blocks of turn numbers, then
over the blocks), so one long conversation is spread over tasks.

Defined results: a null role or text is empty; turns are in the order of ``turn`` (null first), then
role, then text; repeated turns are all kept; null conversation ids form one conversation; a
conversation without assistant turns has no example; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
# Turn numbers of one block of the offset sums.
BLOCK = 256
_SEGMENT = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", re.S)


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(s: str) -> str:
    return s.replace("&#10;", "\n").replace("&lt;|", "<|").replace("&amp;", "&")


def format_turns(conversations: DataFrame, trainable: str = "assistant", conv_col: str = "conv_id",
                 turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: conv_id, seq (its place in the conversation), segment, seg_from (its
    offset in characters), and for a trainable turn context_to, loss_from and loss_to."""
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    name = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("&#10;"))
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                                role.alias("role"), text.alias("text")) \
        .select("conv_id", "turn", "role", "text", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK).alias("block"),
                F.concat(F.lit(OPEN), name, F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    rows = rows.withColumns({"segment": F.concat("head", "body", F.lit(CLOSE + "\n"))}) \
        .withColumn("size", F.length("segment"))
    blocks = rows.groupBy("conv_id", "block").agg(F.sum("size").alias("chars"), F.count(F.lit(1)).alias("turns"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"),
                           F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"),
                           F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("turns_before"))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = rows.withColumns({
        "n": F.row_number().over(inside),
        "upto": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    joined = placed.join(starts, placed.conv_id.eqNullSafe(starts.c) & (placed.block == starts.b))
    seg = (F.col("chars_before") + F.col("upto") - F.col("size"))
    loss = F.col("role") == trainable
    at = seg + F.length("head")
    return joined.select(
        "conv_id", (F.col("turns_before") + F.col("n") - 1).alias("seq"), "segment", seg.alias("seg_from"),
        F.when(loss, at + F.length("body")).alias("context_to"), F.when(loss, at).alias("loss_from"),
        F.when(loss, at + F.length("body")).alias("loss_to"))


def examples(formatted: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, target (its seq), context_to, loss_from, loss_to. The
    example's text is the conversation's characters [0, context_to)."""
    return formatted.filter("loss_from is not null").select(
        "conv_id", F.col("seq").alias("target"), "context_to", "loss_from", "loss_to")


def render_examples(formatted: DataFrame, chosen: DataFrame) -> DataFrame:
    """The full text of the ``chosen`` examples: conv_id, target, text, loss_from, loss_to. An
    example's turns are gathered in its row, so its size is that of the example."""
    c = chosen.select(F.col("conv_id").alias("c"), "target", "context_to", "loss_from", "loss_to")
    turns = formatted.select("conv_id", "seq", "segment")
    rows = c.join(turns, c.c.eqNullSafe(turns.conv_id) & (F.col("seq") <= F.col("target")))
    key = ["conv_id", "target", "context_to", "loss_from", "loss_to"]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "segment"))), lambda s: s["segment"]), "")
    return rows.groupBy(*key).agg(text.alias("all")).select(
        "conv_id", "target", F.substring("all", F.lit(1), F.col("context_to").cast("int")).alias("text"),
        "loss_from", "loss_to")


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
          "formatted_chars long, n_examples long, example_chars long")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read segments in order, one running state per conversation; never a whole conversation. A turn
    comes once for each example that trains on it, at least once."""
    state, done = None, []

    def close():
        done.append((state["id"], state["n"], state["turns"].hexdigest(), state["lost"], state["loss"].hexdigest(),
                     state["at"], state["examples"], state["example_chars"]))

    for batch in batches:
        for conv, seq, segment, seg_from, context_to, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            if state is None or state["id"] != conv:
                if state is not None:
                    close()
                state = {"id": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "lost": 0, "at": 0,
                         "examples": 0, "example_chars": 0}
            if seq == state["n"]:
                m = _SEGMENT.fullmatch(segment)
                if m is None or seg_from != state["at"]:
                    raise ValueError(f"conversation {conv}: the segment at {seg_from} is not a turn in its place")
                role, text = unescape(m.group(1)), m.group(2).replace("&lt;|", "<|").replace("&amp;", "&")
                state["n"] += 1
                state["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state["at"] += len(segment)
            if a is not None:
                masked = segment[a - seg_from:b - seg_from].replace("&lt;|", "<|").replace("&amp;", "&")
                state["lost"] += len(masked)
                state["loss"].update(masked.encode("utf-8", "surrogatepass"))
                state["examples"] += 1
                state["example_chars"] += context_to
        yield _table(done)
        done.clear()
    if state is not None:
        close()
        yield _table(done)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    cols = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)],
                                      names=[x.split()[0] for x in DIGEST.split(", ")])


def digests(formatted: DataFrame, expanded: DataFrame | None = None) -> DataFrame:
    """Per conversation, read back from the formatted turns and the examples (``expanded``, by default
    all of ``examples``) joined to the turns that they train on: number of turns, sha256 of all turns
    and of the text under the examples' loss masks, and sizes. A hash of a conversation is
    sequential, so its rows pass through one task, sorted and streamed."""
    e = (examples(formatted) if expanded is None else expanded).select(
        F.col("conv_id").alias("c"), F.col("target").alias("seq_of"), "context_to", "loss_from", "loss_to")
    turns = formatted.select("conv_id", "seq", "segment", "seg_from")
    joined = turns.join(e, turns.conv_id.eqNullSafe(e.c) & (turns.seq == e.seq_of), "left")
    return joined.repartition("conv_id").sortWithinPartitions("conv_id", "seq").select(
        "conv_id", "seq", "segment", "seg_from", "context_to", "loss_from", "loss_to").mapInArrow(_digests, DIGEST)
