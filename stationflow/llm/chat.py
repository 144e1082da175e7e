"""Chat formatting from an event log.

Events of a message are folded in the order of their sequence, messages are
rendered in the order of turns, and the loss mask marks the assistant's texts.
Null texts and roles count as empty, null turns come first, rows that repeat a
turn are all kept and ordered by role and text, a null ``conv_id`` is a
conversation like any other. Extra columns are ignored, whatever their
names are. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import staged

HEAD, TAIL = "### ", "</turn>\n"
BLOCK_TURNS = 256
CHUNK_CHARS = 1_000_000
LEARNED_ROLE = "assistant"
_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|n)")
_END = re.compile(r"\\(?:\\|###|</turn>)|(</turn>)")


def escape(text: str) -> str:
    """Put a backslash before each backslash and each control string."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """One turn, and where its text starts and ends in it."""
    head = f"{HEAD}{escape(role).replace(chr(10), chr(92) + 'n')}:\n"
    body = escape(text)
    return head + body + TAIL, len(head), len(head) + len(body)


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """Turns of a formatted text: role, text, and where the escaped text starts and ends."""
    at = 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        start = end = line + 1
        while True:
            m = _END.search(formatted, end)
            end = m.end()
            if m[1]:
                break
        yield unescape(formatted[at + len(HEAD) : line - 1]), unescape(formatted[start : m.start()]), start, m.start()
        at = m.start() + len(TAIL)


def fold(kind: str, text: str, parts: list[str]) -> list[str]:
    """The parts of a message after one more event.

    ``start`` and ``regenerate`` leave it empty, ``edit`` replaces it, ``delta`` appends.
    """
    if kind == "delta":
        parts.append(text)
        return parts
    return [text] if kind == "edit" else []


EVENT = "conv_id long, turn long, ord int, seq int, kind string, role string, text string"
FORMATTED = "conv_id long, block long, chunk int, text string, loss array<struct<start: int, end: int>>, n_turns int"


def format_log(events: DataFrame) -> DataFrame:
    """Final messages of a log (columns of ``EVENT``), rendered.

    Logs are dealt by conversation and block of turns, sorted by turn, message
    and sequence, and folded as they stream by, so a task holds one message
    and one chunk of output at a time, however long a conversation is. A row of
    the result is a chunk of a conversation; by (block, chunk) they make up
    its text. ``loss`` has the places of the learned texts in the chunk.
    """
    rows = events.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(1 << 53))).cast("long"))
    order = ["conv_id", "block", "turn", "ord", "seq"]
    dealt = rows.repartition("conv_id", "block").sortWithinPartitions(*order).select(*order, "kind", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        part = message = None  # (conv_id, block) and (turn, ord) being worked on
        parts, role, chunk, size, loss, turns, done = [], "", 0, 0, [], 0, []

        def close_message():
            nonlocal size, turns
            if message is not None:
                turn, lo, hi = render(role, "".join(parts))
                done.append(turn)
                if role == LEARNED_ROLE:
                    loss.append({"start": size + lo, "end": size + hi})
                size += len(turn)
                turns += 1

        def close_chunk():
            nonlocal done, size, loss, turns, chunk
            if turns:
                made.append((*part, chunk, "".join(done), loss, turns))
            done, size, loss, turns, chunk = [], 0, [], 0, chunk + 1

        for batch in batches:
            for conv, block, turn, ord_, _, kind, who, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (conv, block) != part or (turn, ord_) != message:
                    close_message()
                    if (conv, block) != part:
                        if part is not None:
                            close_chunk()
                        part, chunk = (conv, block), 0
                    elif size >= CHUNK_CHARS:
                        close_chunk()
                    message, parts, role = (turn, ord_), [], ""
                if kind == "start":
                    role = who or ""
                parts = fold(kind, text or "", parts)
            if made:
                yield _chunks(made)
                made = []
        close_message()
        if part is not None:
            close_chunk()
        if made:
            yield _chunks(made)

    return dealt.mapInArrow(run, FORMATTED)


def _chunks(rows: list[tuple]) -> pa.RecordBatch:
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), spans, pa.int32()]
    names = ["conv_id", "block", "chunk", "text", "loss", "n_turns"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """What formatted conversations hold: ``conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars``.

    Chunks stream by in order; digests are carried along, so no task holds
    more than a chunk.
    """
    schema = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
    rows = formatted.select("conv_id", "block", "chunk", "text", "loss").repartition("conv_id")
    rows = rows.sortWithinPartitions("conv_id", "block", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        out: list[tuple] = []
        open_, conv = False, None
        for batch in batches:
            for this, _, _, text, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if not open_ or this != conv:
                    if open_:
                        out.append((conv, n, turns.hexdigest(), chars, learned.hexdigest(), size))
                    open_, conv, n, chars, size = True, this, 0, 0, 0
                    turns, learned = hashlib.sha256(), hashlib.sha256()
                for role, body, _, _ in parse(text):
                    n += 1
                    turns.update(f"{role}\n{body}\n".encode())
                for span in loss:
                    body = unescape(text[span["start"] : span["end"]])
                    chars += len(body)
                    learned.update(body.encode())
                size += len(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                out = []
        if open_:
            out.append((conv, n, turns.hexdigest(), chars, learned.hexdigest(), size))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return rows.mapInArrow(run, schema)


def log_of(conversations: DataFrame) -> DataFrame:
    """An event log that ends in the rows of ``conversations`` (``conv_id turn role text``).

    The learned role's messages are streamed once, regenerated, and streamed
    again in two deltas; all others are typed and then edited to their final text.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("ord", F.row_number().over(W.partitionBy("conv_id", "turn").orderBy("role", "text")))
    half = (F.length("text") / 2).cast("int")
    draft = F.upper(F.col("text").substr(F.lit(1), half))

    def event(seq: int, kind: str, text) -> F.Column:
        return F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))

    streamed = F.array(
        event(0, "start", F.lit("")), event(1, "delta", draft), event(2, "regenerate", F.lit("")),
        event(3, "delta", F.col("text").substr(F.lit(1), half)),
        event(4, "delta", F.col("text").substr(half + 1, F.length("text"))),
    )
    typed = F.array(event(0, "start", F.lit("")), event(1, "delta", draft), event(2, "edit", F.col("text")))
    each = F.explode(F.when(F.col("role") == LEARNED_ROLE, streamed).otherwise(typed)).alias("e")
    return rows.select("conv_id", "turn", "ord", "role", each).select(
        "conv_id", "turn", "ord", "e.seq", "e.kind", F.when(F.col("e.kind") == "start", F.col("role")).alias("role"), "e.text"
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Format conversations, write them to the shared folder and read them back."""
    return read_back(staged(format_log(log_of(conversations)), "chat"))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(regexp_replace(role, '(\\|###|</turn>|\n)', 'x\1', 'g')) + 2
    + length(regexp_replace(text, '(\\|###|</turn>)', 'x\1', 'g')) + 8) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
