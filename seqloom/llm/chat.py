"""Chat formatting: event logs folded into messages, rendered with a reversible template.

An event log has conv_id, turn, msg, seq, kind, role and text: turn is a message's place in its
conversation, msg tells messages at one place apart.  Events of a message, by seq, are `message`
(begins it), `delta` (appends), `edit` (replaces what is there) and `regenerate` (throws it
away; later deltas build the new reply).
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOSS_ROLE = "assistant"
_CONTROL = re.compile(r"[\\<:\n]|###")
_BODY = re.compile(r"[\\<]|###")
_TURN = re.compile(r"### ((?:[^\\:\n]|\\.)*): ((?:[^\\<]|\\.)*)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """A backslash before every control string, so that no text can open or close a turn."""
    return _BODY.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn, and the span in it that a loss would count (empty for other roles)."""
    head = "### " + _CONTROL.sub(lambda m: "\\" + m[0], role) + ": "
    body = escape(text)
    span = (len(head), len(head) + len(body)) if role == LOSS_ROLE else (len(head), len(head))
    return f"{head}{body}</turn>\n", *span


def parse(rendered: str) -> list[tuple[str, str]]:
    """(role, text) of each turn in rendered text: the inverse of render."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(rendered)]


def _batch(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


_TURNS = [(c, pa.int64()) for c in ("conv_id", "turn", "msg")] + [(c, pa.string()) for c in ("role", "text", "rendered")] + [(c, pa.int64()) for c in ("loss_start", "loss_end")]
_DIGESTS = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]


def _fold(batches):
    """Rows come sorted by conversation, message and sequence; one message is held at a time."""
    held = None  # [conv, turn, msg, role, pieces]

    def done(m):
        text = "".join(m[4])
        return (*m[:4], text, *render(m[3], text))

    for batch in batches:
        out = []
        for conv, turn, msg, kind, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            text, role = text or "", role or ""
            if held is None or kind == "message" or held[:3] != [conv, turn, msg]:
                if held:
                    out.append(done(held))
                held = [conv, turn, msg, role, [] if kind == "regenerate" else [text]]
            elif kind == "delta":
                held[4].append(text)
            else:
                held[3], held[4] = role or held[3], [text] * (kind == "edit")
        yield _batch(out, _TURNS)
    if held:
        yield _batch([done(held)], _TURNS)


KINDS = ("message", "delta", "edit", "regenerate")


def format_chats(events: DataFrame) -> DataFrame:
    """One row per final message: conv_id, turn, msg, role, text, rendered, loss_start, loss_end.

    The log is dealt out by conversation and message and sorted by sequence, so a conversation
    with very many messages spreads over all tasks, and one message at a time, however long, is
    in memory.  A conversation's document is its `rendered` by turn, role and text; offsets are
    code points.  Without a column turn, msg gives a message's place.

    Null role or text: empty.  Null kind: message; an unknown kind is an error.  Null conv_id, turn
    or msg group together and come first.  Several `message` events of one msg stay separate
    turns, ordered by seq, role and text; repeated rows are kept.  A delta or edit with nothing
    before it begins its message.  No rows give no rows; other columns are ignored.
    """
    kind = F.coalesce("kind", F.lit("message"))
    known = F.when(kind.isin(*KINDS), kind).otherwise(F.raise_error(F.concat(F.lit("unknown kind of event: "), kind)))
    turn = F.col("turn" if "turn" in events.columns else "msg").cast("long").alias("turn")
    log = events.select(F.col("conv_id").cast("long").alias("conv_id"), turn, F.col("msg").cast("long").alias("msg"), F.col("seq").cast("long").alias("seq"), known.alias("kind"), "role", "text")
    dealt = log.repartition("conv_id", "turn", "msg").sortWithinPartitions("conv_id", "turn", "msg", "seq", "role", "text")
    return dealt.drop("seq").mapInArrow(_fold, "conv_id long, turn long, msg long, role string, text string, rendered string, loss_start long, loss_end long")


def _digest(batches):
    held = None

    def row():
        conv, n, turns, loss, loss_chars, chars = held
        return conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    for batch in batches:
        out = []
        for conv, rendered, start, end in zip(*(c.to_pylist() for c in batch.columns)):
            if held is None or held[0] != conv:
                if held:
                    out.append(row())
                held = [conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 0]
            for role, text in parse(rendered):
                held[1] += 1
                held[2].update(f"{role}\n{text}\n".encode())
            learned = unescape(rendered[start:end])
            held[3].update(learned.encode())
            held[4] += len(learned)
            held[5] += len(rendered)
        yield _batch(out, _DIGESTS)
    if held:
        yield _batch([row()], _DIGESTS)


def chat_digests(formatted: DataFrame) -> DataFrame:
    """What each conversation's rendered turns hold, read back from them: one row per conv_id.

    A digest over a conversation runs through its turns in order, so they meet in one task, sorted
    on disk where needed; the task streams over them and holds one turn at a time.
    """
    dealt = formatted.select("conv_id", "turn", "role", "text", "rendered", "loss_start", "loss_end").repartition("conv_id")
    rows = dealt.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "rendered", "loss_start", "loss_end")
    return rows.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
