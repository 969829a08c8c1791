"""Conversations rebuilt from an event log, and rendered for training.

The log is dealt by conversation and sorted by turn, message and sequence number; a task
reads it once and folds the events of a message into its final text:

    start       begins the message: role, and text if there is any
    delta       appends text (a streamed answer)
    edit        replaces the text
    regenerate  drops the text; the deltas that follow make the new answer
    delete      drops the message

An event that was delivered twice (same conversation, turn, message and number) counts
once.  A task holds one message at a time, however long its conversation is.

A message is rendered as

    <|im_start|>role
    text<|im_end|>

with a backslash before each backslash and inside each "<|" of the text, so that no text
can make a mark, and the text can be read back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = ("assistant",)
EVENTS = ("conv_id", "turn", "message", "seq", "kind", "role", "text")
SEGMENTS = "conv_id long, position long, role string, segment string, loss_from long, loss_to long"
#: Code points of a streamed delta when plain rows are turned into events.
DELTA_CHARS = 512

_SEGMENT = re.compile(re.escape(START) + r"(.*?)\n(.*)" + re.escape(END) + "\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def render(role: str, text: str, trained: tuple[str, ...] = TRAINED) -> tuple[str, int, int]:
    """The segment of a message, and the code points of it that count for the loss."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    loss = (len(head), len(head) + len(body)) if role in trained else (0, 0)
    return f"{head}{body}{END}\n", *loss


def parse(segment: str) -> tuple[str, str]:
    """Role and text of a segment."""
    found = _SEGMENT.fullmatch(segment)
    return unescape_role(found[1]), unescape(found[2])


def fold(events: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, turn, message, seq, kind, role, text), sorted -> (conv_id, role, text)."""
    key = seq = None
    begun = alive = False
    role, parts = None, []
    for conv, turn, message, number, kind, said, text in events:
        if not begun or (conv, turn, message) != key:
            if begun and alive:
                yield key[0], role or "", "".join(parts)
            begun, alive, key, seq, role, parts = True, True, (conv, turn, message), None, None, []
        elif number == seq and number is not None:
            continue
        seq = number
        role = said if said is not None else role
        if kind == "delete":
            alive = False
        elif kind in ("edit", "regenerate", "start"):
            parts = []
        elif kind != "delta":
            raise ValueError(f"unknown kind of event: {kind}")
        if text and kind != "regenerate":
            parts.append(text)
    if begun and alive:
        yield key[0], role or "", "".join(parts)


def format_conversations(events: DataFrame, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """Segments in order: conv_id, position in the conversation, role, segment, and the code
    points of the segment under the loss mask (none: 0, 0).  Joined in order, the segments of
    a conversation are its formatted text; they stay apart so that a conversation may be
    longer than a row can be.

    Null texts are empty, a message without a role has an empty one, null conv_ids are one
    conversation, messages of equal turn follow each other by ``message``.  Other columns are
    ignored; an empty log gives no rows."""
    src = events.select(*[F.col(f"`{c}`") for c in EVENTS]).withColumn("conv_id", F.col("conv_id").cast("long"))
    dealt = src.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "message", "seq", "kind", "text")

    def run(batches):
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        out, chars, last, position = [], 0, object(), 0
        for conv, role, text in fold(rows):
            position = position + 1 if conv == last else 0
            last = conv
            segment, begin, end = render(role, text, trained)
            out.append((conv, position, role, segment, begin, end))
            chars += len(segment)
            if chars > 4_000_000:
                yield _batch(out)
                out, chars = [], 0
        if out:
            yield _batch(out)

    return dealt.mapInArrow(run, SEGMENTS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in SEGMENTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(segments: DataFrame) -> DataFrame:
    """One row per conversation, read from the segments that ``format_conversations`` made
    (a conversation's segments stand together, in order): what the marks and the loss mask
    give back."""

    def run(batches):
        last, begun = None, False
        out = []

        def close():
            out.append((last, turns, said.hexdigest(), loss_chars, loss.hexdigest(), chars))

        for b in batches:
            for conv, segment, begin, end in zip(
                *[b.column(c).to_pylist() for c in ("conv_id", "segment", "loss_from", "loss_to")], strict=True
            ):
                if not begun or conv != last:
                    if begun:
                        close()
                    last, begun, turns, chars, loss_chars = conv, True, 0, 0, 0
                    said, loss = hashlib.sha256(), hashlib.sha256()
                role, text = parse(segment)
                said.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                under_mask = unescape(segment[begin:end])
                loss.update(under_mask.encode("utf-8", "surrogatepass"))
                turns, chars, loss_chars = turns + 1, chars + len(segment), loss_chars + len(under_mask)
            if len(out) >= 5000:
                yield _digests(out)
                out.clear()
        if begun:
            close()
        if out:
            yield _digests(out)

    return segments.mapInArrow(run, DIGESTS)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def events_of_rows(rows: DataFrame) -> DataFrame:
    """A log from a table of final messages (conv_id, turn, role, text): each row starts a
    message and streams its text in deltas.  Rows of equal turn are messages of their own,
    by role and text."""
    named = rows.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    message = F.concat_ws(":", F.coalesce("role", F.lit("")), F.hex(F.xxhash64("text")), F.monotonically_increasing_id())
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{DELTA_CHARS}}}"), F.lit(0))
    steps = F.concat(F.array(F.lit(None).cast("string")), pieces)
    return named.withColumn("message", message).select(
        "conv_id", "turn", "message", F.posexplode(steps).alias("seq", "text"), "role"
    ).select(
        "conv_id",
        "turn",
        "message",
        "seq",
        F.when(F.col("seq") == 0, "start").otherwise("delta").alias("kind"),
        F.when(F.col("seq") == 0, F.col("role")).alias("role"),
        "text",
    )
