"""Chat formatting from an event log.

A log has one row for each event of a message: ``delta`` appends text, ``edit`` replaces the text so far, ``retry``
(a regeneration) empties it, ``drop`` removes the message, ``message`` is a finished message of its own. Events are partitioned by conversation, sorted by sequence
and folded into final messages, which are rendered with a template:

    <|im_start|>role \\n text <|im_end|> \\n

``<|`` never occurs inside a rendered role or text: every run ``<``, backslashes, ``|`` gets one more backslash, which
reading takes away again. In roles a line feed is written as backslash, ``n``, and a backslash is doubled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted

START, END = "<|im_start|>", "<|im_end|>\n"
CONTROL, GUARDED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
FORMATTED = "conv_id bigint, n_turns bigint, formatted string, loss_spans array<struct<start:bigint,end:bigint>>"


def escaped(text: str) -> str:
    return CONTROL.sub(r"<\1\\|", text)


def unescaped(text: str) -> str:
    return GUARDED.sub(r"<\1|", text)


def escaped_role(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


@dataclass
class Conversation:
    """The fold's state: messages in the order of their first event."""

    key: int | None
    messages: dict = field(default_factory=dict)

    def apply(self, message: int | None, kind: str, role: str, text: str) -> None:
        if kind == "message":
            self.messages[object()] = [role, [text], True]
            return
        now = self.messages.setdefault(message, [role, [], True])
        if kind == "delta":
            now[1].append(text)
        elif kind == "edit":
            now[0], now[1] = role or now[0], [text]
        elif kind == "retry":
            now[1] = []
        elif kind == "drop":
            now[2] = False
        else:
            raise ValueError(f"unknown event kind: {kind}")
        if kind != "drop":
            now[2] = True

    def turns(self) -> list[tuple[str, str]]:
        return [(role, "".join(parts)) for role, parts, there in self.messages.values() if there]


def render(turns: list[tuple[str, str]], loss_roles: tuple[str, ...]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the code points (end exclusive) of the texts that count towards the loss."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escaped_role(role)}\n", escaped(text)
        if role in loss_roles:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Reads a rendered conversation back."""
    turns = []
    for block in formatted.split(START)[1:]:
        head, _, body = block.partition("\n")
        if not body.endswith(END):
            raise ValueError("a turn has no end mark")
        turns.append((unescaped_role(head), unescaped(body[: -len(END)])))
    return turns


def format_conversations(events: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted and loss_spans (code points of ``formatted``).

    ``events`` has conv_id, seq, message, kind, role and text. Null role or text is empty, null kind is ``delta``;
    rows with a null conv_id make up one conversation of their own. A null seq sorts first; events with the same seq
    are ordered by message, kind, role and text, so repeated rows and any partitioning give the same result. Other
    columns are not read. Empty input gives no rows. A task holds one conversation at a time, whose formatted text
    is the row that it returns; rows of a conversation are streamed, never gathered as a group.
    """
    cols = {"conv_id": "bigint", "seq": "bigint", "message": "bigint"}
    log = events.select(*[F.col(quoted(c)).cast(t).alias(c) for c, t in cols.items()], F.coalesce(F.col("kind"), F.lit("delta")).alias("kind"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    log = log.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "message", "kind", "role", "text")
    kind = pa.struct([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def rows(done: list[Conversation]) -> pa.RecordBatch:
        out = []
        for c in done:
            turns = c.turns()
            text, spans = render(turns, loss_roles)
            out.append({"conv_id": c.key, "n_turns": len(turns), "formatted": text, "loss_spans": [{"start": a, "end": b} for a, b in spans]})
        return pa.RecordBatch.from_struct_array(pa.array(out, kind))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Conversation | None = None
        for batch in batches:
            done = []
            for conv, _, message, event, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if now is None or now.key != conv:
                    if now is not None:
                        done.append(now)
                    now = Conversation(conv)
                now.apply(message, event, role, text)
            if done:
                yield rows(done)
        if now is not None:
            yield rows([now])

    return log.mapInArrow(fold, FORMATTED)


def digests(formatted: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Per formatted conversation, what its text says when it is read back: digests of all turns and of the loss text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for conv, text, spans in zip(*[batch.column(k).to_pylist() for k in ("conv_id", "formatted", "loss_spans")]):
                turns, whole, loss, chars = parse(text), hashlib.sha256(), hashlib.sha256(), 0
                for role, body in turns:
                    whole.update(f"{role}\n{body}\n".encode())
                for s in spans:
                    body = unescaped(text[s["start"] : s["end"]])
                    loss.update(body.encode())
                    chars += len(body)
                for k, v in zip(out, (conv, len(turns), whole.hexdigest(), chars, loss.hexdigest(), len(text))):
                    out[k].append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

    return formatted.mapInArrow(read, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as an event log: each row is one whole message, in the order of its turn.

    Rows that share a turn stay messages of their own, in the order of role and text.
    """
    return conversations.select(F.col("conv_id"), F.col("turn").alias("seq"), F.lit(None).cast("bigint").alias("message"), F.lit("message").alias("kind"), F.col("role"), F.col("text"))
