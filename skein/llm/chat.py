"""Chat formatting: a finite-state machine over roles emits text segments with loss flags.

A template declares the marks around a turn, the legal successions of roles and
the roles that are trained on. Each turn becomes three segments (head, body,
foot); only the body of a trained role carries loss. Control strings inside a
text are escaped with a backslash, and backslashes are doubled, so that the text
comes back exactly.

Conversations are sorted inside their partition and streamed through the machine:
one turn is in memory at a time, however long a conversation is.

Defined cases: null role or text is an empty string; null ``conv_id`` is one
conversation of its own; turns sort by ``turn`` (null first), then role, then
text, so ties and repeated rows have one order; a turn that breaks the order of
roles is still formatted, and its rows say ``ok = false``; columns other than the
four are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = "conv_id long, turn_no long, part string, text string, loss boolean, ok boolean"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


@dataclass(frozen=True)
class Template:
    """Marks, roles and successions. ``follows[state]`` are the roles allowed after it; the first state is ``""``."""

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"
    trained: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})

    def __post_init__(self):
        for mark in (self.open, self.close):
            if len(mark.strip()) < 2 or "\\" in mark:
                raise ValueError(f"a mark needs two characters or more and no backslash: {mark!r}")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open.strip(), self.close.strip())

    def escape(self, text: str, role: bool = False) -> str:
        text = text.replace("\\", "\\\\")
        for mark in self.controls:
            if mark in text:
                text = text.replace(mark, f"{mark[0]}\\{mark[1:]}")
        return text.replace("\n", "\\n") if role else text

    def unescape(self, text: str, role: bool = False) -> str:
        if "\\" not in text:
            return text
        return re.sub(r"\\(.)", lambda m: "\n" if role and m[1] == "n" else m[1], text, flags=re.S)

    def segments(self, role: str, text: str) -> list[tuple[str, str, bool]]:
        return [("head", f"{self.open}{self.escape(role, True)}{self.after_role}", False), ("body", self.escape(text), role in self.trained), ("foot", self.close, False)]

    def read_head(self, head: str) -> str:
        if not head.startswith(self.open) or not head.endswith(self.after_role):
            raise ValueError(f"not a turn's head: {head[:40]!r}")
        return self.unescape(head[len(self.open) : len(head) - len(self.after_role)], True)

    def parse(self, text: str) -> list[tuple[str, str]]:
        """Roles and texts of one conversation's whole formatted text."""
        turns, at = [], 0
        while at < len(text):
            stop = text.index(self.after_role, at + len(self.open)) + len(self.after_role)
            end = text.index(self.close, stop)
            turns.append((self.read_head(text[at:stop]), self.unescape(text[stop:end])))
            at = end + len(self.close)
        return turns


def format_chats(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Segments of all conversations, in order inside each partition."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, turn, first = None, "", 0, True
        for batch in batches:
            out: list[tuple] = []
            for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
                if first or c != conv:
                    conv, state, turn, first = c, "", 0, False
                ok = role in template.follows.get(state, ())
                out += [(c, turn, part, s, loss, ok) for part, s, loss in template.segments(role, text)]
                state, turn = role, turn + 1
            yield _batch(out, ("conv_id", "turn_no", "part", "text", "loss", "ok"), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_()))

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SEGMENTS)


def digests(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation, read back from the segments as ``format_chats`` streams them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, open_, role = None, None, ""
        for batch in batches:
            done = []
            for c, turn, part, text, loss, ok in zip(*(x.to_pylist() for x in batch.columns)):
                if open_ is None or c != conv or (turn == 0 and part == "head"):
                    if open_ is not None:
                        done.append(_closed(conv, open_))
                    conv, open_ = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True]
                open_[4] += len(text)
                open_[5] &= ok
                plain = template.unescape(text) if part == "body" else ""
                if part == "head":
                    role = template.read_head(text)
                elif part == "body":
                    open_[0] += 1
                    open_[1].update(f"{role}\n{plain}\n".encode())
                if loss:
                    open_[2] += len(plain)
                    open_[3].update(plain.encode())
            yield _digest(done)
        if open_ is not None:
            yield _digest([_closed(conv, open_)])

    return segments.mapInArrow(run, DIGESTS)


def _closed(conv: int | None, x: list) -> tuple:
    return conv, x[0], x[1].hexdigest(), x[2], x[3].hexdigest(), x[4], x[5]


def _digest(rows: list[tuple]) -> pa.RecordBatch:
    return _batch(rows, ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()))


def _batch(rows: list[tuple], names: tuple, kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], list(names))
