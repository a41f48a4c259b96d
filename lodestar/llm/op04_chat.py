"""Chat formatting: conversations rebuilt from event logs, then rendered.

A log row is an event: ``message`` opens a message, ``delta`` adds to the end of
one, ``edit`` replaces its text, ``regenerate`` takes it and all after it back
(with a text, a new message of the same role follows in its place), ``delete``
removes it.  Events name the message by ``target``; without one, the last.  A
table of finished turns is a log of messages.

Conversations are dealt out by id and sorted by sequence, then text; each is
folded as it streams by, so that memory holds one conversation's messages.  The
template is ``<|im_start|>role\\ntext<|im_end|>\\n``; in roles and texts the
control strings' opening ``<|`` is written ``<\\|``, and ``<\\`` is written
``<\\\\``, so that neither can be mistaken and both can be read back.

Nulls, ties and odd rows: null role or text count as empty; events of one
sequence number come in the order of role, then text; repeated rows are events of
their own; rows without conv_id form one conversation, rows without sequence come
first.  Extra columns are not looked at.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLES = ("assistant",)
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    """No ``<|`` is left; ``unescape`` gives the text back."""
    return re.sub(r"<(?=[|\\])", r"<\\", text)


def unescape(text: str) -> str:
    return text.replace("<\\", "<")


def escape_role(role: str) -> str:
    return escape(role).replace("%", "%25").replace("\n", "%0A")


def unescape_role(role: str) -> str:
    return unescape(role.replace("%0A", "\n").replace("%25", "%"))


def render(messages: list[tuple[str, str]], loss_roles: tuple[str, ...] = LOSS_ROLES) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of it that carry loss."""
    out, spans, at = [], [], 0
    for role, text in messages:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role in loss_roles:
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}{END}\n")
        at += len(out[-1])
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages of a formatted conversation."""
    return [(unescape_role(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def fold(events: Iterator[tuple[str, int | None, str, str]]) -> list[tuple[str, str]]:
    """(kind, target, role, text) events, in order, to final (role, text) messages.

    Targets count messages opened so far, from 0; an event whose target is gone
    or was never there changes nothing."""
    made: list[list | None] = []  # role, pieces of text; None: taken back
    for kind, target, role, text in events:
        if kind == "message":
            made.append([role, [text]])
            continue
        at = target if target is not None else next((i for i in range(len(made) - 1, -1, -1) if made[i]), -1)
        if not 0 <= at < len(made) or made[at] is None:
            continue
        if kind == "delta":
            made[at][1].append(text)
        elif kind == "edit":
            made[at][1] = [text]
        elif kind == "delete":
            made[at] = None
        elif kind == "regenerate":
            old = made[at][0]
            for i in range(at, len(made)):
                made[i] = None
            if text:
                made.append([role or old, [text]])
    return [(m[0], "".join(m[1])) for m in made if m]


def _formatted(with_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def conversation(conv: int | None, events: list[tuple]) -> dict:
        text, spans = render(fold(iter(events)))
        # everything below is read back from the output
        turns = parse(text)
        seen, loss, loss_chars = hashlib.sha256(), hashlib.sha256(), 0
        for role, body in turns:
            seen.update(f"{role}\n{body}\n".encode())
        for low, high in spans:
            body = unescape(text[low:high])
            loss.update(body.encode())
            loss_chars += len(body)
        return {
            "conv_id": conv, "n_turns": len(turns), "turns_sha256": seen.hexdigest(), "loss_chars": loss_chars, "loss_sha256": loss.hexdigest(),
            "formatted_chars": len(text), "formatted": text if with_text else None, "loss_spans": [{"start": a, "end": b} for a, b in spans],
        }

    kinds = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        events: list[tuple] = []
        out: list[dict] = []
        size = 0
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv", "kind", "target", "role", "text")]
            for conv, *event in zip(*columns, strict=True):
                if events and conv != now:
                    out.append(conversation(now, events))
                    size += out[-1]["formatted_chars"]
                    events = []
                    if size > 1 << 22 or len(out) > 5000:
                        yield pa.RecordBatch.from_pylist(out, kinds)
                        out, size = [], 0
                now = conv
                events.append(tuple(event))
        if events:
            out.append(conversation(now, events))
        if out:
            yield pa.RecordBatch.from_pylist(out, kinds)

    return run


def format_chats(
    log: DataFrame, conv: str = "conv_id", seq: str = "turn", role: str = "role", text: str = "text", kind: str | None = None, target: str | None = None, with_text: bool = True
) -> DataFrame:
    """One row per conversation: conv_id, digests read back from the output, the
    formatted text (null without ``with_text``) and its loss spans."""
    events = log.select(
        F.col(conv).cast("long").alias("conv"),
        F.col(seq).cast("long").alias("seq"),
        F.coalesce(F.col(kind), F.lit("message")).alias("kind") if kind else F.lit("message").alias("kind"),
        (F.col(target).cast("int") if target else F.lit(None).cast("int")).alias("target"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    fields = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
        "formatted string, loss_spans array<struct<start:long,end:long>>"
    )
    return events.repartition("conv").sortWithinPartitions("conv", "seq", "role", "text").mapInArrow(_formatted(with_text), fields)
