"""Chat formatting: a finite-state machine over roles and a declarative template.

A template is plain data.  ``transitions`` maps a state to the states that may follow (states are roles, with
``start`` before the first turn); ``final`` are the states in which a conversation may end.  ``labels`` names
roles in the output, ``open`` and ``close`` mark turns, and text of ``loss_roles`` carries the loss.

The machine emits segments (text, loss) for every turn, valid or not, and the first violation beside them.
Control strings inside texts are escaped with a backslash, and so is the backslash, so ``parse`` gives back
every turn exactly.

Defined results: turns go by ``turn`` (null first), then role and text; null text or role is empty; rows without
a conv_id are one conversation with a null id; repeated rows are repeated turns; an unknown role is a violation,
but its turn is kept under its own name; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATTED = (
    "conv_id bigint, text string, segments array<struct<start:int,end:int,loss:boolean>>, "
    "turns array<struct<role:string,text:string>>, valid boolean, violation string"
)


@dataclass(frozen=True)
class Template:
    open: str = "### {label}: "
    close: str = "</turn>\n"
    labels: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"})
    other: str = "@{role}"
    loss_roles: tuple = ("assistant",)
    controls: tuple = ("###", "</turn>")
    transitions: dict = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user", "tool"),
            "tool": ("assistant",),
        }
    )
    final: tuple = ("assistant",)

    def _tokens(self, more: tuple = ()) -> str:
        return "|".join(re.escape(x) for x in ("\\", *self.controls, *more))

    def escape(self, text: str, more: tuple = ()) -> str:
        return re.sub(self._tokens(more), lambda m: "\\" + m[0], text)

    def unescape(self, text: str, more: tuple = ()) -> str:
        return re.sub(rf"\\({self._tokens(more)})", r"\1", text)

    def label(self, role: str) -> str:
        return self.labels[role] if role in self.labels else self.other.format(role=self.escape(role, (": ",)))

    def violation(self, roles: list[str]) -> str | None:
        """The first place at which the machine cannot go on."""
        state = "start"
        for i, role in enumerate(roles):
            if role not in self.labels:
                return f"{i}: unknown role {role!r}"
            if role not in self.transitions.get(state, ()):
                return f"{i}: {role} after {state}"
            state = role
        return None if state in self.final else f"{len(roles)}: ends after {state}"

    def segments(self, turns: list[tuple[str, str]]) -> Iterator[tuple[str, bool]]:
        for role, text in turns:
            yield self.open.format(label=self.label(role)), False
            yield self.escape(text), role in self.loss_roles
            yield self.close, False

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """The turns of a formatted conversation."""
        roles = {v: k for k, v in self.labels.items()}
        before, after = self.open.split("{label}")
        mark = re.compile(rf"\\(?:{self._tokens((after,))})|({re.escape(self.close)})|({re.escape(before)})|({re.escape(after)})")
        out, at, label, begin = [], 0, None, 0
        for m in mark.finditer(formatted):
            if m[2] is not None:
                label, begin = None, m.end()
            elif m[3] is not None and label is None:
                label, begin = formatted[begin : m.start()], m.end()
            elif m[1] is not None:
                role = roles.get(label)
                if role is None:
                    role = self.unescape(label.removeprefix(self.other.split("{role}")[0]), (after,))
                out.append((role, self.unescape(formatted[begin : m.start()])))
                at = m.end()
        assert at == len(formatted), "text after the last turn"
        return out


def gather(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order."""
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("rows"))


def format_chats(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """FORMATTED: one training text for each conversation, its segments with loss flags, and the machine's verdict."""
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("conv_id", pa.int64()), ("text", pa.string()), ("segments", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("loss", pa.bool_())]))), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), ("valid", pa.bool_()), ("violation", pa.string())])
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out = []
                for conv_id, rows in zip(*(batch.column(k).slice(lo, 256).to_pylist() for k in (0, 1)), strict=True):
                    turns = [(r["role"], r["text"]) for r in rows]
                    at, text, spans = 0, [], []
                    for part, loss in template.segments(turns):
                        spans.append({"start": at, "end": at + len(part), "loss": loss})
                        text.append(part)
                        at += len(part)
                    why = template.violation([r for r, _ in turns])
                    out.append({"conv_id": conv_id, "text": "".join(text), "segments": spans, "turns": [{"role": r, "text": t} for r, t in turns], "valid": why is None, "violation": why})
                yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return gather(conversations).mapInArrow(run, FORMATTED)


def report(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests read back from the formatted text alone: its turns, and its text under the loss mask."""
    template = template or Template()
    kinds = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean, violation string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {k: batch.column(k).to_pylist() for k in ("conv_id", "text", "segments", "valid", "violation")}
            out = []
            for text, segments in zip(cols["text"], cols["segments"], strict=True):
                turns = template.parse(text)
                loss = "".join(template.unescape(text[s["start"] : s["end"]]) for s in segments if s["loss"])
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            n, th, lc, lh, fc = ([x[k] for x in out] for k in range(5))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(n, pa.int64()), pa.array(th, pa.string()), pa.array(lc, pa.int64()), pa.array(lh, pa.string()), pa.array(fc, pa.int64()), batch.column("valid"), batch.column("violation")],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "violation"],
            )

    return formatted.select("conv_id", "text", "segments", "valid", "violation").mapInArrow(run, kinds)
