"""Chat formatting: a finite-state machine over roles, a declarative template, text segments with loss flags.

A template names the marks around a turn.  Control strings inside texts are escaped with a backslash and so is the
backslash itself, so that the formatted string can be read back without loss.  The machine's transitions say which role
may follow which; a conversation that breaks them is still formatted whole, with ``valid`` false and the first turn that
broke the order.

Null texts and roles count as empty.  Turns are ordered by (turn, role, text), so ties and repeated rows have one order
and stay.  Other columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweave.llm.shared import small_batches


@dataclass(frozen=True)
class Template:
    """Marks around turns, and the order of roles: state -> roles that may come next (the state after a turn is its role)."""

    open: str = "### "
    after_role: str = ":\n"
    close: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    order: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("start", ("system", "user")),
        ("system", ("user",)),
        ("user", ("assistant",)),
        ("assistant", ("user",)),
    )

    def controls(self) -> list[str]:
        return sorted({self.open, self.after_role, self.close.strip(), "\\"}, key=len, reverse=True)


DEFAULT = Template()
SEGMENTS = "array<struct<text:string,loss:boolean>>"


class Format:
    """Writes conversations by a template and reads them back."""

    def __init__(self, template: Template = DEFAULT):
        self.template = template
        self.control = re.compile("|".join(map(re.escape, template.controls())))
        self.escaped = re.compile(r"\\(.)", re.DOTALL)
        self.order = {state: set(roles) for state, roles in template.order}
        self.token = re.compile(r"\\.|" + "|".join(re.escape(x) for x in (template.open, template.after_role, template.close)), re.DOTALL)

    def escape(self, text: str) -> str:
        return self.control.sub(lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        return self.escaped.sub(lambda m: m[1], text)

    def broken_at(self, roles: list[str]) -> int | None:
        """Index of the first turn whose role may not follow."""
        state = "start"
        for i, role in enumerate(roles):
            if role not in self.order.get(state, ()):
                return i
            state = role
        return None

    def segments(self, turns: list[tuple[str, str]]) -> list[tuple[str, bool]]:
        """(text, whether the loss counts it) in output order; joined, the texts are the formatted conversation."""
        t, out = self.template, []
        for role, text in turns:
            out.append((t.open + self.escape(role) + t.after_role, False))
            out.append((self.escape(text), role in t.loss_roles))
            out.append((t.close, False))
        return out

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """The turns of a formatted string, by a machine of three states: between turns, in a role, in a text."""
        t, state, begin, role, turns = self.template, "between", 0, "", []
        for m in self.token.finditer(formatted):
            if m[0].startswith("\\"):
                continue
            if state == "between" and m[0] == t.open:
                state, begin = "role", m.end()
            elif state == "role" and m[0] == t.after_role:
                role, state, begin = self.unescape(formatted[begin : m.start()]), "text", m.end()
            elif state == "text" and m[0] == t.close:
                turns.append((role, self.unescape(formatted[begin : m.start()])))
                state = "between"
            else:
                raise ValueError(f"unexpected {m[0]!r} at {m.start()} in state {state}")
        if state != "between":
            raise ValueError(f"ends in state {state}")
        return turns


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role,text>> in order."""
    empty = F.lit("")
    row = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows")).select("conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns"))


def format_conversations(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, formatted string, segments with loss flags, valid, broken_at (index of the first turn out of order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = Format(template)
        parts_kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
        for batch in batches:
            texts, parts, broken = [], [], []
            for own in batch.column(1).to_pylist():
                pairs = [(r["role"], r["text"]) for r in own]
                segments = form.segments(pairs)
                texts.append("".join([p for p, _ in segments]))
                parts.append([{"text": p, "loss": flag} for p, flag in segments])
                broken.append(form.broken_at([r for r, _ in pairs]))
            columns = [batch.column(0), pa.array(texts, pa.string()), pa.array(parts, parts_kind), pa.array([b is None for b in broken], pa.bool_()), pa.array(broken, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "formatted", "segments", "valid", "broken_at"])

    small_batches(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType.simpleString()
    return conversations(turns).mapInArrow(run, f"conv_id {kind}, formatted string, segments {SEGMENTS}, valid boolean, broken_at int")


def read_back(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """What the formatted strings and their segments hold, one row per conversation, with digests."""

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = Format(template)
        for batch in batches:
            turns = [form.read(text) for text in batch.column(1).to_pylist()]
            losses = ["".join([form.unescape(p["text"]) for p in parts if p["loss"]]) for parts in batch.column(2).to_pylist()]
            wholes = ["".join([f"{role}\n{said}\n" for role, said in own]) for own in turns]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(own) for own in turns], pa.int64()),
                    pa.array([digest(x) for x in wholes], pa.string()),
                    pa.array([len(x) for x in losses], pa.int64()),
                    pa.array([digest(x) for x in losses], pa.string()),
                    pa.array([len(x) for x in batch.column(1).to_pylist()], pa.int64()),
                    batch.column(3),
                ],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"],
            )

    small_batches(formatted.sparkSession)
    kind = formatted.schema["conv_id"].dataType.simpleString()
    columns = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean"
    return formatted.select("conv_id", "formatted", "segments", "valid").mapInArrow(run, columns)
