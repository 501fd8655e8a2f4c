"""Chat formatting by a finite-state machine over roles.

A template declares how each role's turn is marked, which turns carry loss and which role
may follow which. Turns are read in order, checked against the machine and written as
segments with a loss flag each. Inside texts every character that could begin a control
string is escaped, so the output can be read back to the same turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN = "<begin>"


@dataclass(frozen=True)
class Template:
    """``{role}`` stands for the turn's role in ``before``. ``follows``: what may come after
    a state; the state is the last known role. ``ends``: states a conversation may end in."""

    before: str = "### {role}: "
    after: str = "</turn>\n"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            BEGIN: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)
        }
    )
    ends: frozenset[str] = frozenset({"assistant"})
    #: first characters of control strings and the escape character itself
    special: str = "\\#<:"

    def escape(self, text: str) -> str:
        return re.sub(f"[{re.escape(self.special)}]", lambda m: "\\" + m[0], text)

    def turn_pattern(self) -> re.Pattern:
        escaped = rf"([^{re.escape(self.special)}]*(?:\\.[^{re.escape(self.special)}]*)*)"
        before = re.escape(self.before).replace(re.escape("{role}"), escaped)
        return re.compile(before + escaped + re.escape(self.after), re.DOTALL)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


SEGMENTS = "conv_id long, turn long, segment long, text string, loss boolean, allowed boolean"


class Machine:
    """Walks the roles of one conversation; a turn out of order leaves it at that turn's role."""

    def __init__(self, template: Template):
        self.template, self.state = template, BEGIN

    def step(self, role: str) -> bool:
        allowed = role in self.template.follows.get(self.state, ())
        if role in self.template.follows:
            self.state = role
        return allowed


def _segments(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, machine, n = object(), Machine(template), 0
        for batch in batches:
            rows: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")]
            for conv, turn, role, text in zip(*columns, strict=True):
                if conv != at:
                    at, machine, n = conv, Machine(template), 0
                allowed = machine.step(role)
                for piece, loss in (
                    (template.before.replace("{role}", template.escape(role)), False),
                    (template.escape(text), role in template.loss_roles),
                    (template.after, False),
                ):
                    rows.append((conv, turn, n, piece, loss, allowed))
                    n += 1
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()), strict=True)],
                    names=["conv_id", "turn", "segment", "text", "loss", "allowed"],
                )

    return run


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments ``conv_id, turn, segment, text, loss, allowed`` of every turn, in order of each
    conversation within its partition.

    Turns go by ``turn`` (null first), equal ones by role and text. Null role and text count
    as empty; null conversation ids are one conversation. ``allowed`` tells whether the turn
    may follow the one before. Nothing is dropped: a conversation out of order is formatted
    all the same. Rows are sorted by Spark and walked one by one, so a conversation of any
    length needs no more memory than one turn. Other columns are ignored.
    """
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_segments(template or Template()), SEGMENTS)


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, valid boolean, complete boolean"
)


class Reader:
    """Reads one conversation's output back, segment by segment; holds one turn at most."""

    def __init__(self, template: Template):
        self.pattern = template.turn_pattern()
        self.machine, self.valid, self.template = Machine(template), True, template
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.pending: list[str] = []

    def add(self, text: str, loss: bool) -> None:
        self.chars += len(text)
        self.pending.append(text)
        if loss:
            plain = unescape(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        if text.endswith(self.template.after):
            whole = self.pattern.fullmatch("".join(self.pending))
            if whole:
                role, body = unescape(whole[1]), unescape(whole[2])
                self.turns.update(f"{role}\n{body}\n".encode())
                self.valid &= self.machine.step(role)
                self.n_turns += 1
                self.pending = []

    def row(self, conv: int | None) -> tuple:
        if self.pending:
            raise ValueError(f"conversation {conv}: output does not read back")
        complete = self.valid and self.machine.state in self.template.ends
        return (
            conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid, complete,
        )


def _digests(template: Template):
    def record(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_())
        names = [c.split()[0] for c in DIGESTS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, reader = None, None
        for batch in batches:
            rows = []
            for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss")), strict=True):
                if reader is None or conv != at:
                    if reader is not None:
                        rows.append(reader.row(at))
                    at, reader = conv, Reader(template)
                reader.add(text, loss)
            if rows:
                yield record(rows)
        if reader is not None:
            yield record([reader.row(at)])

    return run


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation: what its segments read back to.

    ``segments`` as ``format_conversations`` gives them: a conversation's in one partition
    and in order. The digests are sequential by nature, so one conversation's segments
    stream through one task, in constant memory.
    """
    return segments.mapInArrow(_digests(template or Template()), DIGESTS)
