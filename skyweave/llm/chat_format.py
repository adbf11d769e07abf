"""Chat formatting: a finite-state machine over roles and a declarative template with loss flags.

The template gives each role a head, a tail and whether its text is trained on; `after` and `ends` are the machine's
transitions and final states.  The machine reads the roles turn by turn: each step validates the order and emits the
turn's segments with their loss flags, so the output and the verdict come from one walk.  A role that may not come next,
or that the template doesn't know, is a fault: the walk records the first one and goes on from there.  Inside texts the
escape character and every character of which control strings are made (<, [ and ]) gets an escape in front, so the
marks in the output are exactly the template's and `parse` reads the turns back.

Cases: a null text is empty, a null role is the role ``""``; a role that the template doesn't know is written with
its name by the template's `other` marks, without loss; conversations that break the turn order are formatted all
the same, with valid false and the first fault; a null turn comes first; turns that tie are ordered by role, then text;
a row with a null conv_id belongs to no conversation that could be told, so it is one of its own; long texts are written
whole; an empty table gives an empty table; columns besides conv_id, turn, role, text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks by role, (head, tail, loss); after: which roles may follow which, "" being the start; ends: roles that may come last."""

    roles: dict = field(default_factory=lambda: {"system": ("<s>[SYS] ", " [/SYS]", False), "user": ("<s>[INST] ", " [/INST]", False), "assistant": ("<s>[OUT] ", "</s>", True)})
    other: tuple[str, str, str] = ("<s>[ROLE:", "] ", " [/ROLE]")
    after: dict = field(default_factory=lambda: {"": {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}})
    ends: frozenset = frozenset({"assistant", "user"})
    escape: str = "\\"
    controls: tuple[str, ...] = ("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[OUT]", "[ROLE:", "[/ROLE]", "]")

    def hide(self, text: str) -> str:
        """Escaped so that no control string is left; `show` undoes it."""
        text = text.replace(self.escape, self.escape * 2)
        for first in sorted({c[0] for c in self.controls}):
            text = text.replace(first, self.escape + first)
        return text

    def show(self, text: str) -> str:
        out, i = [], 0
        while (k := text.find(self.escape, i)) >= 0:
            out += [text[i:k], text[k + 1 : k + 2]]
            i = k + 2
        return "".join([*out, text[i:]])


@dataclass
class Machine:
    """Walks over the roles of a conversation; state "" is the start."""

    template: Template
    state: str = ""
    turns: int = 0
    fault: str = ""

    def step(self, role: str, text: str) -> Iterator[tuple[str, bool]]:
        """The transition for a turn: its segments as (piece, under the loss mask); a transition that isn't in the table is a fault."""
        t = self.template
        if role not in t.after.get(self.state, ()) and not self.fault:
            self.fault = f"turn {self.turns}: {role or 'null'} after {self.state or 'start'}"
        head, tail, loss = t.roles[role] if role in t.roles else (t.other[0] + t.hide(role) + t.other[1], t.other[2], False)
        self.state, self.turns = role, self.turns + 1
        yield head, False
        yield t.hide(text), loss
        yield tail, False

    def verdict(self) -> str:
        """The first break of the turn order, or ''."""
        return self.fault or ("" if self.state in self.template.ends else f"ends with {self.state or 'nothing'}")


def bare(output: str, mark: str, at: int, escape: str) -> int:
    """Where the mark stands next, not escaped; -1 if nowhere."""
    while (k := output.find(mark, at)) >= 0:
        n = 0
        while k - n > 0 and output[k - n - 1] == escape:
            n += 1
        if n % 2 == 0:
            return k
        at = k + 1
    return -1


def parse(output: str, template: Template) -> list[tuple[str, str]]:
    """The turns that a Machine wrote."""
    turns, at = [], 0
    while at < len(output):
        for role, (head, tail, _) in template.roles.items():
            if output.startswith(head, at):
                at += len(head)
                break
        else:
            head, close, tail = template.other
            if not output.startswith(head, at):
                raise ValueError(f"no turn begins at {at}")
            end = bare(output, close, at + len(head), template.escape)
            role, at = template.show(output[at + len(head) : end]), end + len(close)
        end = bare(output, tail, at, template.escape)
        if end < 0:
            raise ValueError(f"the turn at {at} has no end")
        turns.append((role, template.show(output[at:end])))
        at = end + len(tail)
    return turns


FORMATTED = "conv_id long, formatted string, spans array<struct<start:long,length:long>>, valid boolean, fault string"


def format_conversations(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, formatted, spans of the loss mask (code points), valid, fault: one row per conversation."""
    template = template or Template()
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone")
    whole = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"), alone).groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns")).select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def work(batches):
        for b in batches:
            out = []
            for conv, roles, texts in zip(b["conv_id"].to_pylist(), b["roles"].to_pylist(), b["texts"].to_pylist()):
                pieces, spans, at, machine = [], [], 0, Machine(template)
                for role, text in zip(roles, texts):
                    for piece, loss in machine.step(role, text):
                        if loss:
                            spans.append({"start": at, "length": len(piece)})
                        at += len(piece)
                        pieces.append(piece)
                wrong = machine.verdict()
                out.append({"conv_id": conv, "formatted": "".join(pieces), "spans": spans, "valid": not wrong, "fault": wrong})
            kind = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), ("valid", pa.bool_()), ("fault", pa.string())])
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return whole.mapInArrow(work, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, fault string"


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """What the output says when it is read back: turns by `parse`, trained text by the spans."""
    template = template or Template()

    def work(batches):
        for b in batches:
            out = []
            for conv, text, spans, valid, fault in zip(b["conv_id"].to_pylist(), b["formatted"].to_pylist(), b["spans"].to_pylist(), b["valid"].to_pylist(), b["fault"].to_pylist()):
                turns = parse(text, template)
                loss = [template.show(text[s["start"] : s["start"] + s["length"]]) for s in spans]
                sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
                out.append({"conv_id": conv, "n_turns": len(turns), "turns_sha256": sha([x for r, t in turns for x in (r, "\n", t, "\n")]), "loss_chars": sum(map(len, loss)), "loss_sha256": sha(loss), "formatted_chars": len(text), "valid": valid, "fault": fault})
            kind = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_()), ("fault", pa.string())])
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return formatted.mapInArrow(work, DIGEST)
