"""Chat formatting: a finite-state machine over roles, and a declarative template with a loss flag per segment.

Turns of a conversation are brought together in order (one shuffle, sorted within partitions) and streamed: the
machine's state and the digests are all that is held per conversation, so a conversation of any length takes
constant memory. Each turn becomes three segments (head, escaped text, tail); control strings inside texts and roles
are escaped so that the output can be read back exactly. A conversation is worked in one task, as its order demands.

Order of turns: by turn (null first), then role, then text. A turn that the machine has no transition for is
formatted all the same and marked invalid, and the machine goes on from that turn's role if it knows it.

Defined results: a null text counts as empty, a null role as the role ``; null ids form one conversation; repeated
rows are turns of their own; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table


@dataclass(frozen=True)
class Template:
    """Declares how turns look and which roles' texts are trained on. open, shut and end must not occur escaped."""

    open: str = "<|"
    shut: str = "|>\n"
    end: str = "<|end|>\n"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    #: role before (None: start) -> roles that may follow.
    follows: dict[str | None, frozenset[str]] = field(
        default_factory=lambda: {
            None: frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user", "tool"}),
            "tool": frozenset({"assistant", "tool"}),
        }
    )

    def escape(self, text: str) -> str:
        """Without `<|`: a backslash doubles, and one goes between `<` and `|`."""
        return text.replace("\\", "\\\\").replace("<|", "<\\|")

    def escape_role(self, role: str) -> str:
        return role.replace("\\", "\\\\").replace("|", "\\|")

    def unescape(self, text: str) -> str:
        return re.sub(r"\\([\\|])", r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        return [(self.open + self.escape_role(role) + self.shut, False), (self.escape(text), role in self.loss_roles), (self.end, False)]

    def read(self, formatted: str) -> Iterator[tuple[str, str]]:
        """(role, text) of the turns in a formatted string; ValueError if it is not one."""
        turn = re.compile(r"<\|((?:[^\\|]|\\[\\|])*)\|>\n(.*?)<\|end\|>\n", re.S)
        at = 0
        while at < len(formatted):
            found = turn.match(formatted, at)
            if not found:
                raise ValueError("not a formatted turn")
            yield self.unescape(found[1]), self.unescape(found[2])
            at = found.end()


TEMPLATE = Template()
_SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
FORMATTED = "conv_id long, ordinal long, role string, segments array<struct<text:string,loss:boolean>>, valid boolean"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def _formatter(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, ordinal = object(), None, 0
        for batch in batches:
            ids, roles, texts = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))
            ordinals, segments, valid = [], [], []
            for c, role, text in zip(ids, roles, texts, strict=True):
                if c != conv:
                    conv, state, ordinal = c, None, 0
                valid.append(role in template.follows.get(state, ()))
                state = role if role in template.follows else state
                segments.append([{"text": t, "loss": x} for t, x in template.segments(role, text)])
                ordinals.append(ordinal)
                ordinal += 1
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(ordinals, pa.int64()), batch.column("role"), pa.array(segments, _SEGMENTS), pa.array(valid, pa.bool_())], names=["conv_id", "ordinal", "role", "segments", "valid"])

    return run


def format_chat(turns: DataFrame, template: Template = TEMPLATE, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn with its segments and loss flags; rows of a conversation lie together, in order."""
    small_batches(turns.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    rows = turns.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return rows.mapInArrow(_formatter(template), FORMATTED)


class _Digest:
    def __init__(self, conv: int | None) -> None:
        self.conv, self.turns, self.loss = conv, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.valid = True

    def row(self) -> tuple:
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid


def _reader(template: Template):
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d: _Digest | None = None
        for batch in batches:
            rows = []
            for c, segments, valid in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "segments", "valid")), strict=True):
                if d is None or d.conv != c:
                    if d is not None:
                        rows.append(d.row())
                    d = _Digest(c)
                formatted = "".join(s["text"] for s in segments)
                for role, text in template.read(formatted):
                    d.n += 1
                    d.turns.update(f"{role}\n{text}\n".encode())
                for s in segments:
                    if s["loss"]:
                        text = template.unescape(s["text"])
                        d.loss_chars += len(text)
                        d.loss.update(text.encode())
                d.chars += len(formatted)
                d.valid &= valid
            if rows:
                yield packed(rows)
        if d is not None:
            yield packed([d.row()])

    return run


def read_back(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Digests per conversation from what format_chat returns, by ordinal, in whatever order and files its rows lie: only the segments are read."""
    small_batches(formatted.sparkSession)
    rows = formatted.select("conv_id", "ordinal", "segments", "valid").repartition("conv_id").sortWithinPartitions("conv_id", "ordinal")
    return rows.mapInArrow(_reader(template), DIGESTS)


def op6(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return read_back(format_chat(turns.unionByName(extra)))
