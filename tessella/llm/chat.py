"""Chat formatting: conversations as training windows of a token budget, with loss spans.

A turn is ``<s>role\\ntext</s>\\n``. Prefix sums of the turns' tokens choose windows that begin
and end at turns. A window repeats the system turn and a limited history before its new
turns; only new assistant texts are under the loss mask, so each is a target once.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import bpe
from tessella.llm.common import pick

#: Tokens of a window; of the history it repeats at most; turn numbers of a segment, which
#: is formatted by one task, so that one endless conversation is dealt to many.
BUDGET, HISTORY, SEGMENT = 2048, 512, 1024
#: The segment of turns without a number, before that of any number.
FIRST = -(2**63)

#: Strings that models read as control, which texts must not hold as such.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_MARKS = re.compile("(<|\\[)(?=" + "|".join(re.escape(x[1:]) for x in CONTROL) + ")")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<s>(.*?)\n(.*?)</s>\n", re.S)


def escape(text: str) -> str:
    """The text with no control string left: ``\\`` doubled, and one put inside each control string."""
    return _MARKS.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _role(role: str) -> str:
    """A role on one line; a line break in it is escaped too."""
    return escape(role).replace("\n", "\\\x00")


def _unrole(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "\x00" else m[1], role)


@dataclass
class Turn:
    role: str
    text: str
    tokens: int = 0
    head: str = field(init=False)
    body: str = field(init=False)

    def __post_init__(self) -> None:
        self.head, self.body = f"<s>{_role(self.role)}\n", escape(self.text)

    def string(self) -> str:
        return f"{self.head}{self.body}</s>\n"


@dataclass
class Windows:
    """Chooses the windows of one segment as its turns come; holds no more than a window and its history."""

    budget: int
    history: int
    system: Turn | None = None
    turns: list[Turn] = field(default_factory=list)
    #: prefix[i]: the tokens of turns[:i]; turns[:new] were targets or context of windows before.
    prefix: list[int] = field(default_factory=lambda: [0])
    new: int = 0

    def add(self, turn: Turn) -> Iterator[dict]:
        context, _ = self._context(self.new)
        total = sum(x.tokens for x in context) + self.prefix[-1] - self.prefix[self.new] + turn.tokens
        if self.new < len(self.turns) and total > self.budget:
            yield self._window()
        self.turns.append(turn)
        self.prefix.append(self.prefix[-1] + turn.tokens)
        if turn.role == "system" and self.system is None:
            self.system = turn

    def _context(self, at: int) -> tuple[list[Turn], int]:
        """What a window whose new turns begin at ``at`` repeats: the system turn, then the last
        turns within the history's budget, as far as the first new turn still fits."""
        need = self.turns[at].tokens if at < len(self.turns) else 0
        system = [self.system] if self.system is not None and all(x is not self.system for x in self.turns[at:]) else []
        left = min(self.history, self.budget - need - sum(x.tokens for x in system))
        first = bisect_left(self.prefix, self.prefix[at] - left, 0, at) if left > 0 else at
        return system + [x for x in self.turns[first:at] if x is not self.system], first

    def _window(self) -> dict:
        context, first = self._context(self.new)
        fresh = self.turns[self.new :]
        out, at, loss = [], 0, []
        for i, x in enumerate([*context, *fresh]):
            if i >= len(context) and x.role == "assistant":
                loss.append({"start": at + len(x.head), "end": at + len(x.head) + len(x.body)})
            out.append(x.string())
            at += len(out[-1])
        tokens = sum(x.tokens for x in [*context, *fresh])
        # only what the next window may repeat stays
        keep = bisect_left(self.prefix, self.prefix[-1] - self.history)
        self.turns, self.prefix = self.turns[keep:], [p - self.prefix[keep] for p in self.prefix[keep:]]
        self.new = len(self.turns)
        return {"formatted": "".join(out), "loss": loss, "n_context": len(context), "n_turns": len(fresh), "n_tokens": tokens}

    def end(self) -> Iterator[dict]:
        if self.new < len(self.turns):
            yield self._window()


COLUMNS = "segment bigint, window bigint, formatted string, loss array<struct<start:bigint,end:bigint>>, n_context bigint, n_turns bigint, n_tokens bigint"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.int64(), pa.int64(), pa.int64()]


def format_windows(
    conversations: DataFrame,
    rank_file: str,
    pattern: str,
    budget: int = BUDGET,
    history: int = HISTORY,
    segment: int = SEGMENT,
) -> DataFrame:
    """Rows (conv_id, turn, role, text) as windows: (conv_id, segment, window, formatted, loss, n_context, n_turns, n_tokens).

    ``loss`` lists spans of ``formatted`` in code points; the first ``n_context`` of its turns are
    repeated and masked. A turn of more tokens than the budget is a window of its own with
    the system turn, uncut. Turns are in the order of turn (nulls first), then role, then
    text; repeated rows are turns like others. Null roles and texts are empty. The system
    turn is a conversation's first turn of that role; windows after it repeat it.
    History doesn't reach over a segment's start.
    """
    rows = pick(conversations, "conv_id", "turn", "role", "text").select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / segment).cast("bigint"), F.lit(FIRST)).alias("segment"),
        F.lit(1).alias("kind"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    first = rows.where("role = 'system'").groupBy(F.col("conv_id").alias("c")).agg(F.min(F.struct("segment", "turn", "text")).alias("s"))
    later = rows.select("conv_id", "segment").distinct().join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") > F.col("s.segment")))
    carried = later.select("conv_id", "segment", F.lit(0).alias("kind"), F.col("s.turn").alias("turn"), F.lit("system").alias("role"), F.col("s.text").alias("text"))
    dealt = rows.unionByName(carried).repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "kind", "turn", "role", "text")
    coder = bpe._coder(dealt, rank_file, pattern)
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = coder()
        at, chosen, number = None, None, 0
        rows: list[list] = []
        size = 0

        def out() -> pa.RecordBatch:
            arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate([key_type, *_TYPES])]
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "segment", "window", "formatted", "loss", "n_context", "n_turns", "n_tokens"])

        def keep(made: Iterator[dict]) -> None:
            nonlocal number, size
            for w in made:
                rows.append([*at, number, *w.values()])
                number += 1
                size += len(w["formatted"])

        for batch in batches:
            key_type = batch.column(0).type
            for conv, seg, is_turn, _, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (conv, seg):
                    if chosen is not None:
                        keep(chosen.end())
                    at, chosen, number = (conv, seg), Windows(budget, history), 0
                turn = Turn(role, text)
                turn.tokens = len(bpe.encode_text(encoding, turn.string()))
                if is_turn:
                    keep(chosen.add(turn))
                else:
                    chosen.system = turn
                if size > 4 << 20:
                    yield out()
                    rows, size = [], 0
        if chosen is not None:
            keep(chosen.end())
        if rows:
            yield out()

    return dealt.mapInArrow(run, f"conv_id {kind}, {COLUMNS}")


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window."""
    return [(_unrole(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def digest(windows: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its windows alone.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars). A digest
    over a conversation is a sum in order, so its windows pass one task; they stream
    through it and none is kept.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    rows = windows.select("conv_id", "segment", "window", "formatted", "loss", "n_context")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "window")
    kind = windows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        at = state = None
        for batch in batches:
            key_type = batch.column(0).type
            for conv, _, _, text, loss, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or at != conv:
                    if state is not None:
                        found.append((at, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                    at, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parse(text)[context:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                for span in loss:
                    body = unescape(text[span["start"] : span["end"]])
                    state[2] += len(body)
                    state[3].update(body.encode())
                state[4] += len(text)
            if len(found) > 10_000:
                yield table(found, key_type)
                found = []
        if state is not None:
            found.append((at, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
            yield table(found, key_type)

    def table(found: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        types = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(types)], names=names)

    return rows.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
