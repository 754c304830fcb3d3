"""Chat formatting into budgeted, turn-aligned windows.

A conversation's turns are written with a template that marks each turn and
its role; a window holds whole turns. Running sums of the turns' tokens choose
the spans: a window takes turns while system turn, repeated history and new
turns stay within ``budget`` tokens. Every window begins with the system turn
(if the conversation opens with one) and with the last turns before it, as many
as ``history`` tokens allow. Loss falls on the texts of new assistant turns
only: what a window repeats is masked, so each assistant text counts once. A
turn that alone exceeds the budget gets a window of its own, whole.

Escapes: inside texts and roles ``\\`` becomes ``\\\\`` and ``<`` becomes
``\\l`` (in roles also ``>`` becomes ``\\g``), so the template's marks never
occur in a text, and reading back is exact.

Scale: turns are dealt by conversation and block of ``BLOCK`` turn numbers and
streamed in order, so memory holds one window and a conversation of any length
spreads over many tasks; a window never crosses a block, and a block's first
window repeats the system turn only. Digests of whole conversations
(``digests``) are one pass in order per conversation, with constant memory,
because SHA-256 is sequential.

Defined results: turns are ordered by turn number (null first), then role and
text; repeated rows are turns of their own. Null texts and roles are empty.
A system turn that opens
a block is kept through the block. A null conversation id is a conversation. Other columns of the input are not
read. An empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = r"[^\x20\x09-\x0D]+"
BLOCK = 4096
#: tokens that a turn's marks count for
MARKS = 2
_TURN = re.compile(r"<turn ([^<>]*)>([^<]*)</turn>\n")
_BACK = {"\\": "\\", "l": "<", "g": ">"}

WINDOWS = ("conv_id bigint, block bigint, window bigint, text string, loss array<struct<start:bigint,end:bigint>>, "
           "n_repeated bigint, n_new bigint, n_tokens bigint")
_WINDOWS = pa.schema([
    ("conv_id", pa.int64()), ("block", pa.int64()), ("window", pa.int64()), ("text", pa.string()),
    ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("n_repeated", pa.int64()),
    ("n_new", pa.int64()), ("n_tokens", pa.int64())])


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text, flags=re.S)


def render(role: str, text: str) -> tuple[str, int]:
    """A turn in the template, and the offset of its text."""
    head = f"<turn {escape(role).replace('>', chr(92) + 'g')}>"
    return f"{head}{escape(text)}</turn>\n", len(head)


def parse(window: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a window."""
    out, at = [], 0
    for m in _TURN.finditer(window):
        if m.start() != at:
            raise ValueError("text outside turns")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(window):
        raise ValueError("text outside turns")
    return out


@dataclass
class Packer:
    """Builds the windows of one block of a conversation, turn by turn. A turn
    is (role, text, tokens); ``system`` is the turn that every window repeats."""
    budget: int
    history: int
    system: tuple | None = None
    opening: tuple | None = None                        # a system turn met as the block's first
    repeated: list = field(default_factory=list)
    new: list = field(default_factory=list)
    prefix: list = field(default_factory=lambda: [0])   # running sums over system, repeated and new turns

    def _begin(self, turn: tuple) -> None:
        """Starts a window before ``turn``: the longest run of last turns that
        fits both the history's share and the budget."""
        past = self.repeated + self.new
        if self.opening:
            self.system, self.opening, past = self.opening, None, past[1:]
        room = self.budget - turn[2] - (self.system[2] if self.system else 0)
        sums = [0]
        for t in reversed(past):
            sums.append(sums[-1] + t[2])
        keep = sum(s <= min(self.history, room) for s in sums[1:])
        self.repeated, self.new, self.prefix = past[len(past) - keep:], [], [0]
        for t in [*([self.system] if self.system else []), *self.repeated]:
            self.prefix.append(self.prefix[-1] + t[2])

    def add(self, turn: tuple) -> dict | None:
        """Takes a turn; gives the window that it closes, if any."""
        done = None
        if self.new and self.prefix[-1] + turn[2] > self.budget:
            done = self.window()
            self._begin(turn)
        elif not self.new:                              # the block's first turn
            if self.system:
                self.prefix.append(self.system[2])
            elif turn[0] == "system":
                self.opening = turn
        self.new.append(turn)
        self.prefix.append(self.prefix[-1] + turn[2])
        return done

    def window(self) -> dict | None:
        """The window of the turns taken since the last one."""
        if not self.new:
            return None
        shown = [*([self.system] if self.system else []), *self.repeated]
        parts, loss, at = [], [], 0
        for i, (role, text, _) in enumerate([*shown, *self.new]):
            piece, head = render(role, text)
            if i >= len(shown) and role == "assistant":
                loss.append({"start": at + head, "end": at + head + len(escape(text))})
            parts.append(piece)
            at += len(piece)
        return {"text": "".join(parts), "loss": loss, "n_repeated": len(shown), "n_new": len(self.new),
                "n_tokens": self.prefix[-1]}


def _tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORDS)).cast("bigint") + MARKS


def _batches(batches, size: int = 256) -> Iterator[dict]:
    """The rows of Arrow batches, a few at a time in Python form."""
    for batch in batches:
        for a in range(0, batch.num_rows, size):
            yield from batch.slice(a, size).to_pylist()


def windows(df: DataFrame, budget: int = 2048, history: int = 512, conv_col: str = "conv_id", turn_col: str = "turn",
            role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The windows of all conversations (``WINDOWS``). ``loss`` holds the
    character ranges of ``text`` that are trained on; the first ``n_repeated``
    turns of a window repeat earlier ones."""
    c = lambda name: F.col(f"`{name}`")
    turns = df.select(c(conv_col).cast("bigint").alias("conv_id"), c(turn_col).cast("bigint").alias("turn"),
                      F.coalesce(c(role_col).cast("string"), F.lit("")).alias("role"),
                      F.coalesce(c(text_col).cast("string"), F.lit("")).alias("text"))
    turns = turns.withColumn("tokens", _tokens(F.col("text"))).withColumn(
        "block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 52))))
    # the opening system turn goes to the conversation's other blocks as well
    blocks = turns.groupBy("conv_id", "block").agg(F.min(F.struct("turn", "role", "text", "tokens")).alias("first"))
    opening = blocks.groupBy("conv_id").agg(F.min_by("first", "block").alias("s"), F.min("block").alias("own")).where(
        "s.role = 'system'").select(F.col("conv_id").alias("c"), "s", "own")
    copies = blocks.select("conv_id", "block").join(opening, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") != F.col("own")))
    copies = copies.select("conv_id", F.lit(None).cast("bigint").alias("turn"), "s.role", "s.text", "s.tokens", "block", F.lit(0).alias("own"))
    dealt = turns.withColumn("own", F.lit(1)).unionByName(copies).repartition("conv_id", "block").sortWithinPartitions(
        "conv_id", "block", "own", F.col("turn").asc_nulls_first(), "role", "text")
    dealt = dealt.select("conv_id", "block", "own", "role", "text", "tokens")

    def pack(batches):
        key, packer, number, out, held = None, None, 0, [], 0

        def note(done):
            nonlocal number, held
            if done:
                out.append({"conv_id": key[0], "block": key[1], "window": number, **done})
                number += 1
                held += len(done["text"])

        for r in _batches(batches):
            if key != (r["conv_id"], r["block"]):
                if packer:
                    note(packer.window())
                key, packer, number = (r["conv_id"], r["block"]), Packer(budget, history), 0
            turn = r["role"], r["text"], r["tokens"]
            if r["own"]:
                note(packer.add(turn))
            else:
                packer.system = turn
            if held > 4 << 20:
                yield pa.RecordBatch.from_pylist(out, _WINDOWS)
                out, held = [], 0
        if packer:
            note(packer.window())
        if out:
            yield pa.RecordBatch.from_pylist(out, _WINDOWS)

    return dealt.mapInArrow(pack, WINDOWS)


def digests(formatted: DataFrame) -> DataFrame:
    """Reads windows back: per conversation its turns (``n_turns``,
    ``turns_sha256`` of role, newline, text, newline), the unescaped text under
    the loss mask (``loss_chars``, ``loss_sha256``) and ``formatted_chars``."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "block", "window")
    dealt = dealt.select("conv_id", "text", "loss", "n_repeated")

    def read(batches):
        row, turns, loss, out = None, None, None, []

        def close():
            if row:
                out.append({**row, "turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()})

        for r in _batches(batches, 32):
            if row is None or row["conv_id"] != r["conv_id"]:
                close()
                row = {"conv_id": r["conv_id"], "n_turns": 0, "loss_chars": 0, "formatted_chars": 0}
                turns, loss = hashlib.sha256(), hashlib.sha256()
            new = parse(r["text"])[r["n_repeated"]:]
            for role, text in new:
                turns.update(f"{role}\n{text}\n".encode())
            for x in r["loss"]:
                text = unescape(r["text"][x["start"]:x["end"]])
                row["loss_chars"] += len(text)
                loss.update(text.encode())
            row["n_turns"] += len(new)
            row["formatted_chars"] += len(r["text"])
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return dealt.mapInArrow(read, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                                  "loss_sha256 string, formatted_chars bigint")
