"""Chat formatting by prefix-target expansion (operator 3).

Every assistant turn becomes an example of its own: all preceding turns of the conversation
are context, and only that reply is trainable.

* ``expand``: one row an assistant turn: ``context``, all formatted turns before it, ``reply``, the
  formatted reply, and the span of the loss mask in both together; ``fresh`` is the end of the
  context that no earlier row of the conversation has.  Where no reply follows the last turns, a row
  without one has the whole conversation as its context;
* ``examples``: the rows with a reply, for writing training files;
* ``read_back``: reads conversations and loss masks back from these contexts and replies.

Rows grow with the turns.  Their characters grow with the replies of a conversation times its length,
because every example repeats its context; that is what the expansion is for.

The template marks turns by control strings.  A backslash after the first character of
every control string inside a text, and before every backslash, takes their meaning
away.  ``Reader`` finds turns, roles and texts by the control strings alone.

One conversation is read by one task, because its digest is sequential, but as a stream: a
task holds one example, a batch of them has less than ``FRESH`` characters or is one example.

Defined cases: null texts are empty; a null role is read back as an empty one; roles
other than user, assistant and system get a marker with their name; turns are ordered
by turn (null first), then role and text; repeated turns stay, each counts; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters from which on a batch of examples is given out.
FRESH = 1 << 20

#: The control strings of the template.
USER, USER_END = "<s>[INST] ", " [/INST]"
REPLY, REPLY_END = "<s>[OUT] ", " </s>"
SYSTEM, SYSTEM_END = "<<SYS>> ", " <</SYS>>"
OTHER, OTHER_MID, OTHER_END = "<<ROLE ", ">> ", " <</ROLE>>"
_CONTROL = r"([<\[])(?=s>|/s>|INST\]|/INST\]|OUT\]|<SYS>>|</SYS>>|<ROLE |</ROLE>>)"


def escaped(text: Column) -> Column:
    twice = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(twice, _CONTROL, r"$1\\")


def formatted(role: Column, text: Column) -> Column:
    body, role = escaped(F.coalesce(text, F.lit(""))), F.coalesce(role, F.lit(""))
    # the name of a role must not hold the end of its marker
    name = F.regexp_replace(escaped(role), ">", r">\\")
    return (
        F.when(role == "user", F.concat(F.lit(USER), body, F.lit(USER_END)))
        .when(role == "assistant", F.concat(F.lit(REPLY), body, F.lit(REPLY_END)))
        .when(role == "system", F.concat(F.lit(SYSTEM), body, F.lit(SYSTEM_END)))
        .otherwise(F.concat(F.lit(OTHER), name, F.lit(OTHER_MID), body, F.lit(OTHER_END)))
    )


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


class Reader:
    """Turns of a formatted conversation that comes in pieces cut anywhere."""

    def __init__(self) -> None:
        self.tail = ""

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        """(role, text) of the turns that end in what came so far."""
        self.tail += text
        at = 0
        for role, begin, end in iter(lambda: self._turn(at), None):
            body = self.tail[begin : end[0]]
            at = end[1]
            yield role, unescaped(body)
        self.tail = self.tail[at:]

    def _turn(self, at: int) -> tuple[str, int, tuple[int, int]] | None:
        """Role, begin of the text, end of the text and of the turn, if it is whole."""
        for opening, closing, role in ((USER, USER_END, "user"), (REPLY, REPLY_END, "assistant"), (SYSTEM, SYSTEM_END, "system"), (OTHER, OTHER_END, None)):
            if self.tail.startswith(opening, at):
                begin = at + len(opening)
                if role is None:
                    mid = self.tail.find(OTHER_MID, begin)
                    if mid < 0:
                        return None
                    role, begin = unescaped(self.tail[begin:mid].replace(">\\", ">")), mid + len(OTHER_MID)
                end = self.tail.find(closing, begin)
                return (role, begin, (end, end + len(closing))) if end >= 0 else None
        return None


_EXAMPLE = pa.schema([("conv_id", pa.int64()), ("target", pa.int64()), ("context", pa.string()), ("fresh", pa.string()), ("reply", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
_EXAMPLE_DDL = "conv_id bigint, target bigint, context string, fresh string, reply string, loss_start bigint, loss_end bigint"


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += size(row)
        if len(held) >= 1024 or weight >= FRESH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def expand(df: DataFrame) -> DataFrame:
    """df(conv_id, turn, role, text) -> the examples, those of a conversation in order in one partition.

    target is the place of the reply among the turns; the row of last turns without a reply has none."""

    def examples_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, place, context, fresh = None, -1, "", []
        for batch in batches:
            for conv_id, is_reply, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if place >= 0 and conv_id != conv:
                    if fresh:
                        yield conv, None, context + "".join(fresh), "".join(fresh), None, None, None
                    place, context, fresh = -1, "", []
                conv, place = conv_id, place + 1
                if is_reply:
                    added = "".join(fresh)
                    context += added
                    yield conv, place, context, added, piece, len(context) + len(REPLY), len(context) + len(piece) - len(REPLY_END)
                    context, fresh = context + piece, []
                else:
                    fresh.append(piece)
        if fresh:
            yield conv, None, context + "".join(fresh), "".join(fresh), None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(examples_of(batches), _EXAMPLE, lambda r: len(r[2]) + len(r[3]) + len(r[4] or ""))

    rows = df.select("conv_id", "turn", "role", "text", formatted(F.col("role"), F.col("text")).alias("piece"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", (F.coalesce("role", F.lit("")) == "assistant").alias("is_reply"), "piece").mapInArrow(run, _EXAMPLE_DDL)


def examples(expanded: DataFrame) -> DataFrame:
    """conv_id, target, context, reply, loss_start, loss_end: the training examples among the rows of ``expand``."""
    return expanded.where(F.col("target").isNotNull()).select("conv_id", "target", "context", "reply", "loss_start", "loss_end")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of ``expand`` with whether a conversation begins: its first row adds all the context it has."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = [c[k].as_py() for c in batch.columns]
            yield *row, len(row[2]) == len(row[3])


def read_back(expanded: DataFrame) -> DataFrame:
    """Digests of what the examples say: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Takes the rows of ``expand`` as they come.  Turns are found by the control strings in context and
    reply, the trainable text by the loss span of each example; a context that is not what the example before it
    says, and what is fresh, is an error."""
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        state: list | None = None

        def result() -> tuple:
            conv, n, turns, loss, losses, whole, reader = state
            if reader.tail:
                raise ValueError(f"conversation {conv} ends within a turn")
            return conv, n, turns.hexdigest(), loss, losses.hexdigest(), len(whole)

        for conv_id, target, context, fresh, reply, start, end, begins in _rows(batches):
            if begins:
                if state is not None:
                    yield result()
                state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), "", Reader()]
            before = len(state[5])
            if before + len(fresh) != len(context) or not context.startswith(state[5]) or not context.endswith(fresh):
                raise ValueError(f"conversation {conv_id}: context of {len(context)} characters, {before} were read and {len(fresh)} are fresh")
            whole = context + (reply or "")
            for role, body in state[6].feed(whole[before:]):
                state[1] += 1
                state[2].update(f"{role}\n{body}\n".encode())
            state[5] = whole
            if target is not None:
                trained = unescaped(whole[start:end])
                state[3] += len(trained)
                state[4].update(trained.encode())
        if state is not None:
            yield result()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(told(batches), pa.schema(list(zip(names, kinds))), lambda r: 200)

    return expanded.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
