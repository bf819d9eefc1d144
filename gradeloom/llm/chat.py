r"""Chat formatting with a grammar round trip.

A conversation is a run of turns, ``<|im_start|>role\ntext<|im_end|>\n``.  The grammar allows
no control string inside a role or text, whether of this template or of another in common
use.  A turn is rendered as it is, reparsed by the grammar's deterministic parser and
compared; where turn and reparse differ, its conflicting content is escaped and that is tried
again until they are identical.  Escaping puts one more backslash after the first character
of each control string, also of those that have backslashes there already, so taking one
away is its exact inverse; the parser does so in every text.  A role that would not come back
is written as ``=`` and a JSON string.

Turns are rendered where they lie, then sorted by conversation into files of formatted text
with an index of byte ranges; a task holds one turn at a time, however long a conversation.

Cases: a null text is empty, a null role is the empty role.  A null conv_id is a conversation.
Turns go by turn (null first), then role and text, so repeated rows are turns each.  No rows:
no conversations.  Only texts of the role ``assistant`` are under the loss mask.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.shared import NewFile, batch, file_system, shared_dir, written

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = (START, END, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLE = "assistant"
_TOKEN = re.compile("|".join(re.escape(c) for c in CONTROL))
_LIKE = re.compile("|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in CONTROL))
_ESCAPED = re.compile("|".join(rf"{re.escape(c[0])}\\+{re.escape(c[1:])}" for c in CONTROL))


class NotChat(ValueError):
    """Text that the grammar does not allow."""


def escape(text: str) -> str:
    return _LIKE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def render(role: str, text: str) -> str:
    return f"{START}{role}\n{text}{END}\n"


def parse(segment: str) -> list[tuple[str, str, int, int]]:
    """The turns of formatted text: role, text, and where the (escaped) text lies."""
    turns, at = [], 0
    while at < len(segment):
        if not segment.startswith(START, at):
            raise NotChat(f"no turn begins at {at}")
        line = segment.find("\n", at)
        if line < 0:
            raise NotChat("a role has no end")
        role = segment[at + len(START) : line]
        if _TOKEN.search(role):
            raise NotChat("a control string in a role")
        if role.startswith("="):
            try:
                role = json.loads(role[1:])
            except ValueError as e:
                raise NotChat("a role that isn't JSON") from e
        end = _TOKEN.search(segment, line + 1)
        if not end or end[0] != END or segment[end.end() : end.end() + 1] != "\n":
            raise NotChat("a text is not ended by its turn's end")
        turns.append((role, unescape(segment[line + 1 : end.start()]), line + 1, end.start()))
        at = end.end() + 1
    return turns


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn that reparses to exactly this role and text, and where its text lies."""
    shown, body = role, text
    for _ in range(4):
        segment = render(shown, body)
        try:
            found = parse(segment)
        except NotChat:
            found = []
        if len(found) == 1 and found[0][:2] == (role, text):
            return segment, found[0][2], found[0][3]
        try:
            alone = [t[0] for t in parse(render(shown, ""))]
        except NotChat:
            alone = []
        if alone != [role]:
            shown = "=" + json.dumps(role).replace("<", "\\u003c").replace("[", "\\u005b")
        else:
            body = escape(body)
    raise AssertionError("escaping did not settle")


def _render(batches):
    for b in batches:
        segments, begin, end = [], [], []
        for role, text in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
            segment, first, last = format_turn(role, text)
            segments.append(segment)
            begin.append(first if role == LOSS_ROLE else None)
            end.append(last if role == LOSS_ROLE else None)
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), b.column("role"), pa.array(segments, pa.string()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())], names=["conv_id", "turn", "role", "segment", "loss_start", "loss_end"])


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and segment (the formatted turn) of each row, with the span of the
    segment that is under the loss mask; a conversation's text is its segments in order."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_render, "conv_id long, turn long, role string, segment string, loss_start long, loss_end long")


INDEX = pa.schema([("conv_id", pa.int64()), ("file", pa.string()), ("begin", pa.int64()), ("bytes", pa.int64())])


def write_chat(turns: DataFrame, path: str) -> DataFrame:
    """Writes formatted conversations to files; returns each one's file and byte range."""

    def run(batches):
        out, at, conv, index = None, 0, (), [[], [], [], []]
        task = TaskContext.get()
        file = f"{path}/chat-{task.partitionId():06d}.txt"
        for b in batches:
            for conv_id, segment in zip(b.column("conv_id").to_pylist(), b.column("segment").to_pylist(), strict=True):
                if out is None:
                    out = NewFile(file)
                if conv != (conv_id,):
                    conv = (conv_id,)
                    for column, x in zip(index, (conv_id, file, at, 0), strict=True):
                        column.append(x)
                data = segment.encode()
                out.write(data)
                at += len(data)
                index[3][-1] += len(data)
        if out is not None:
            out.close()
            yield batch(INDEX, index)

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "segment")]
    placed = format_turns(turns).select("conv_id", "turn", "role", "segment").repartition("conv_id").sortWithinPartitions(*order)
    return written(placed.mapInArrow(run, "conv_id long, file string, begin long, bytes long"))


def stream(file: str, begin: int, size: int, step: int = 1 << 20):
    """(role, text, escaped text's length, formatted length) of the turns in a byte range."""
    files, path = file_system(file)
    decode = codecs.getincrementaldecoder("utf-8")().decode
    mark = END + "\n"
    with files.open_input_file(path) as f:
        f.seek(begin)
        held: list[str] = []
        tail = ""
        while size > 0:
            data = f.read(min(step, size))
            if not data:
                raise NotChat(f"{file} is too short")
            size -= len(data)
            chunk = tail + decode(data, final=size <= 0)
            *whole, tail = chunk.split(mark)
            for piece in whole:
                held.append(piece + mark)
                segment = "".join(held)
                held = []
                (turn,) = parse(segment)
                yield turn[0], turn[1], len(segment)
            # a turn that goes on: all but what may be the start of its end
            if len(tail) > step:
                held.append(tail[: -len(mark)])
                tail = tail[-len(mark) :]
        if held or tail:
            raise NotChat(f"{file} ends inside a turn")


DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_chat(spark: SparkSession, index: DataFrame) -> DataFrame:
    """What the parser finds in the files: a row for each conversation."""

    def run(batches):
        for b in batches:
            rows: list[list] = [[] for _ in DIGEST]
            for conv_id, file, begin, size in zip(*(b.column(c).to_pylist() for c in ("conv_id", "file", "begin", "bytes")), strict=True):
                turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for role, text, length in stream(file, begin, size):
                    turns.update(f"{role}\n{text}\n".encode())
                    if role == LOSS_ROLE:
                        loss.update(text.encode())
                        loss_chars += len(text)
                    n += 1
                    chars += length
                for column, x in zip(rows, (conv_id, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars), strict=True):
                    column.append(x)
            yield batch(DIGEST, rows)

    return index.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chat_digests(turns: DataFrame) -> DataFrame:
    """Writes conversations to a shared folder, formatted, and reads them back."""
    spark = turns.sparkSession
    return read_chat(spark, write_chat(turns, shared_dir(spark)))
