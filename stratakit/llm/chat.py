"""Chat formatting by columnar byte assembly.

A conversation's turns become one string: a header that names the role, the
escaped text, an end mark.  For a batch of turns the segments' lengths are known
before anything is copied; their cumulative sums are the offsets, and headers and
texts are scattered into one preallocated buffer, which becomes the Arrow column
as it is.

Template: ``<|role|>`` + role + newline, text, ``<|end|>`` + newline.  Inside roles and
texts a backslash is doubled and each control string is written as a backslash
and its letter, so no control string is left and `unescape` gives the text back.
The loss mask covers the escaped texts of the assistant.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROLE, END = b"<|role|>", b"<|end|>"
ASSISTANT = "assistant"
#: Control strings and the letters that stand for them after a backslash.
CONTROL = {
    b"<|role|>": b"r", b"<|end|>": b"e", b"<s>": b"b", b"</s>": b"f", b"[INST]": b"i", b"[/INST]": b"j",
    b"<<SYS>>": b"y", b"<</SYS>>": b"z", b"<|im_start|>": b"m", b"<|im_end|>": b"n",
    b"<|startoftext|>": b"s", b"<|endoftext|>": b"t",
}
_LETTER = {v: k for k, v in CONTROL.items()}
_ESCAPE = re.compile(b"|".join([rb"\\", *map(re.escape, CONTROL)]))
_UNESCAPE = re.compile(rb"\\(.)", re.S)


def escape(text: bytes) -> bytes:
    if b"\\" not in text and b"<" not in text and b"[" not in text:
        return text
    return _ESCAPE.sub(lambda m: b"\\\\" if m[0] == b"\\" else b"\\" + CONTROL[m[0]], text)


def unescape(text: bytes) -> bytes:
    if b"\\" not in text:
        return text
    return _UNESCAPE.sub(lambda m: b"\\" if m[1] == b"\\" else _LETTER[m[1]], text)


def assemble(roles: list[bytes], texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The turns' strings as one Arrow column, and where in each the (escaped)
    text begins and ends, in bytes.

    The segments of all turns lie in three columns (header, text, end mark).  Their
    lengths, summed up, give every segment's place; bytes are gathered from the
    concatenated sources by index."""
    n = len(roles)
    if not n:
        return pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    heads = [ROLE + escape(r) + b"\n" for r in roles]
    bodies = [escape(t) for t in texts]
    tail = END + b"\n"
    length = np.empty((n, 3), dtype=np.int64)
    length[:, 0] = np.fromiter(map(len, heads), dtype=np.int64, count=n)
    length[:, 1] = np.fromiter(map(len, bodies), dtype=np.int64, count=n)
    length[:, 2] = len(tail)
    place = np.concatenate([[0], np.cumsum(length.ravel())])
    begin = place[:-1].reshape(n, 3)
    buffer = np.empty(int(place[-1]), dtype=np.uint8)
    for k, source in ((0, b"".join(heads)), (1, b"".join(bodies)), (2, tail * n)):
        octets = np.frombuffer(source, dtype=np.uint8)
        own = length[:, k]
        shift = begin[:, k] - (np.cumsum(own) - own)  # from the source's place to the buffer's
        for a in range(0, n, _ROWS):  # scatter indices for some rows at a time
            rows = slice(a, a + _ROWS)
            first = int(own[:a].sum())
            at = np.arange(first, first + int(own[rows].sum()))
            buffer[at + np.repeat(shift[rows], own[rows])] = octets[at]
    offsets = np.append(begin[:, 0], place[-1])
    column = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets), pa.py_buffer(buffer)])
    return column, length[:, 0], length[:, 0] + length[:, 1]


_ROWS = 1024


def format_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, position, formatted, mask_begin, mask_end`` by turn, the rows of a
    conversation together and in order within a partition.

    ``position`` counts the conversation's turns from 0; joined in its order the
    ``formatted`` strings are the conversation.  The mask is the place of the text in
    bytes for the assistant's turns, else null.  Rows are ordered by turn (nulls
    first), then role and text; equal rows stay.  Null roles and texts count as
    empty, a null ``conv_id`` is a conversation like any other.  An empty table gives no
    rows; other columns are not read.  A conversation is a stream of turns of which
    a task holds a batch at a time, so its length isn't bounded by memory."""
    turns = conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = turns.withColumn("position", (F.row_number().over(order) - 1).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roles = b.column("role").cast(pa.binary()).to_pylist()
            column, begin, end = assemble(roles, b.column("text").cast(pa.binary()).to_pylist())
            no_loss = np.array([r != ASSISTANT.encode() for r in roles], dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("position"), column.cast(pa.string()),
                 pa.array(begin, mask=no_loss), pa.array(end, mask=no_loss)],
                ["conv_id", "position", "formatted", "mask_begin", "mask_end"])

    kind = turns.schema["conv_id"].dataType.simpleString()
    return placed.select("conv_id", "position", "role", "text").mapInArrow(
        run, f"conv_id {kind}, position long, formatted string, mask_begin long, mask_end long")


class _Read:
    """What a conversation's formatted turns say, read turn by turn."""

    def __init__(self) -> None:
        self.n = self.loss_chars = self.chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: bytes, begin: int | None, end: int | None) -> None:
        head, _, rest = formatted.partition(b"\n")
        body, mark, after = rest.rpartition(END)
        if not head.startswith(ROLE) or not mark or after != b"\n":
            raise ValueError("not a formatted turn")
        self.n += 1
        self.chars += len(formatted.decode())
        self.turns.update(unescape(head[len(ROLE):]) + b"\n" + unescape(body) + b"\n")
        if begin is not None:
            text = unescape(formatted[begin:end])
            self.loss.update(text)
            self.loss_chars += len(codecs.decode(text, "utf-8"))

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``
    from the output of `format_turns`, as it comes (a conversation's turns
    together and in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, names = None, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def out():
            columns = [[i for i, _ in done], *zip(*(r for _, r in done), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [kind, *kinds], strict=True)], names)

        now, done = None, []
        for b in batches:
            kind = b.column("conv_id").type
            data = zip(b.column("conv_id").to_pylist(), b.column("position").to_pylist(),
                       b.column("formatted").cast(pa.binary()).to_pylist(),
                       b.column("mask_begin").to_pylist(), b.column("mask_end").to_pylist(), strict=True)
            for conv, position, text, begin, end in data:
                if position == 0:
                    if now:
                        done.append((now[0], now[1].row()))
                    now = conv, _Read()
                now[1].add(text, begin, end)
            if done:
                yield out()
                done = []
        if now:
            done = [(now[0], now[1].row())]
            yield out()

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                                     "loss_sha256 string, formatted_chars long")
