"""Packing documents into fixed-length sequences: shortest-pack-first over the
length histogram.

Documents become pieces of at most ``width`` ids.  `plan_patterns` sees only
the histogram of piece lengths (at most ``width`` numbers, whatever the corpus):
it places lengths longest first, each into the patterns in use that have the
least room left for it, and counts how often each pattern is used.  A pattern's use of
a length covers a run of ranks of that length; `pack` ranks the pieces of each
length, and a piece finds its sequence and offset from its rank alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_once
from .bpe import Encoder, byte_symbols
from .common import gapless_rank, with_row_number_ids

END_ID = 1


class LibraryEncoder(Encoder):
    """The same cutting into words; each new word's ids come from the
    tokenizers library's model, repeated words from memory."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        self.model = Tokenizer.from_file(path).model
        self.symbols = dict(enumerate(byte_symbols()))

    def word(self, word: str) -> bytes:
        seen = word if word.isascii() else word.encode().decode("latin-1").translate(self.symbols)
        tokens, packed = self.model.tokenize(seen), self.bytes_of
        return packed[tokens[0].id] if len(tokens) == 1 else b"".join([packed[t.id] for t in tokens])


_ENCODERS: dict[str, LibraryEncoder] = {}


def pieces(docs: DataFrame, path: str, width: int, end_id: int = END_ID, with_ids: bool = False,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents cut into pieces of ``width`` ids and a rest: ``doc_id, start,
    length, ids_crc32, doc_tokens`` and, if asked for, ``ids`` (little-endian
    unsigned 32-bit).  A null or empty text is the end id alone."""
    end = int(end_id).to_bytes(4, "little")
    step = 4 * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = LibraryEncoder(path)
        encode = _ENCODERS[path].encode
        for b in batches:
            of, start, length, crc, total, ids = [], [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                packed = encode(text) + end
                for at in range(0, len(packed), step):
                    piece = packed[at:at + step]
                    of.append(i)
                    start.append(at // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(len(packed) // 4)
                    if with_ids:
                        ids.append(piece)
            columns = [b.column(0).take(pa.array(of, pa.int64())),
                       *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        run, schema + ", ids binary" * with_ids)


def plan_patterns(histogram: dict[int, int], width: int) -> list[tuple[list[tuple[int, int]], int]]:
    """``[(pattern, uses)]``; a pattern is ``[(length, how often)]``.

    Lengths are placed longest first.  Each goes to the patterns with the
    most room left (shortest pack first), as many copies as fit; what a
    length doesn't need of a pattern's uses stays as it was.  What finds no
    room opens new patterns.  A step either uses a pattern up or ends its
    length, so there are at most twice as many patterns as lengths."""
    rooms: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}

    def put(room: int, pattern: list[tuple[int, int]], uses: int) -> None:
        if uses:
            rooms.setdefault(room, []).append((pattern, uses))

    for length in sorted(histogram, reverse=True):
        left = int(histogram[length])
        for room in sorted((r for r in rooms if r >= length), reverse=True):
            fit = room // length
            while left and rooms.get(room):
                pattern, uses = rooms[room].pop()
                whole = min(uses, left // fit)
                put(room - fit * length, [*pattern, (length, fit)], whole)
                left -= whole * fit
                uses -= whole
                if uses and left:  # fewer than fit are left
                    put(room - left * length, [*pattern, (length, left)], 1)
                    uses, left = uses - 1, 0
                put(room, pattern, uses)
            if not left:
                break
        fit = width // length
        put(width - fit * length, [(length, fit)], left // fit)
        if left % fit:
            put(width - left % fit * length, [(length, left % fit)], 1)
    return [x for room in sorted(rooms) for x in rooms[room]]


def _lookup(patterns: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """For each run of ranks of a length: its first rank, the copies in a
    sequence, the first sequence and the offset of the first copy; sorted by
    (length, rank)."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, uses in patterns:
        offset = 0
        for length, copies in pattern:
            rows.append((length, taken.get(length, 0), copies, sequence, offset))
            taken[length] = taken.get(length, 0) + uses * copies
            offset += length * copies
        sequence += uses
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "copies", "sequence", "offset"), table.T.copy(), strict=True))


def place(ranked: DataFrame, patterns: list[tuple[list[tuple[int, int]], int]], rank: str) -> DataFrame:
    """Joins patterns back to ranked pieces: adds ``sequence_id`` and
    ``offset``.  The runs are sorted arrays of at most a few thousand entries (a
    bound of the width); a piece finds its own by binary search."""
    runs = _lookup(patterns)
    names = ranked.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, first = np.unique(runs["length"], return_index=True)
        last = np.append(first[1:], len(runs["length"]))
        for b in batches:
            length = b.column(names.index("length")).to_numpy(zero_copy_only=False)
            at = b.column(names.index(rank)).to_numpy(zero_copy_only=False)
            hit = np.empty(len(length), dtype=np.int64)
            for x in np.unique(length):
                k = np.searchsorted(lengths, x)
                here = length == x
                hit[here] = first[k] - 1 + np.searchsorted(runs["rank"][first[k]:last[k]], at[here], side="right")
            use, copy = np.divmod(at - runs["rank"][hit], runs["copies"][hit])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(runs["sequence"][hit] + use), pa.array(runs["offset"][hit] + copy * length)],
                [*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, width: int = 2048, end_id: int = END_ID, with_ids: bool = True,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset`` and its ``ids`` (little-endian unsigned 32-bit), unless
    ``with_ids`` is false.  Sequences are numbered from 0 and padded to
    ``width``.

    Every row of ``docs`` is packed, also repeated ones and those with a null id;
    a null or empty text is one piece, the end id.  An empty table gives
    no rows.  Other columns are not read.  The texts are encoded once; the driver
    gets the histogram only."""
    if width < 1:
        raise ValueError("width must be positive")
    stored = write_once(with_row_number_ids(
        pieces(docs, path, width, end_id, with_ids, id_col, text_col), "__row"), "pieces")
    counts = stored.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `width` rows
    patterns = plan_patterns({r["length"]: r["n"] for r in counts}, width)
    narrow = gapless_rank(stored.drop("ids"), ["length"], "__row", "__at")
    placed = place(narrow, patterns, "__at").drop("__at")
    if with_ids:
        placed = placed.join(stored.select("__row", "ids"), "__row")
    return placed.drop("__row")
