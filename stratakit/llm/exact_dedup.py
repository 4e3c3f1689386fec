"""Exact deduplication by content-defined chunk recipes.

A text is cut where its own bytes say so (`cut_points`), so equal texts are cut
alike.  Each distinct chunk gets an identifier, a keyed 128-bit hash, that is
verified over the whole corpus: one job brings the distinct (identifier, chunk)
pairs together and shows that no identifier has two chunks; if one had, the job
starts again with another key.  Texts are then equal exactly if their recipes,
the ordered identifiers, are equal, and only recipes are grouped and joined.
A text's bytes move at most once, and repeated chunks once for each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_once
from .common import ascii_lower, join_groups, keep_rows, with_row_number_ids

#: Bytes that decide about a cut, mean chunk 2**BITS, shortest and longest chunk.
WINDOW, BITS, SHORTEST, LONGEST = 8, 12, 1 << 10, 1 << 16
_BLOCK = 1 << 20
#: Longest recipe, in bytes, that a hot group is broadcast with: 1,000 of them are 16 MB.
HOT_RECIPE = 1 << 14
_MIX = np.uint64(0x9E3779B97F4A7C15)


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks.  A cut may follow any 8 bytes whose mixed value has
    its top 12 bits zero; chunks shorter than 1 KiB run on, those of 64 KiB are
    cut.  Works through long texts a block at a time."""
    n, ends, begin = len(data), [], 0
    if n <= SHORTEST:
        return [n] if n else []
    octets = np.frombuffer(data, dtype=np.uint8)
    for at in range(0, n, _BLOCK):
        part = octets[max(0, at - WINDOW + 1):at + _BLOCK].astype(np.uint64)
        if len(part) < WINDOW:
            break
        mixed = np.zeros(len(part) - WINDOW + 1, dtype=np.uint64)
        for k in range(WINDOW):
            mixed |= part[k:k + len(mixed)] << np.uint64(8 * k)
        mixed *= _MIX
        for end in (np.flatnonzero(mixed >> np.uint64(64 - BITS) == 0) + max(0, at - WINDOW + 1) + WINDOW).tolist():
            while end - begin > LONGEST:
                begin += LONGEST
                ends.append(begin)
            if end - begin >= SHORTEST:
                ends.append(end)
                begin = end
    while n - begin > LONGEST:
        begin += LONGEST
        ends.append(begin)
    if begin < n:
        ends.append(n)
    return ends


def identifier(chunk: bytes, key: int) -> bytes:
    return xxhash.xxh3_128_digest(chunk, key)


Identify = Callable[[bytes, int], bytes]


def _chunks(data: bytes) -> Iterator[bytes]:
    begin = 0
    for end in cut_points(data):
        yield data[begin:end]
        begin = end


def _normalised(column: pa.Array) -> list[bytes]:
    """UTF-8 texts with A-Z lower-cased; null counts as empty."""
    return [(t or b"").lower() for t in column.cast(pa.binary()).to_pylist()]


def recipes(docs: DataFrame, key: int, identify: Identify = identifier,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, text_sha256, recipe``: the recipe is the chunks'
    identifiers in order, of 16 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _normalised(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(map(len, texts), pa.int64()),
                 pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                 pa.array([b"".join([identify(c, key) for c in _chunks(t)]) for t in texts], pa.binary())],
                ["doc_id", "n_bytes", "text_sha256", "recipe"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        run, f"doc_id {kind}, n_bytes long, text_sha256 string, recipe binary")


def chunks(docs: DataFrame, key: int, identify: Identify = identifier, text_col: str = "text") -> DataFrame:
    """``identifier, chunk`` of all texts; what a batch repeats is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = {c for t in _normalised(b.column(0)) for c in _chunks(t)}
            yield pa.RecordBatch.from_arrays(
                [pa.array([identify(c, key) for c in seen], pa.binary()), pa.array(seen, pa.binary())],
                ["identifier", "chunk"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "identifier binary, chunk binary")


def verified_key(docs: DataFrame, identify: Identify = identifier, text_col: str = "text") -> int:
    """The first key under which no two different chunks of the corpus share an
    identifier."""
    key = 0
    while True:
        distinct = chunks(docs, key, identify, text_col).distinct()
        shared = distinct.groupBy("identifier").agg(F.count("*").alias("n")).filter("n > 1")
        if shared.isEmpty():
            return key
        key += 1


def exact_groups(docs: DataFrame, identify: Identify = identifier,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept,
    text_sha256``.

    Texts are equal if identical after lower-casing A-Z; null counts as empty.
    Of equal texts the row with the largest id stays; of several rows with that
    id, one (null ids come last, so a group of null ids keeps one of them, with
    a null ``keep_id``).  An empty table gives no rows; other columns are not
    read."""
    key = verified_key(docs, identify, text_col)
    rows = write_once(with_row_number_ids(recipes(docs, key, identify, id_col, text_col), "__row"), "recipes")
    groups = write_once(rows.groupBy("n_bytes", "recipe").agg(
        F.max(F.struct("doc_id", "__row")).alias("keep"), F.count("*").alias("group_size")), "recipe-groups")
    short = F.length("recipe") <= HOT_RECIPE
    return join_groups(rows, groups, ["n_bytes", "recipe"], "group_size", short).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("__row") == F.col("keep.__row")).alias("kept"), "text_sha256")


def keep_one_of_equal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are found again by id; where several have it, their digests tell them
    apart, and one of each equal text stays."""
    decided = exact_groups(docs, id_col=id_col, text_col=text_col).filter("kept").select(
        F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__digest"))
    text = F.coalesce(F.col(f"__doc.`{text_col}`").cast("string"), F.lit(""))
    return keep_rows(docs, decided, F.sha2(ascii_lower(text), 256), id_col)
