"""Sharding by size: minimax contiguous partition of ordered atomic groups.

Equal texts form one group, which is never split.  Groups are ordered by a 60-bit
digest of their text and cut into contiguous shards so that the largest shard is as
small as it can be: a binary search over the capacity, each checked greedily
over running sums.

The driver doesn't see groups but sums over ranges of the digest.  With ranges as
they are, whole ranges give a capacity that surely suffices and divisible ranges
one that is surely needed; while the two differ, the ranges that may hold a cut are
split by eight more bits, in one aggregation.  A range with one group can't be
divided, so this ends with the exact capacity.  What the driver holds depends on
the number of shards, not on the groups.

A group larger than the mean of what is left gets a shard of its own, so one hot
text doesn't leave the other shards uneven.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_once
from .common import gapless_rank, whole_text, with_row_number_ids

ROW_BYTES = 16
_BITS, _FIRST, _STEP = 60, 12, 8


def order_key(text: Column) -> Column:
    """The first 60 bits of the text's SHA-256."""
    return F.conv(F.substring(F.sha2(text, 256), 1, _BITS // 4), 16, 10).cast("long")


@dataclass
class Ranges:
    """Disjoint ranges of the order key, in order: first key, bits of the
    prefix, bytes and number of groups."""

    first: np.ndarray
    depth: np.ndarray
    size: np.ndarray
    groups: np.ndarray

    def sorted(self) -> Ranges:
        o = np.argsort(self.first, kind="stable")
        return Ranges(self.first[o], self.depth[o], self.size[o], self.groups[o])


def _positions(total: np.ndarray, whole: np.ndarray, capacity: int, shards: int) -> list[float]:
    """Greedy ends, as byte positions, of at most ``shards`` shards over ranges
    with running sums ``total``; ranges that aren't ``whole`` may be cut
    anywhere.  Stops early where a whole range doesn't fit."""
    at, out = 0, []
    for _ in range(shards):
        limit = at + capacity
        k = int(np.searchsorted(total, limit, side="right"))  # ranges that end within
        end = int(total[k - 1]) if k else 0
        if k < len(total) and not whole[k]:
            end = limit
        if end <= at:
            break
        at = end
        out.append(at)
        if len(total) and at >= total[-1]:
            break
    return out


def least_capacity(total: np.ndarray, whole: np.ndarray, shards: int) -> int:
    """Smallest capacity with which ``shards`` greedy shards take everything."""
    if not len(total):
        return 0
    end = int(total[-1])
    low, high = -(-end // shards), end
    while low < high:
        mid = (low + high) // 2
        ends = _positions(total, whole, mid, shards)
        if ends and ends[-1] >= end:
            high = mid
        else:
            low = mid + 1
    return low


def balanced_cuts(total: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Ends (indices into ``total``) of all shards but the last, each as near to
    its even share as the capacity allows on either side."""
    bounds = np.concatenate([[0], total])
    end, least = int(total[-1]), []
    for _ in range(shards - 1):  # from the end: where the rest still fits
        end = int(bounds[np.searchsorted(bounds, end - capacity)])
        least.append(end)
    at, out = 0, []
    for k, low in enumerate(reversed(least), 1):
        most = int(np.searchsorted(bounds, at + capacity, side="right")) - 1
        first = int(np.searchsorted(bounds, max(low, at)))
        even = int(total[-1]) * k // shards
        near = int(np.searchsorted(bounds, even))
        if near and even - bounds[near - 1] < bounds[min(near, len(bounds) - 1)] - even:
            near -= 1
        at = int(bounds[min(max(near, first), most)])
        out.append(int(np.searchsorted(bounds, at)))
    return out


def _summed(units: DataFrame, depth: int) -> list:
    prefix = F.shiftright("key", _BITS - depth)
    return units.groupBy(prefix.alias("p")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).collect()


def _ranges(rows: list, depth: int) -> Ranges:
    p = np.array([r["p"] for r in rows], dtype=np.int64)
    return Ranges(p << (_BITS - depth), np.full(len(rows), depth), np.array([r["b"] for r in rows], dtype=np.int64),
                  np.array([r["n"] for r in rows], dtype=np.int64))


def _split(units: DataFrame, ranges: Ranges, chosen: np.ndarray) -> Ranges:
    """Replaces the chosen ranges by those of eight more bits."""
    spark = units.sparkSession
    parts = [Ranges(*(x[~chosen] for x in (ranges.first, ranges.depth, ranges.size, ranges.groups)))]
    for depth in np.unique(ranges.depth[chosen]).tolist():
        here = chosen & (ranges.depth == depth)
        wanted = spark.createDataFrame([(int(f >> (_BITS - depth)),) for f in ranges.first[here]], "q long")
        inside = units.join(F.broadcast(wanted), F.shiftright("key", _BITS - depth) == F.col("q"), "left_semi")
        deeper = min(_BITS, depth + _STEP)
        parts.append(_ranges(_summed(inside, deeper), deeper))
    return Ranges(*(np.concatenate(x) for x in zip(*((r.first, r.depth, r.size, r.groups) for r in parts), strict=True))).sorted()


def contiguous_cuts(units: DataFrame, shards: int) -> list[int]:
    """First keys of the second and later shards, for units ``key, bytes``
    (distinct keys of 60 bits)."""
    ranges = _ranges(_summed(units, _FIRST), _FIRST).sorted()
    while True:
        total, single = np.cumsum(ranges.size), (ranges.groups == 1) | (ranges.depth == _BITS)
        needed = least_capacity(total, single, shards)
        enough = least_capacity(total, np.ones(len(total), dtype=bool), shards)
        if needed == enough:
            if not len(total):
                return []
            return [int(ranges.first[i]) for i in balanced_cuts(total, enough, shards) if i < len(total)]
        begin = total - ranges.size
        chosen = ranges.size > max(1, needed // 8)
        earliest = _positions(total, np.ones(len(total), dtype=bool), needed, shards)
        latest = _positions(total, single, enough, shards)
        for k in range(shards - 1):
            a = earliest[k] if k < len(earliest) else (earliest[-1] if earliest else 0)
            b = latest[k] if k < len(latest) else int(total[-1])
            chosen |= (total > a) & (begin <= b)
        ranges = _split(units, ranges, chosen & ~single)


def plan_shards(units: DataFrame, shards: int) -> tuple[list[int], list[int]]:
    """``(alone, cuts)``: keys of the groups that get a shard of their own,
    largest first, and the first keys of the other shards but the first."""
    top = units.orderBy(F.desc("bytes"), "key").limit(shards).collect()  # at most one a shard
    left, free = units.agg(F.sum("bytes")).first()[0] or 0, shards
    alone = []
    for r in top:
        if free == 1 or r["bytes"] * free <= left:
            break
        alone.append(r["key"])
        left, free = left - r["bytes"], free - 1
    rest = units.filter(~F.col("key").isin(alone)) if alone else units
    return alone, contiguous_cuts(rest, free)


def assign(docs: DataFrame, shards: int = 40, row_bytes: int = ROW_BYTES,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, shard, slot``.

    ``size`` is the text's UTF-8 bytes plus ``row_bytes``; a null text counts as
    empty and shares its group.  All rows of a text, repeated rows too, are in one
    shard; a group is the texts whose 60-bit digests agree.  ``slot`` counts
    from 0 in each shard.  Fewer groups than shards leave shards empty; an empty
    table gives no rows.  Other columns are not read."""
    if shards < 1:
        raise ValueError("shards must be positive")
    text = whole_text(text_col)
    rows = write_once(with_row_number_ids(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + row_bytes).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), order_key(text).alias("key")), "__row"), "shard-rows")
    units = write_once(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    alone, cuts = plan_shards(units, shards)
    shard = F.lit(len(alone))
    for cut in cuts:
        shard = shard + (F.col("key") >= cut).cast("int")
    for k, key in enumerate(alone):
        shard = F.when(F.col("key") == key, k).otherwise(shard)
    ranked = gapless_rank(rows.withColumn("shard", shard.cast("int")), ["shard"], "__row", "slot")
    return ranked.select("doc_id", "size", "text_crc32", "shard", "slot")
