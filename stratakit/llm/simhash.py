"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits have a point between them that is within
half the radius of both, so each emits every variant within half the radius and
they meet on one.  Half of 3 is 1: for the odd bit there are three views,
each blind to a third of the bits.  If three bits differ, the view that is blind to
one of them sees at most two, and balls of one bit meet; 44 or so variants a
view, 132 in all, instead of the 2,081 of two bits.

Only distinct fingerprints take part.  A variant that has two of them gives a
candidate pair, which is verified.  Where three or more share a variant (a
large group of near copies) no pairs are emitted: those fingerprints go through
the full balls, of one bit on one side and two on the other.  There any
fingerprint at one bit is within 3 of all others at the point, so a star of links to
one of them says everything, without pairs or checks, and cost stays in
proportion to the fingerprints.

Links become components by repeated minimum with pointer jumping, each round
stored in the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_once
from .common import join_groups, keep_rows, with_row_number_ids

SEED = 42
VIEWS = 3
_BITS = 64


def fingerprint(text: bytes, words: int) -> int:
    """Unsigned 64-bit SimHash of a text lower-cased in A-Z."""
    tokens = text.lower().split()  # ASCII white space
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    elif words == 3:
        shingles = map(b"%b %b %b".__mod__, zip(tokens, tokens[1:], tokens[2:]))
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words))))
    h = xxhash.xxh64_intdigest
    ones, n = np.zeros(_BITS, dtype=np.int64), 0
    hashes = [h(s, SEED) for s in shingles]
    for at in range(0, len(hashes), 1 << 16):
        block = np.array(hashes[at:at + (1 << 16)], dtype="<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(block)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, digest`` per row: the fingerprint's bits as a signed long and
    the text's MD5; a null text counts as empty and has the fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            fps = np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(fps), pa.array([hashlib.md5(t).hexdigest() for t in texts], pa.string())],
                ["doc_id", "fp", "digest"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, fp long, digest string")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def view_masks(radius: int, views: int = VIEWS) -> list[list[int]]:
    """For each view the masks that turn a fingerprint's visible bits into its
    variants, and last the mask of the visible bits (signed)."""
    blind = [0] if radius % 2 == 0 else [
        sum(1 << b for b in range(_BITS * k // views, _BITS * (k + 1) // views)) for k in range(views)]
    out = []
    for hidden in blind:
        seen = [b for b in range(_BITS) if not hidden >> b & 1]
        flips = [sum(1 << b for b in c) for n in range(radius // 2 + 1) for c in combinations(seen, n)]
        out.append([*map(_signed, flips), _signed(~hidden & (1 << 64) - 1)])
    return out


def _spread(fps: DataFrame) -> DataFrame:
    """Deals a stored table of few bytes out, whose rows become many."""
    return fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")


def _balls(fps: DataFrame, radius: int) -> DataFrame:
    """``view, variant, fp``: every variant within half the radius, by view."""
    flips = F.array(*(F.struct(F.lit(k).cast("byte").alias("view"), F.lit(masks[-1]).cast("long").alias("seen"),
                               F.lit(m).cast("long").alias("flip"))
                      for k, masks in enumerate(view_masks(radius)) for m in masks[:-1]))
    return _spread(fps).select("fp", F.inline(flips)).select(
        "fp", "view", F.col("fp").bitwiseAND(F.col("seen")).bitwiseXOR(F.col("flip")).alias("variant"))


def _distance(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _star_links(fps: DataFrame, radius: int) -> DataFrame:
    """All links among ``fps`` (up to connection): each meets the others at the
    points within ``radius // 2`` bits of one and the rest of the radius of the
    other; whoever is near is linked to the smallest of the near ones."""
    near, far = radius // 2, radius - radius // 2
    flips = [_signed(sum(1 << b for b in c)) for n in range(far + 1) for c in combinations(range(_BITS), n)]
    at = _spread(fps).select("fp", F.explode(F.array(*(F.lit(m).cast("long") for m in flips))).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), (F.bit_count("flip") <= near).alias("close"))
    hubs = (at.groupBy("point").agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("hub"), F.count("*").alias("n"))
            .filter("n > 1 AND hub IS NOT NULL").select("point", "hub"))
    # the sizes of exploded rows aren't in the optimiser's estimates
    return at.join(hubs.hint("merge"), "point").filter("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def links(fps: DataFrame, radius: int) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``) that connect
    exactly those that chains of at most ``radius`` differing bits connect."""
    fps = write_once(fps.select("fp").distinct(), "fingerprints")
    order = Window.partitionBy("view", "variant").orderBy("fp")
    back, ahead = F.lag("fp").over(order), F.lead("fp").over(order)
    met = write_once(_balls(fps, radius).select(
        "fp", back.alias("back"), ahead.alias("ahead"),
        (F.lag("fp", 2).over(order).isNotNull() | F.lead("fp", 2).over(order).isNotNull()
         | (back.isNotNull() & ahead.isNotNull())).alias("crowded"))
        .filter("back IS NOT NULL OR ahead IS NOT NULL"), "met")
    pairs = (met.filter("NOT crowded AND back IS NULL").select(F.col("fp").alias("a"), F.col("ahead").alias("b"))
             .distinct().filter(_distance("a", "b") <= radius))
    crowd = write_once(met.filter("crowded").select("fp").distinct(), "crowd")
    return pairs.union(_star_links(crowd, radius))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for the nodes of ``a, b`` edges; the root is the smallest
    node of the component.

    Every round each node's parent becomes the smallest parent among itself, its
    neighbours and its parent's parent; edges are then drawn between parents, and
    those inside one tree go.  It ends when no edge is left."""
    edges = write_once(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    parent = write_once(nodes.select("node", F.col("node").alias("root")), "forest")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("u"))
        hook = write_once(least.select("v", F.least("u", "v").alias("u")).filter("u < v"), "hook")
        # follow the hooks to their ends: each doubles the step, ends have none
        while True:
            up = hook.select(F.col("v").alias("u"), F.col("u").alias("top"))
            longer = write_once(hook.join(up, "u", "left").select("v", F.coalesce("top", "u").alias("u"), (
                F.col("top").isNotNull()).alias("moved")), "hook")
            hook = longer.select("v", "u")
            if longer.filter("moved").isEmpty():
                break
        to = hook.select(F.col("v").alias("root"), F.col("u").alias("top"))
        parent = write_once(parent.join(to, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "forest")
        for end in ("a", "b"):
            edges = edges.join(hook.select(F.col("v").alias(end), F.col("u").alias("top")), end, "left").select(
                F.coalesce("top", end).alias(end), "b" if end == "a" else "a")
        edges = write_once(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return parent


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fp, component_id, kept, digest``.

    ``component_id`` is the smallest id whose text is reachable over links of
    at most ``radius`` differing bits, and its row is ``kept``; of several rows with
    that id, one.  Null and empty texts have the fingerprint 0 and are linked
    like any other.  Rows with a null id take part; a component that has only
    such rows has a null ``component_id`` and keeps one.  Repeated rows share
    their component.  An empty table gives no rows; other columns are not read."""
    rows = write_once(with_row_number_ids(fingerprints(docs, words, id_col, text_col), "__row"), "simhash")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")
    least = rows.groupBy("fp").agg(F.min(row).alias("least"), F.count("*").alias("rows"))
    tree = components(links(rows, radius))
    rooted = write_once(least.join(tree.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")), "rooted")
    whole = write_once(rooted.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("fps")), "whole")
    of = write_once(join_groups(rooted, whole, ["root"], "fps").select("fp", "first", "rows"), "firsts")
    return join_groups(rows, of, ["fp"], "rows").select("doc_id", "fp", F.col("first.doc_id").alias("component_id"),
                                      (F.col("__row") == F.col("first.__row")).alias("kept"), "digest")


def keep_one_of_near(docs: DataFrame, words: int = 3, radius: int = 3,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept row of each component, with all its columns."""
    decided = near_duplicates(docs, words, radius, id_col, text_col).filter("kept").select(
        F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
    text = F.coalesce(F.col(f"__doc.`{text_col}`").cast("string"), F.lit(""))
    return keep_rows(docs, decided, F.md5(text), id_col)
