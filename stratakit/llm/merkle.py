"""Merkle dataset manifest with incremental witnesses.

Rows are leaves of one tree a group, ``FAN`` children a node; the groups' roots
are the leaves of the tree above.  Leaves are appended one by one.  A run of
nodes that is still open keeps the partial witnesses of the leaves below it; when
the run is complete every such witness grows by its siblings in the run and the
parent is appended one level up.

The appends are dealt to tasks in blocks of ``FAN ** HEIGHT`` leaves, aligned so that
a block is a subtree.  A block's root is appended to a further tree, in blocks
again, until a group has one block.  The witness of a block's root there is the
rest of the witness of all its leaves: it travels once a block, not once a leaf.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_once
from .common import gapless_rank, with_row_number_ids

FAN, HEIGHT = 16, 3
BLOCK = FAN ** HEIGHT
WITNESS = "array<struct<left: string, right: string>>"


def node(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


class Appender:
    """A subtree that leaves are appended to, and the witnesses of its leaves so
    far: ``(left, right)`` a level, the siblings before and after, joined."""

    def __init__(self, fan: int = FAN) -> None:
        self.fan, self.witnesses = fan, []
        #: Per level: the open run as (digest, first leaf, leaf after the last), and how many nodes the level has had.
        self.runs: list[list[tuple[str, int, int]]] = []
        self.counts: list[int] = []

    def append(self, leaf: str) -> None:
        at = len(self.witnesses)
        self.witnesses.append([])
        self._add(0, leaf, at, at + 1)

    def _add(self, level: int, digest: str, first: int, end: int) -> None:
        if level == len(self.runs):
            self.runs.append([])
            self.counts.append(0)
        if len(self.runs[level]) == self.fan:
            self._complete(level)
        self.runs[level].append((digest, first, end))
        self.counts[level] += 1

    def _complete(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        digests = [d for d, _, _ in run]
        for place, (_, first, end) in enumerate(run):
            step = "".join(digests[:place]), "".join(digests[place + 1:])
            for leaf in range(first, end):
                self.witnesses[leaf].append(step)
        self._add(level + 1, node(digests), run[0][1], run[-1][2])

    def finish(self, height: int | None = None) -> str:
        """Completes the open runs and returns the root: the only node of its
        level, or with ``height`` the one node of that level (a run of one node
        has a parent, too)."""
        level = 0
        while level != height and (height is not None or self.counts[level] > 1):
            self._complete(level)
            level += 1
        return self.runs[level][0][0]


def leaf_digest(columns: list[str]) -> Column:
    """SHA-256 (hex) of the columns: ``-`` for a null, else length in bytes, ``:`` and value."""
    values = [F.col(f"`{c}`").cast("string") for c in columns]
    return digest_of(values)


def digest_of(values: list[Column]) -> Column:
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
                             for v in values)), 256)


def _by_block(nodes: DataFrame) -> DataFrame:
    """A block's rows together, a header (``k`` -1) first, then by number."""
    return nodes.repartition("g", "block").sortWithinPartitions("g", "block", "k")


def _block_roots(nodes: DataFrame) -> DataFrame:
    """``g, block, closed, alone``: the block's root as a part of a larger tree, and as a tree of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leaves, kind = None, [], None

        def root():
            trees = []
            for height in (HEIGHT, None):
                tree = Appender()
                for leaf in leaves:
                    tree.append(leaf)
                trees.append(tree.finish(height))
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]], kind), pa.array([now[1]], pa.int64()), *(pa.array([t], pa.string()) for t in trees)],
                ["g", "block", "closed", "alone"])

        for b in batches:
            kind = b.column("g").type
            for g, block, digest in zip(*(b.column(c).to_pylist() for c in ("g", "block", "node")), strict=True):
                if now != (g, block):
                    if leaves:
                        yield root()
                    now, leaves = (g, block), []
                leaves.append(digest)
        if leaves:
            yield root()

    kind = nodes.schema["g"].dataType.simpleString()
    return _by_block(nodes.select("g", _block(), "k", "node")).mapInArrow(
        run, f"g {kind}, block long, closed string, alone string")


def _heads(nodes: DataFrame) -> DataFrame:
    """``g, block, top, height, rest``, stored: for every block of ``g, k, node`` the group's root,
    the level up to which the block is completed (null: a tree of its own) and the
    witness of the block's root."""
    roots = write_once(_block_roots(nodes), "merkle-blocks")
    several = roots.filter("block > 0").select(F.col("g").alias("__g")).distinct()
    more = F.col("g").eqNullSafe(F.col("__g"))
    heads = roots.join(several, more, "left_anti").select(
        "g", "block", F.col("alone").alias("top"), F.lit(None).cast("int").alias("height"),
        F.array().cast(WITNESS).alias("rest"))
    if not roots.filter("block > 0").isEmpty():
        above = write_once(roots.join(several, more, "left_semi").select(
            "g", F.col("block").alias("k"), F.col("closed").alias("node")), "merkle-above")
        heads = heads.unionByName(_witnesses(above, _heads(above), [], ["top"]).select(
            "g", F.col("k").alias("block"), "top", F.lit(HEIGHT).alias("height"), F.col("witness").alias("rest")))
    return write_once(heads, "merkle-heads")


def _witnesses(nodes: DataFrame, heads: DataFrame, carry: list[str], tell: list[str]) -> DataFrame:
    """``g, k, node, *carry, *tell, witness``: the nodes' columns, the strings ``tell`` of
    their block's head and the whole witness, lowest level first."""
    kinds = {c: nodes.schema[c].dataType.simpleString() for c in ["g", "k", "node", *carry]}
    own, theirs = ["node", *carry], [*tell, "height", "rest"]
    empty = {c: F.lit(None).cast(heads.schema[c].dataType) for c in theirs}
    rows = nodes.select("g", _block(), "k", *own, *(e.alias(c) for c, e in empty.items()))
    heads = heads.select("g", "block", F.lit(-1).cast("long").alias("k"),
                         *(F.lit(None).cast(kinds[c]).alias(c) for c in own), *theirs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        names, head, held, types = ["g", "k", "node", *carry], None, [], None

        def out():
            tree = Appender()
            for row in held:
                tree.append(row[2])
            tree.finish(head["height"])
            for a in range(0, len(held), 1024):
                part = held[a:a + 1024]
                whole = [[*w, *((s["left"], s["right"]) for s in head["rest"])] for w in tree.witnesses[a:a + 1024]]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)),
                     *(pa.array([head[c]] * len(part), pa.string()) for c in tell), pa.array(whole, step)],
                    [*names, *tell, "witness"])

        for b in batches:
            types = [b.column(c).type for c in names]
            for i, row in enumerate(zip(*(b.column(c).to_pylist() for c in names), strict=True)):
                if row[1] == -1:
                    if held:
                        yield from out()
                    head, held = {c: b.column(c)[i].as_py() for c in theirs}, []
                else:
                    held.append(row)
        if held:
            yield from out()

    schema = ", ".join([*(f"`{c}` {k}" for c, k in kinds.items()), *(f"`{c}` string" for c in tell), f"witness {WITNESS}"])
    return _by_block(heads.unionByName(rows)).mapInArrow(run, schema)


def _block() -> Column:
    return F.floor(F.col("k") / BLOCK).cast("long").alias("block")


def _numbered(df: DataFrame, order: list[str], by: list[str], name: str) -> DataFrame:
    """Adds ``k``: 0, 1, ... in each ``by`` group, in the order of ``order``, which begins with ``by``."""
    ranged = write_once(with_row_number_ids(df.repartitionByRange(*order).sortWithinPartitions(*order), "__row"), name)
    return write_once(gapless_rank(ranged, by, "__row", "k").drop("__row"), f"{name}-ranked")


def manifest(docs: DataFrame, columns: list[str], group_col: str = "source", id_col: str = "doc_id",
             more: dict[str, Column] | None = None) -> DataFrame:
    """``id_col, leaf, subroot, root, witness`` and the columns of ``more`` (expressions over the
    row), one row a row of ``docs``.

    A leaf is the digest of ``columns``.  Leaves of a group ascend by id (null first), those with the
    same id by digest; equal rows are leaves of their own.  Null is a group like any other and the
    first one.  The witness reaches from the leaf to the root over all groups; a level
    with one node adds nothing.  An empty table gives no rows.  Other columns are not read.

    Texts are read once and reduced to digests; all that is shuffled is some 200
    bytes a row.  A group's rows are sorted over ranges and appended in blocks, so one that
    holds a third of all rows is spread evenly."""
    more = more or {}
    told = [f"__more_{c}" for c in more]
    leaves = write_once(docs.select(
        F.col(f"`{group_col}`").cast("string").alias("g"), F.col(f"`{id_col}`").alias("id"), leaf_digest(columns).alias("node"),
        *(e.alias(c) for c, e in zip(told, more.values(), strict=True)), F.monotonically_increasing_id().alias("tie")),
        "merkle-leaves")
    leaves = _numbered(leaves, ["g", "id", "node", "tie"], ["g"], "merkle-ordered")
    heads = _heads(leaves)
    groups = heads.filter("block = 0").select(F.lit(0).alias("all"), F.col("g").alias("group"), "top")
    groups = (_numbered(groups, ["all", "group"], ["all"], "merkle-groups")
              .select(F.lit("").alias("g"), "k", F.col("top").alias("node"), "group"))
    over = _witnesses(groups, _heads(groups), ["group"], ["top"]).select("group", F.col("top").alias("root"), F.col("witness").alias("over"))
    heads = (heads.join(over, F.col("g").eqNullSafe(F.col("group")))
             .select("g", "block", "top", "root", "height", F.concat("rest", "over").alias("rest")))
    return _witnesses(leaves, heads, ["id", *told], ["top", "root"]).select(
        F.col("id").alias(id_col), F.col("node").alias("leaf"), F.col("top").alias("subroot"), "root", "witness",
        *(F.col(t).alias(c) for t, c in zip(told, more, strict=True)))


def fold(leaf: Column, witness: Column) -> Column:
    """The root that a leaf and a witness give."""
    return F.aggregate(witness, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_digest(witness: Column) -> Column:
    """SHA-256 of the witness' siblings, left to right, lowest level first."""
    return F.sha2(F.array_join(F.transform(witness, lambda s: F.concat(s["left"], s["right"])), ""), 256)
