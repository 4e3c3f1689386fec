"""Forests grown together over pooled rows whose inputs are small codes.

``learn.fit_forest`` hands every tree to Spark's trainer, which reads, encodes and caches the rows anew for each.  Here one pass
over the rows per level serves all trees of all forests of a search: a task adds up, for every node that is to be split, how often
the bootstrap draws each value of the columns that the node may split on, by fold and class.  Class weights and the held-out fold
are applied to these sums on the driver, so nodes that forests of other folds or weights share are counted once.  Trees are those
of Spark's trainer (one tree a fit, no further bootstrap, seed 42 + tree): the same features per node, splits, gains, stops and
pruning.  Sums are whole numbers, so the trees don't depend on partitions; thresholds of a numeric column come from all of
its values where the trainer samples 10,000 rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.util import Identifiable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_once

PACKED = "__packed"
PLAIN = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
#: Columns of more values are not coded, deeper trees not grown here.
MOST_VALUES, MOST_DEPTH = 256, 8
#: Cells that one pass counts at most (every task holds them), and rows that a task works on at once.
MOST_CELLS, ROWS_AT_ONCE = 1 << 22, 1 << 17
#: Spark's defaults.
MAX_BINS, EPSILON = 32, 2.0 ** -52


def growable(params: dict | None) -> bool:
    """Whether `grow` knows all of a forest's parameters."""
    p = params or {}
    return set(p) <= {"numTrees", "maxDepth", "seed"} and p.get("maxDepth", 5) <= MOST_DEPTH


# --- packed and coded rows --------------------------------------------------------

@dataclass
class Packing:
    """Columns of few values as digits of one number, ``PACKED``: of a column its type, its sorted values (digit 0: null) and how many
    combinations come before.  Rows are packed and counted outside the JVM: as expressions, so many columns make a
    method that is too long to be compiled."""

    digits: dict[str, tuple[T.DataType, list, int]]

    @classmethod
    def of(cls, rows: DataFrame, columns: list[str], most: int = MOST_VALUES) -> Packing:
        """The driver gets the values of the columns that have at most ``most``; if a number can't tell all combinations, the
        last columns are left out."""
        plain = [c for c in dict.fromkeys(columns) if type(rows.schema[c].dataType) in PLAIN]
        found = {c: [] for c in plain}
        if plain:
            schema = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("many", T.BooleanType()),
                                   *[T.StructField(f"v{i}", rows.schema[c].dataType) for i, c in enumerate(plain)]])
            for r in rows.select(*[F.col(c).alias(f"v{i}") for i, c in enumerate(plain)]).mapInArrow(_finder(len(plain), most), schema).distinct().collect():
                found[plain[r["at"]]].append(None if r["many"] else r[f"v{r['at']}"])
        digits, span = {}, 1
        for c, values in found.items():
            if values and None not in values and len(values) <= most and span * (len(values) + 1) < 2 ** 62:
                digits[c] = rows.schema[c].dataType, sorted(values, key=lambda v: (v != v, v)), span
                span *= len(values) + 1
        return cls(digits)

    def pack(self, rows: DataFrame) -> DataFrame:
        if not self.digits:
            return rows
        kept = [c for c in rows.columns if c not in self.digits]
        schema = T.StructType([*[T.StructField(c, rows.schema[c].dataType) for c in kept], T.StructField(PACKED, T.LongType())])
        told = {c: (values, before) for c, (_, values, before) in self.digits.items()}
        return rows.select(*kept, *self.digits).mapInArrow(_packer(kept, told, PACKED), schema)

    def unpack(self, packed: DataFrame) -> DataFrame:
        if not self.digits:
            return packed
        back = [F.get(F.array(*[F.lit(v).cast(kind) for v in values]), ((F.expr(f"{PACKED} div {before}") % (len(values) + 1)) - 1).cast("int")).alias(c)
                for c, (kind, values, before) in self.digits.items()]
        return packed.select(*[c for c in packed.columns if c != PACKED], *back)


def _finder(columns: int, most: int) -> Callable:
    """For ``mapInArrow``: a task's values of every column, or that they are more than ``most``."""
    def find(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        found = [None] * columns
        many = [False] * columns
        for b in batches:
            for i in range(columns):
                if not many[i]:
                    values = b.column(i)
                    values = pc.unique(pc.add(values, pa.scalar(0.0, values.type)) if pa.types.is_floating(values.type) else values).drop_null()
                    found[i] = values if found[i] is None else pc.unique(pa.concat_arrays([found[i], values]))
                    if len(found[i]) > most:
                        many[i], found[i] = True, pa.nulls(1, values.type)
        if any(f is not None for f in found):
            sizes = [len(f) for f in found]
            at = pa.array([i for i, n in enumerate(sizes) for _ in range(n)], pa.int32())
            marks = pa.array([many[i] for i, n in enumerate(sizes) for _ in range(n)], pa.bool_())
            spread = [pa.concat_arrays([pa.nulls(sum(sizes[:i]), f.type), f, pa.nulls(sum(sizes[i + 1:]), f.type)]) for i, f in enumerate(found)]
            yield pa.RecordBatch.from_arrays([at, marks, *spread], names=["at", "many", *[f"v{i}" for i in range(columns)]])
    return find


def _packer(kept: list[str], digits: dict[str, tuple[list, int]], name: str) -> Callable:
    def pack(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            code = np.zeros(b.num_rows, dtype=np.int64)
            for c, (values, before) in digits.items():
                col = b.column(c)
                col = pc.add(col, pa.scalar(0.0, col.type)) if pa.types.is_floating(col.type) else col   # -0.0 is 0.0
                at = pc.index_in(col, value_set=pa.array(values).cast(col.type))
                if at.null_count != col.null_count:
                    raise ValueError(f"{c} has changed while it was read")
                code += before * (at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(code)], names=[*kept, name])
    return pack


@dataclass
class Coded:
    """``rows``: ``fold`` (if ``folds`` > 1), ``label``, ``PACKED`` and draws; code of an input: its digit there.
    ``seen[i]``: per fold the codes of input i that its rows have; ``counts``: rows of a (fold, label)."""

    rows: DataFrame
    packing: Packing
    categorical: list[str]
    numeric: list[str]
    folds: int
    classes: int
    seen: list[dict[int, set[int]]] = field(default_factory=list)
    counts: dict[tuple[int, int], int] = field(default_factory=dict)

    @property
    def inputs(self) -> list[str]:
        return [*self.categorical, *self.numeric]

    @property
    def values(self) -> list[list]:
        return [self.packing.digits[c][1] for c in self.inputs]

    @property
    def digits(self) -> list[tuple[int, int]]:
        """Of every input, the combinations before its digit and the digit's base."""
        return [(self.packing.digits[c][2], len(self.packing.digits[c][1]) + 1) for c in self.inputs]

    def features(self, held_out: int | None = None) -> list[tuple[int, int | None]]:
        """The encoded features of a fit without fold ``held_out``, in the order of ``build_preprocessor``: (input, code) of a
        category, in its labels' order, or (input, None)."""
        out = []
        for i in range(len(self.categorical)):
            codes = set().union(*(c for f, c in self.seen[i].items() if f != held_out)) - {0}
            out += [(i, code) for code in sorted(codes, key=lambda code: _java_order(self.values[i][code - 1]))]
        return out + [(i, None) for i in range(len(self.categorical), len(self.inputs))]

    def categories(self) -> DataFrame:
        """The values of the inputs side by side: an encoder fitted to them is the one fitted to the rows."""
        spark, kinds = self.rows.sparkSession, [self.packing.digits[c][0] for c in self.inputs]
        schema = T.StructType([T.StructField(c, k) for c, k in zip(self.inputs, kinds, strict=True)])
        seen = [[v for code, v in enumerate(values, 1) if any(code in codes for codes in self.seen[i].values())] for i, values in enumerate(self.values)]
        return spark.createDataFrame([tuple(v[at] if at < len(v) else None for v in seen) for at in range(max(map(len, seen)))], schema)


def _java_order(value) -> bytes:
    """Orders values as Java orders their strings."""
    return (str(value).lower() if isinstance(value, bool) else str(value)).encode("utf-16-be", "surrogatepass")


def code_rows(pooled: DataFrame, packing: Packing | None, categorical: list[str], numeric: list[str], told: list[str], times: str) -> Coded | None:
    """Pooled rows (packed already, if there is a ``packing``) with the columns ``told``; None if an input has too many
    values for that, or a numeric one is null or no number somewhere.  ``times`` names the number of rows that each pooled row stands for."""
    inputs = [*categorical, *numeric]
    if packing is None:
        packing = Packing.of(pooled, inputs)
        if all(c in packing.digits for c in inputs):
            pooled = write_once(packing.pack(pooled.select(*[c for c in ("fold",) if c in pooled.columns], "label", *inputs, *told, *({times} - {*told}))), "design")
    if not inputs or any(c not in packing.digits for c in inputs) or set(categorical) & set(numeric):
        return None
    kinds = [type(packing.digits[c][0]) for c in inputs]
    if any(k in (T.FloatType, T.DoubleType) for k in kinds[:len(categorical)]) or any(k is T.StringType for k in kinds[len(categorical):]):
        return None
    if any(v != v for c in numeric for v in packing.digits[c][1]):
        return None
    folded = "fold" in pooled.columns
    label = F.col("label").cast("int")
    most = pooled.agg(F.min("label").alias("low"), F.max("label").alias("top"), F.max("fold" if folded else F.lit(0)).alias("fold"),
                      F.count_if(F.col("label").isNull() | (label != F.col("label"))).alias("odd")).first()
    if most["top"] is None or most["odd"] or most["low"] < 0:
        return None
    coded = Coded(pooled.withColumn("label", label), packing, list(categorical), list(numeric), most["fold"] + 1, max(3, 1 + int(most["top"])))
    every = _Shared({i: -1 for i in range(len(inputs))})
    ((_, cells),) = _parts({0: every}, coded)
    counted = _counted(coded, {times: every}, cells)
    for i, at in every.need.items():
        n = len(coded.values[i]) + 1
        rows = counted[at:at + coded.folds * coded.classes * n].reshape(coded.folds, coded.classes, n)
        coded.seen.append({f: {int(code) for code in np.flatnonzero(rows[f].sum(axis=0))} for f in range(coded.folds)})
        coded.counts = {(f, c): int(rows[f, c].sum()) for f in range(coded.folds) for c in range(coded.classes) if rows[f, c].sum()}
    if any(0 in codes for seen in coded.seen[len(categorical):] for codes in seen.values()):
        return None
    for held in range(coded.folds) if coded.folds > 1 else [None]:
        if any(not any(codes - {0} for f, codes in seen.items() if f != held) for seen in coded.seen):
            return None
    return coded


# --- Spark's choice of features ----------------------------------------------------

def _signed(n: int, bits: int = 64) -> int:
    n &= (1 << bits) - 1
    return n - (1 << bits) if n >> (bits - 1) else n


def _longs(seed: int) -> Iterator[int]:
    """java.util.Random(seed).nextLong() for ever."""
    state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)
    while True:
        halves = []
        for _ in range(2):
            state = (state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
            halves.append(_signed(state >> 16, 32))
        yield _signed((halves[0] << 32) + halves[1])


def _murmur(data: bytes, seed: int) -> int:
    mask, h = 0xFFFFFFFF, seed & 0xFFFFFFFF
    turn = lambda x, r: ((x << r) | (x >> (32 - r))) & mask
    for at in range(0, len(data), 4):
        k = turn(int.from_bytes(data[at:at + 4], "little") * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
        h = (turn(h ^ k, 13) * 5 + 0xE6546B64) & mask
    h ^= len(data)
    h = ((h ^ (h >> 16)) * 0x85EBCA6B) & mask
    h = ((h ^ (h >> 13)) * 0xC2B2AE35) & mask
    return h ^ (h >> 16)


def _reservoir(n: int, k: int, seed: int) -> list[int]:
    """SamplingUtils.reservoirSampleAndCount of 0 ... n-1 with Spark's XORShiftRandom."""
    mask = (1 << 64) - 1
    data = (seed & mask).to_bytes(8, "big")
    low = _murmur(data, 0x3C074A61)
    state = (_murmur(data, low) << 32) | low

    def bits(count: int) -> int:
        nonlocal state
        state ^= (state << 21) & mask
        state ^= state >> 35
        state ^= (state << 4) & mask
        return state & ((1 << count) - 1)

    out = list(range(min(n, k)))
    for item in range(k, n):
        at = int(((bits(26) << 27) + bits(27)) * 2.0 ** -53 * (item + 1))
        if at < k:
            out[at] = item
    return out


@cache
def _subsets(seed: int, n: int, k: int) -> list[list[int]]:
    """The features that the first nodes of a tree may split on, in the order in which the trainer takes the nodes."""
    longs = _longs(seed)
    return [_reservoir(n, k, next(longs)) for _ in range(2 ** MOST_DEPTH)]


# --- trees ----------------------------------------------------------------------

@dataclass
class Forest:
    """What a forest is grown from: all folds but ``held_out``, and the weight of a row of each class."""

    held_out: int | None
    weights: dict[int, float]
    trees: int
    depth: int = 5
    seed: int = 42


@dataclass
class Node:
    """A node that may be split; once it is, ``right`` says which codes of input ``column`` go right."""

    level: int
    path: tuple
    stats: np.ndarray | None = None
    counted: _Shared | None = None
    subset: list[int] | None = None
    feature: int | None = None
    column: int | None = None
    right: np.ndarray | None = None
    threshold: float | None = None
    gain: float = 0.0
    impurity: float = -1.0
    children: tuple[Node, Node] | None = None

    @property
    def prediction(self) -> int:
        return int(np.argmax(self.stats))

    def pruned(self) -> Node:
        """Two leaves that predict the same class are one."""
        if self.children:
            self.children = tuple(c.pruned() for c in self.children)
            if not any(c.children for c in self.children) and self.children[0].prediction == self.children[1].prediction:
                self.children = None
        return self


@dataclass
class _Shared:
    """A place in one tree's bootstrap where nodes of several forests stand: which inputs they need counted and where
    the counts begin, and where rows go on to."""

    need: dict[int, int] = field(default_factory=dict)
    raw: int | None = None
    on: dict[tuple[int, bytes], list] = field(default_factory=dict)

    def step(self, key: tuple[int, bytes], side: int) -> _Shared:
        both = self.on.setdefault(key, [None, None])
        both[side] = both[side] or _Shared()
        return both[side]

    def told(self) -> tuple:
        splits = [(j, np.frombuffer(right, dtype=bool), *(s and s.told() for s in both)) for (j, right), both in self.on.items()]
        return list(self.need.items()), self.raw, splits


class _Tree:
    """One tree while it grows, as the trainer grows it: nodes on a stack, all of them taken at once."""

    def __init__(self, forest: Forest, at: int, coded: Coded) -> None:
        self.forest, self.at, self.coded = forest, at, coded
        self.features = coded.features(forest.held_out)
        n = len(self.features)
        self.k = n if forest.trees == 1 else math.ceil(math.sqrt(n))
        self.weights = np.array([forest.weights.get(c, 0.0) for c in range(coded.classes)])
        self.thresholds: dict[int, tuple[list[float], list[int]]] = {}
        self.root = Node(0, ())
        self.stack, self.group, self.taken = [self.root], [], 0

    def take(self, shared: _Shared) -> None:
        """Takes the nodes from the stack and says what they need."""
        self.group = []
        while self.stack:
            node = self.stack.pop()
            if self.k < len(self.features):
                node.subset = _subsets(self.forest.seed + self.at, len(self.features), self.k)[self.taken]
            else:
                node.subset = list(range(len(self.features)))
            self.taken += 1
            node.counted = shared
            for key, side in node.path:
                node.counted = node.counted.step(key, side)
            for i in node.subset:
                node.counted.need.setdefault(self.features[i][0], -1)
            if node.level == 0:
                node.counted.raw = -1
                for i in range(len(self.coded.categorical), len(self.coded.inputs)):
                    node.counted.need.setdefault(i, -1)
            self.group.append(node)

    def split(self, cells: np.ndarray) -> None:
        classes = self.coded.classes
        folds = [f for f in range(self.coded.folds) if f != self.forest.held_out]
        for node in self.group:
            counts = {}
            for j, at in node.counted.need.items():
                n = len(self.coded.values[j]) + 1
                counts[j] = cells[at:at + self.coded.folds * classes * n].reshape(self.coded.folds, classes, n)[folds].sum(axis=0)
            total = next(iter(counts.values())).sum(axis=1)
            node.stats = total * self.weights
            if node.level == 0:
                raw = int(cells[node.counted.raw:node.counted.raw + self.coded.folds][folds].sum())
                if not raw:
                    raise ValueError(f"the bootstrap of tree {self.at} draws no row")
                for i in range(len(self.coded.categorical), len(self.coded.inputs)):
                    self.thresholds[i] = self._thresholds(i, counts[i], raw)
            self._best(node, counts, total)
            if node.children:
                for child in node.children:
                    if child.level < self.forest.depth and _gini(child.stats) >= EPSILON:
                        self.stack.append(child)

    def _thresholds(self, i: int, counts: np.ndarray, raw: int) -> tuple[list[float], list[int]]:
        """The trainer's candidate thresholds of a numeric input, and how many of its values lie below each."""
        values = [float(v) for v in self.coded.values[i]]
        weight = (counts * self.weights[:, None]).sum(axis=0)[1:]
        seen = [(v, w) for v, w in zip(values, weight) if w > 0]
        most = min(MAX_BINS, raw) - 1
        if len(seen) - 1 <= most:
            out = [(a + b) / 2 for (a, _), (b, _) in zip(seen, seen[1:])]
        else:
            out, stride = [], sum(w for _, w in seen) / (most + 1)
            below, target = seen[0][1], stride
            for (a, _), (b, w) in zip(seen, seen[1:]):
                if abs(below - target) < abs(below + w - target):
                    out.append((a + b) / 2)
                    target += stride
                below += w
        return out, [sum(v <= t for v in values) for t in out]

    def _best(self, node: Node, counts: dict[int, np.ndarray], total: np.ndarray) -> None:
        impurity, best = _gini(node.stats), None
        if node.level < self.forest.depth:
            for i in node.subset:
                j, code = self.features[i]
                if code is not None:
                    lefts = (total - counts[j][:, code])[:, None]
                else:
                    lefts = np.cumsum(counts[j], axis=1)[:, self.thresholds[j][1]]
                for at in range(lefts.shape[1]):
                    if not 0 < lefts[:, at].sum() < total.sum():
                        continue
                    left = lefts[:, at] * self.weights
                    right = (total - lefts[:, at]) * self.weights
                    n = left.sum() + right.sum()
                    gain = impurity - left.sum() / n * _gini(left) - right.sum() / n * _gini(right)
                    if gain >= 0 and (best is None or gain > best[0]):
                        best = gain, i, at, left, right
        if best is None or best[0] <= 0:
            return
        node.gain, node.feature, at, left, right = best
        node.impurity = impurity
        node.column, code = self.features[node.feature]
        codes = np.arange(len(self.coded.values[node.column]) + 1)
        if code is not None:
            node.right = codes == code
        else:
            node.threshold = self.thresholds[node.column][0][at]
            node.right = codes > self.thresholds[node.column][1][at]
        key = (node.column, node.right.tobytes())
        node.children = tuple(Node(node.level + 1, (*node.path, (key, side)), stats, impurity=_gini(stats)) for side, stats in enumerate((left, right)))


def _gini(stats: np.ndarray) -> float:
    total, out = float(stats.sum()), 1.0
    for n in stats.tolist():
        out -= (n / total) * (n / total) if total else 0.0
    return out if total else 0.0


def grow(coded: Coded, forests: list[Forest], draws: str) -> list[list[Node]]:
    """The trees of all ``forests``; column ``draws`` + t of the rows says how often tree t's bootstrap draws them.  A
    pass over the rows per level of the deepest."""
    growing = [[_Tree(f, t, coded) for t in range(f.trees)] for f in forests]
    while any(t.stack for trees in growing for t in trees):
        places = {}
        for tree in (t for trees in growing for t in trees if t.stack):
            tree.take(places.setdefault(tree.at, _Shared()))
        for part, cells in _parts(places, coded):
            counted = _counted(coded, {f"{draws}{t}": places[t] for t in part}, cells)
            for tree in (t for trees in growing for t in trees if t.group and t.at in part):
                tree.split(counted)
                tree.group = []
    return [[t.root.pruned() for t in trees] for trees in growing]


def _parts(places: dict[int, _Shared], coded: Coded) -> list[tuple[list[int], int]]:
    """Trees whose nodes one pass counts, and how many cells it has; gives out the cells."""
    out, used, width = [], 0, coded.folds * coded.classes

    def give(place: _Shared) -> None:
        nonlocal used
        if place.raw is not None:
            place.raw, used = used, used + coded.folds
        for j in place.need:
            place.need[j], used = used, used + width * (len(coded.values[j]) + 1)
        for both in place.on.values():
            for s in both:
                if s:
                    give(s)

    for t, place in places.items():
        if not out or used > MOST_CELLS:
            out.append(([], 0))
            used = 0
        give(place)
        out[-1] = ([*out[-1][0], t], used)
    return out


def _counted(coded: Coded, places: dict[str, _Shared], cells: int) -> np.ndarray:
    """One pass: the cells of all places, by the column that says how often they count a row."""
    trees = {c: place.told() for c, place in places.items()}
    kept = ["fold"] * ("fold" in coded.rows.columns)
    rows = coded.rows.select(*kept, "label", PACKED, *[F.col(c).cast("bigint").alias(c) for c in trees])
    told = rows.mapInArrow(_counter(trees, coded.digits, coded.folds, coded.classes, cells, PACKED, ROWS_AT_ONCE), "cell int, n bigint")
    told = told.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(cells, dtype=np.int64)
    out[told["cell"].to_numpy()] = told["n"].to_numpy()
    return out


def _counter(trees: dict[str, tuple], digits: list[tuple[int, int]], folds: int, classes: int, cells: int, packed: str, at_once: int) -> Callable:
    """For ``mapInArrow``: the cells that are not 0.  Nothing in it refers to this module, so workers need not have it."""
    width = folds * classes

    def count(batches):
        import numpy as np
        import pyarrow as pa

        out = np.zeros(cells, dtype=np.float64)   # whole numbers below 2 ** 53

        def visit(place, rows, base, drawn, codes):
            need, raw, splits = place
            if raw is not None:
                out[raw:raw + folds] += np.bincount(base // classes, minlength=folds)
            for j, at in need:
                size = width * digits[j][1]
                out[at:at + size] += np.bincount(base * digits[j][1] + codes[j][rows], weights=drawn, minlength=size)
            for j, right, no, yes in splits:
                goes = right[codes[j][rows]]
                for child, some in ((no, ~goes), (yes, goes)):
                    if child is not None:
                        visit(child, rows[some], base[some], drawn[some], codes)

        def work(held):
            table = pa.Table.from_batches(held)
            number = table[packed].to_numpy()
            codes = [(number // before % size).astype(np.int16) for before, size in digits]
            base = table["label"].to_numpy().astype(np.int64)
            if "fold" in table.column_names:
                base = base + table["fold"].to_numpy().astype(np.int64) * classes
            for name, place in trees.items():
                drawn = table[name].to_numpy()
                rows = np.flatnonzero(drawn)
                visit(place, rows, base[rows], drawn[rows].astype(np.float64), codes)

        held, n = [], 0
        for b in batches:
            held, n = [*held, b], n + b.num_rows
            if n >= at_once:
                work(held)
                held, n = [], 0
        if n:
            work(held)
        told = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(told.astype(np.int32)), pa.array(out[told].astype(np.int64))], names=["cell", "n"])

    return count


# --- scores -----------------------------------------------------------------------

def _shares(node: Node) -> np.ndarray:
    """A leaf's class shares, as a forest of one tree gives them."""
    votes = node.stats / float(node.stats.sum())
    return votes / float(votes.sum())


def _told(node: Node) -> tuple:
    return (node.column, node.right, *map(_told, node.children)) if node.children else (_shares(node),)


def score(rows: DataFrame, coded: Coded, forests: dict[int, list[Node]], keep: list[str], prob_cols: tuple[str, ...]) -> DataFrame:
    """Columns ``keep`` and the class shares of rows that have ``fold`` and ``PACKED``: mean of the shares of the trees of their fold's forest."""
    told = {f: [_told(t) for t in trees] for f, trees in forests.items()}
    schema = T.StructType([*[T.StructField(c, rows.schema[c].dataType) for c in keep], *[T.StructField(p, T.DoubleType()) for p in prob_cols]])
    return rows.select(*dict.fromkeys([*keep, "fold", PACKED])).mapInArrow(_scorer(told, coded.digits, PACKED, keep, list(prob_cols)), schema)


def _scorer(forests: dict[int, list[tuple]], digits: list[tuple[int, int]], packed: str, keep: list[str], names: list[str]) -> Callable:
    def scored(batches):
        import numpy as np
        import pyarrow as pa

        def visit(node, rows, codes, out):
            if len(node) == 1:
                out[rows] += node[0]
                return
            column, right, no, yes = node
            goes = right[codes[column][rows]]
            for child, some in ((no, ~goes), (yes, goes)):
                visit(child, rows[some], codes, out)

        for b in batches:
            number = b.column(packed).to_numpy(zero_copy_only=False)
            codes = [(number // before % size).astype(np.int16) for before, size in digits]
            fold = b.column("fold").to_numpy(zero_copy_only=False)
            shares = np.full((b.num_rows, len(names)), np.nan)
            for f, trees in forests.items():
                rows = np.flatnonzero(fold == f)
                classes = next(len(n[0]) for n in _leaves(trees[0]))
                out = np.zeros((b.num_rows, classes))
                for tree in trees:
                    visit(tree, rows, codes, out)
                shares[rows] = out[rows, :len(names)] / len(trees)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *[pa.array(shares[:, i]) for i in range(len(names))]], names=[*keep, *names])

    def _leaves(node):
        return [node] if len(node) == 1 else [*_leaves(node[2]), *_leaves(node[3])]

    return scored


# --- models -----------------------------------------------------------------------

def tree_models(spark: SparkSession, coded: Coded, trees: list[Node], held_out: int | None = None) -> list[RandomForestClassificationModel]:
    """The trees as Spark's models of one tree each, over the vectors of the encoder that has the same categories."""
    jvm, gateway, width = spark._jvm.org.apache.spark, spark.sparkContext._gateway, len(coded.features(held_out))

    def doubles(values) -> object:
        out = gateway.new_array(gateway.jvm.double, len(values))
        for i, v in enumerate(values):
            out[i] = float(v)
        return out

    def built(node: Node) -> object:
        stats = jvm.mllib.tree.impurity.GiniCalculator(doubles(node.stats.tolist()), 1)
        if not node.children:
            return jvm.ml.tree.LeafNode(float(node.prediction), float(node.impurity), stats)
        if node.threshold is None:
            split = jvm.ml.tree.CategoricalSplit(node.feature, doubles([0.0]), 2)
        else:
            split = jvm.ml.tree.ContinuousSplit(node.feature, float(node.threshold))
        return jvm.ml.tree.InternalNode(float(node.prediction), float(node.impurity), float(node.gain), *map(built, node.children), split, stats)

    out = []
    for tree in trees:
        classes = len(tree.stats)
        one = gateway.new_array(jvm.ml.classification.DecisionTreeClassificationModel, 1)
        one[0] = jvm.ml.classification.DecisionTreeClassificationModel(Identifiable()._randomUID().replace("Identifiable", "dtc"), built(tree), width, classes)
        uid = Identifiable()._randomUID().replace("Identifiable", "RandomForestClassifier")
        model = RandomForestClassificationModel(jvm.ml.classification.RandomForestClassificationModel(uid, one, width, classes))
        out.append(model._set(numTrees=1, bootstrap=False))
    return out
