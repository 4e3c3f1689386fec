"""Conversation structure repair: grammar-compressed dynamic programming.

A conversation's rows become symbols of their role and fault.  A symbol is a
min-plus matrix over the states of the wanted role sequence ``(s?(ua)+)?``: the cost
and the audit of the cheapest edits that lead from one state to another over this
row.  Re-Pair finds a grammar of a batch's distinct symbol sequences; each rule's
matrix is the product of its two parts, so what conversations have in common is
worked out once.

Edits: Keep 0, Rerole 1, Delete 2, Insert 5 (before the row); an undeleted truncated
row 5 more.  Inserts stand before a row's own edit, therefore audits over the same rows
end in a row's edit and none is the beginning of another.  So ties are settled without
comparing audits: an entry holds the rank of its audit among those from the same
state, the audit of a product ranks by its first part, then by its second, and is
only spelled out (the rope) for what a block returns.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_once
from .common import SPACE

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Rows a block, in which a conversation is cut.
BLOCK = 1024
#: Symbols that one grammar is made of at most (one block more at the end).
GRAMMAR = 1 << 14
#: What a row of this role initial leads to.
KEEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Inserts that complete the sequence from each state.
TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
#: Row symbols: initial, or ``o`` for another; upper case if truncated; these two must go.
BLANK, DUPLICATE = "b", "d"
#: Characters that end no text.
BLANKS = " \t\n\v\f\r"

Matrix = dict[tuple[int, int], tuple[int, int]]


def row_edits(symbol: str) -> dict[tuple[int, int], tuple[int, str]]:
    """``(cost, audit)`` of the cheapest edits for one row, inserts before it included."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start in STATES:
        state, inserted = start, ""
        for _ in range(3):  # after two inserts states repeat, at a cost
            base = INSERT * len(inserted)
            options = [(state, DELETE, "D")]
            if symbol not in (BLANK, DUPLICATE):
                more = TRUNCATED if symbol.isupper() else 0
                options.append((NEXT[state], REROLE + more, "R"))
                to = KEEPS.get(symbol.lower(), {}).get(state)
                if to is not None:
                    options.append((to, KEEP + more, "K"))
            for to, cost, edit in options:
                entry = base + cost, inserted + edit
                best[start, to] = min(best.get((start, to), entry), entry)
            state, inserted = NEXT[state], inserted + "I"
    return best


class Solver:
    """Matrices of symbols and pairs, each made once.  A node is a row symbol or a pair of nodes."""

    def __init__(self) -> None:
        self.matrix: list[Matrix] = []
        self.parts: list[tuple[int, int] | str] = []
        self.via: list[dict[tuple[int, int], int | str]] = []  # the state between the parts, or a row's audit
        self._row: dict[str, int] = {}
        self._pair: dict[tuple[int, int], int] = {}

    def _new(self, part, matrix: Matrix, via) -> int:
        self.parts.append(part)
        self.matrix.append(matrix)
        self.via.append(via)
        return len(self.parts) - 1

    def row(self, symbol: str) -> int:
        if symbol not in self._row:
            edits = row_edits(symbol)
            ranks = {e: sorted(edits[x][1] for x in edits if x[0] == e[0]).index(edits[e][1]) for e in edits}
            self._row[symbol] = self._new(symbol, {e: (edits[e][0], ranks[e]) for e in edits},
                                          {e: audit for e, (_, audit) in edits.items()})
        return self._row[symbol]

    def pair(self, a: int, b: int) -> int:
        if (a, b) not in self._pair:
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            for (i, k), (cost, rank) in self.matrix[a].items():
                for j in STATES:
                    if (k, j) in self.matrix[b]:
                        entry = cost + self.matrix[b][k, j][0], rank, k
                        best[i, j] = min(best.get((i, j), entry), entry)
            matrix: Matrix = {}
            for i in STATES:
                ends = sorted((rank, self.matrix[b][k, j][1], j) for (s, j), (_, rank, k) in best.items() if s == i)
                for place, (_, _, j) in enumerate(ends):
                    matrix[i, j] = best[i, j][0], place
            self._pair[a, b] = self._new((a, b), matrix, {e: k for e, (_, _, k) in best.items()})
        return self._pair[a, b]

    def audit(self, at: int, i: int, j: int) -> str:
        """The rope of an entry, spelled out."""
        out, todo = [], [(at, i, j)]
        while todo:
            at, i, j = todo.pop()
            via = self.via[at][i, j]
            if isinstance(via, str):
                out.append(via)
            else:
                a, b = self.parts[at]
                todo += [(b, via, j), (a, i, via)]
        return "".join(out)


def re_pair(sequences: list[list[int]], join) -> list[list[int]]:
    """Replaces the pair of neighbours found most often by ``join(pair)`` until none is found twice."""
    symbol: list[int | None] = []
    for s in sequences:
        symbol += [*s, None]
    n = len(symbol)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], set[int]] = defaultdict(set)

    def pair(p: int):
        q = after[p] if 0 <= p < n else n
        if not 0 <= p < n or q >= n or symbol[p] is None or symbol[q] is None:
            return None
        return symbol[p], symbol[q]

    for p in range(n - 1):
        if (found := pair(p)) is not None:
            places[found].add(p)
    heap = [(-len(at), pair_) for pair_, at in places.items()]
    heapq.heapify(heap)
    while heap:
        count, most = heapq.heappop(heap)
        if len(places[most]) != -count:
            if len(places[most]) > 1:
                heapq.heappush(heap, (-len(places[most]), most))
            continue
        if count > -2:
            break
        made, touched = join(*most), set()
        for p in sorted(places.pop(most)):
            if pair(p) != most:  # it overlapped the one before
                continue
            q = after[p]
            for x in (before[p], q):
                if (old := pair(x)) is not None and old != most:
                    places[old].discard(x)
            symbol[p], after[p] = made, after[q]
            symbol[q] = None
            if after[q] < n:
                before[after[q]] = p
            for x in (before[p], p):
                if (new := pair(x)) is not None:
                    places[new].add(x)
                    touched.add(new)
        for new in touched:
            heapq.heappush(heap, (-len(places[new]), new))
    out, p = [], 0
    for _ in sequences:
        row = []
        while symbol[p] is not None:
            row.append(symbol[p])
            p = after[p]
        out.append(row)
        p += 1
    return out


def solve(texts: list[str], solver: Solver) -> list[int]:
    """One node a symbol sequence, by the grammar of them all."""
    done = []
    for row in re_pair([[solver.row(c) for c in t] for t in texts], solver.pair):
        node = row[0]
        for x in row[1:]:
            node = solver.pair(node, x)
        done.append(node)
    return done


def _solved(blocks: DataFrame) -> DataFrame:
    """Adds ``cost, rank, audits`` by state before and after (4 times the one plus the other); null where there is no way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("symbols").to_pylist()
            told, part, size = {}, [], 0
            distinct = list(dict.fromkeys(texts))
            for x, t in enumerate(distinct):
                part.append(t)
                size += len(t) + 1
                if size >= GRAMMAR or x == len(distinct) - 1:
                    solver = Solver()
                    for text, at in zip(part, solve(part, solver), strict=True):
                        m = [solver.matrix[at].get((i, j)) for i in STATES for j in STATES]
                        told[text] = ([e and e[0] for e in m], [e and e[1] for e in m],
                                      [e and solver.audit(at, *divmod(x, 4)) for x, e in enumerate(m)])
                    part, size = [], 0
            made = list(zip(*(told[t] for t in texts), strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *(pa.array(c, pa.list_(k)) for c, k in zip(made, (pa.int64(), pa.int32(), pa.string()), strict=True))],
                [*b.schema.names, "cost", "rank", "audits"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema)
    return blocks.mapInArrow(run, f"{schema}, cost array<long>, rank array<int>, audits array<string>")


class _Conversation:
    """One conversation as it streams by: its blocks first, then its rows."""

    def __init__(self) -> None:
        self.ways = {START: (0, 0, None)}  # by state: cost, rank of the audit, audit as a rope of blocks
        self.symbols: list[str] = []

    def block(self, symbols: str, cost: list, rank: list, audits: list) -> None:
        self.symbols.append(symbols)
        best = {}
        for i, (paid, place, _) in self.ways.items():
            for j in STATES:
                if (c := cost[4 * i + j]) is not None:
                    entry = paid + c, place, i
                    best[j] = min(best.get(j, entry), entry)
        order = sorted(best, key=lambda j: (best[j][1], rank[4 * best[j][2] + j]))
        self.ways = {j: (best[j][0], order.index(j), (self.ways[best[j][2]][2], audits[4 * best[j][2] + j])) for j in best}

    def close(self) -> None:
        """The cheapest way; from here on `row` follows its audit."""
        self.cost, _, end = min((cost + INSERT * len(TAIL[j]), place, j) for j, (cost, place, _) in self.ways.items())
        parts, rope = [TAIL[end]], self.ways[end][2]
        while rope is not None:
            rope, part = rope
            parts.append(part)
        self.audit, self.faults = "".join(reversed(parts)), "".join(self.symbols)
        self.at = self.n = self.illegal = self.turns = 0
        self.state, self.last, self.turn, self.first = START, None, None, None
        self.ways = self.symbols = None

    def _inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            self.state = NEXT[self.state]
            yield "I", NAMES[self.state], ""

    def row(self, turn, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """``(edit, role, text)`` of the repaired turns up to this row."""
        if self.last is not None and self.last + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = role[:1]
        if turn is not None:
            if self.first is None:
                self.first = turn
            self.turns += turn != self.turn
            self.turn = turn
        yield from self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        self.n += 1
        if edit == "K":
            self.state = KEEPS[role[:1]][self.state]
            yield edit, role, text
        elif edit == "R":
            self.state = NEXT[self.state]
            yield edit, NAMES[self.state], text

    def end(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserts()

    def counts(self) -> list[int]:
        gaps = 0 if self.first is None else self.turn - self.first + 1 - self.turns
        cut = sum(c.isupper() for c in self.faults)
        return [gaps, self.faults.count(BLANK), self.faults.count(DUPLICATE), cut, self.illegal, self.cost]


def _streams(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Each conversation's solved blocks (``kind`` 0), then its rows in order (1), together within a partition."""
    rows = conversations.select(
        F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(" ")).alias("text"))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin(*KEEPS), initial).otherwise("o")
    ended = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1)).isin(*".!?")
    own = F.when(~F.col("text").rlike(rf"[^{SPACE}]"), BLANK).when(ended, kind).otherwise(F.upper(kind))
    same = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    order = ["conv_id", "turn", "role", "same", "tie"]
    rows = write_once(rows.select("*", own.alias("own"), same.alias("same"), F.monotonically_increasing_id().alias("tie"))
                      .repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
                      .withColumn("at", F.monotonically_increasing_id()), "repair-rows")  # ``at`` ascends in a conversation
    # Joined by place, of which every row has its own: a text that fills a conversation meets no one key.
    first = rows.groupBy("conv_id", "same").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    symbol = F.when((F.col("own") != BLANK) & F.col("new").isNull(), DUPLICATE).otherwise(F.col("own"))
    listed = F.array_sort(F.collect_list(F.struct("at", symbol.alias("symbol"))))
    blocks = (rows.select("conv_id", "at", "own").join(first, "at", "left")
              .groupBy("conv_id", F.floor(F.col("at") / BLOCK).alias("block")).agg(listed.alias("listed"))
              .select("conv_id", "block", F.array_join("listed.symbol", "").alias("symbols")))
    solved = _solved(blocks).select("conv_id", F.lit(0).alias("kind"), F.col("block").alias("at"), "symbols", "cost", "rank", "audits")
    rows = rows.select("conv_id", F.lit(1).alias("kind"), "at", "turn", "role", "text")
    return (solved.unionByName(rows, allowMissingColumns=True)
            .repartition("conv_id").sortWithinPartitions("conv_id", "kind", "at"))


def _each(batches: Iterator[pa.RecordBatch]):
    """``(conversation id, conversation, row or None)``: once a row, and None at its end."""
    now, told, closed = None, None, False
    for b in batches:
        names = ["turn", "role", "text", "symbols", "cost", "rank", "audits"]
        for kind, conv, *row in zip(*(b.column(c).to_pylist() for c in ["kind", "conv_id", *names]), strict=True):
            if kind == 0:
                if closed or told is None:
                    if told is not None:
                        yield now, told, None
                    now, told, closed = conv, _Conversation(), False
                told.block(*row[3:])
                continue
            if not closed:
                told.close()
                closed = True
            yield now, told, row[:3]
    if told is not None:
        yield now, told, None


def repaired(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
             role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, position, edit, role, text``: the turns after the cheapest edits, of
    which the audit is the least in ASCII order; ``edit`` is K, R or I.

    Rows are ordered by turn (null first), then role and the text's digest; equal rows are
    duplicates of the first.  Null roles and texts are one space, a null id is a
    conversation like any other, a role is known by its first letter (s, u, a).  An
    empty table gives no rows; other columns are not read.  Rows are faulted and solved
    in blocks of ``BLOCK`` anywhere; only the last step, whose result is a sequence, streams a
    conversation through one task, which holds its symbols and audit (a byte a row) but no texts."""
    streams = _streams(conversations, conv_col, turn_col, role_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, out = None, []

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [ids, pa.int64(), *[pa.string()] * 3], strict=True)],
                ["conv_id", "position", "edit", "role", "text"])

        def watched():
            nonlocal ids
            for b in batches:
                ids = b.column("conv_id").type
                yield b

        position, before = 0, None
        for conv, told, row in _each(watched()):
            if told is not before:
                position, before = 0, told
            for turn in (told.row(*row) if row else told.end()):
                out.append((conv, position, *turn))
                position += 1
            if len(out) >= 1000:
                yield flush()
                out = []
        if out:
            yield flush()

    kind = streams.schema["conv_id"].dataType.simpleString()
    return streams.mapInArrow(run, f"conv_id {kind}, position long, edit string, role string, text string")


def report(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
           role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``, one row a
    conversation, by the rules of `repaired`.  The digest is that of ``role:text`` of the repaired
    turns, joined by newlines."""
    streams = _streams(conversations, conv_col, turn_col, role_col, text_col)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, out = None, []

        def flush():
            kinds = [ids, *[pa.int64()] * len(counts), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                                              ["conv_id", *counts, "audit", "repaired_sha256"])

        def watched():
            nonlocal ids
            for b in batches:
                ids = b.column("conv_id").type
                yield b

        before, hashed, some = None, None, False
        for conv, told, row in _each(watched()):
            if told is not before:
                before, hashed, some = told, sha256(), False
            for _, role, text in (told.row(*row) if row else told.end()):
                hashed.update((f"\n{role}:{text}" if some else f"{role}:{text}").encode())
                some = True
            if row is None:
                out.append((conv, *told.counts(), told.audit, hashed.hexdigest()))
                if len(out) >= 1000:
                    yield flush()
                    out = []
        if out:
            yield flush()

    kind = streams.schema["conv_id"].dataType.simpleString()
    longs = ", ".join(f"{c} long" for c in counts)
    return streams.mapInArrow(run, f"conv_id {kind}, {longs}, audit string, repaired_sha256 string")
