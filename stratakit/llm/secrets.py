"""Secret scans: patterns, and the entropy of a window that slides over candidate strings.

A candidate is a run of at least ``WINDOW`` characters that keys and tokens are made of.  For
every class of characters the window slides over the candidate's stretches of that class; the
counts of its characters change by one in and one out, and with them the sum of
``c * log2(c)``, kept in integers so that it does not drift.  A window whose entropy reaches
the class's threshold, and that mixes the kinds of characters the class asks for, is part of
a secret unless the allow-list knows the candidate.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

WINDOW = 20
#: Entropies are compared as integers, in units of 2 ** -32 bits times the window.
UNIT = 1 << 32
CLOG = [0] + [round(c * math.log2(c) * UNIT) for c in range(1, WINDOW + 1)]

DIGIT, LOWER, UPPER = 1, 2, 4
KIND = {**dict.fromkeys("0123456789", DIGIT), **dict.fromkeys("abcdefghijklmnopqrstuvwxyz", LOWER),
        **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER)}


class Class(NamedTuple):
    name: str
    stretch: re.Pattern
    bits: float  # entropy from which a window is a secret's
    needs: int   # kinds of characters the window must have


#: Random windows of 20 have 3.4 bits over 16 characters, 3.8 over 36 and 4.1 over 64; prose and numbers have less or lack a kind.
CLASSES = (
    Class("hex", re.compile(r"[0-9a-f]{20,}"), 2.9, DIGIT | LOWER),
    Class("hex", re.compile(r"[0-9A-F]{20,}"), 2.9, DIGIT | UPPER),
    Class("lower", re.compile(r"[0-9a-z]{20,}"), 3.5, DIGIT | LOWER),
    Class("upper", re.compile(r"[0-9A-Z]{20,}"), 3.5, DIGIT | UPPER),
    Class("base64", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 3.7, DIGIT | LOWER | UPPER),
)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Strings that look random but are public: matched against the whole candidate ...
ALLOWED = re.compile(
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"  # UUID
    r"|sha(?:1|224|256|384|512)[-=:][A-Za-z0-9+/=_-]+"  # digests that name themselves
    r"|.*(?:EXAMPLE|example|0123456789|abcdefghij|ABCDEFGHIJ).*")  # samples and alphabets
#: ... and against what stands before it: names of digests, a path or address it is part of.
ALLOWED_AFTER = re.compile(r"(?:(?:\bsha(?:1|224|256|384|512)|\bmd5|\bcommit|\betag|\bchecksum|\bintegrity)[\"']?[\x20:=-]{0,3}[\"']?"
                           r"|://[^\x20\x09-\x0D\"'<>]*|;base64,)$", re.I | re.A)
BEFORE = 256

BASE = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the plain patterns, leftmost and non-overlapping within a kind."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return found


def windows(stretch: str, bits: float, needs: int) -> Iterator[int]:
    """Starts of the windows that reach the entropy and have the kinds."""
    least = round((WINDOW * math.log2(WINDOW) - WINDOW * bits) * UNIT)  # the sum may be at most this
    counts: dict[str, int] = {}
    kinds = {DIGIT: 0, LOWER: 0, UPPER: 0}
    total = 0
    for i, c in enumerate(stretch):
        if i >= WINDOW:
            out = stretch[i - WINDOW]
            n = counts[out]
            total += CLOG[n - 1] - CLOG[n]
            counts[out] = n - 1
            if out in KIND:
                kinds[KIND[out]] -= 1
        n = counts.get(c, 0)
        total += CLOG[n + 1] - CLOG[n]
        counts[c] = n + 1
        if c in KIND:
            kinds[KIND[c]] += 1
        if i >= WINDOW - 1 and total <= least and all(kinds[k] for k in kinds if needs & k):
            yield i - WINDOW + 1


def entropy_spans(text: str) -> list[tuple[int, int]]:
    """Spans of high entropy: windows that lie less than a window apart in one candidate are
    one span, which takes in an end of the candidate too short for a window of its own."""
    spans = []
    for m in CANDIDATE.finditer(text):
        if ALLOWED.fullmatch(m[0]) or ALLOWED_AFTER.search(text[max(0, m.start() - BEFORE):m.start()]):
            continue
        starts = sorted({s.start() + w for c in CLASSES for s in c.stretch.finditer(m[0])
                         for w in windows(s[0], c.bits, c.needs)})
        own: list[list[int]] = []
        for s in starts:
            if own and s - own[-1][1] < WINDOW:
                own[-1][1] = s + WINDOW
            else:
                own.append([s, s + WINDOW])
        if own:
            if own[0][0] < WINDOW:
                own[0][0] = 0
            if len(m[0]) - own[-1][1] < WINDOW:
                own[-1][1] = len(m[0])
        spans += [(m.start() + a, m.start() + z) for a, z in own]
    return spans


def find(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and those that the entropy adds (none inside a base span), each in order."""
    base = sorted(base_spans(text), key=lambda s: (s[0], BASE.index(s[2])))
    more = [(a, z, "entropy") for a, z in entropy_spans(text) if not any(x <= a and z <= y for x, y, _ in base)]
    return base, more


def _told(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for a, z, k in spans)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_assign, n_access, n_hex, base_spans, n_entropy, spans``, one row a row of ``docs``.

    Spans are ``kind:start:end`` in code points, comma-joined, by start and then kind (assign,
    access, hex, entropy).  Null texts count as empty and have none; repeated rows and null
    ids are rows like any other; an empty table gives no rows; other columns are not
    read.  Whole texts are searched, one in memory at a time beside its batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "n_assign", "n_access", "n_hex", "base_spans", "n_entropy", "spans"]
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.string()]
        for b in batches:
            rows = []
            for text in b.column(1):
                base, more = find(text.as_py())
                count = [sum(k == kind for _, _, k in base) for kind in BASE]
                every = sorted([*base, *more], key=lambda s: (s[0], (*BASE, "entropy").index(s[2])))
                rows.append((*count, _told(base), len(more), _told(every)))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, whole_text(text_col).alias("__text")).mapInArrow(
        run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_spans string, n_entropy long, spans string")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by ``[SECRET]`` (overlapping spans together); a null text stays null."""

    def clean(text: str) -> str:
        base, more = find(text)
        out, at = [], 0
        merged: list[list[int]] = []
        for a, z, _ in sorted([*base, *more]):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(z, merged[-1][1])
            else:
                merged.append([a, z])
        for a, z in merged:
            out += [text[at:a], "[SECRET]"]
            at = z
        return "".join([*out, text[at:]])

    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b.column(place)]
            done = pa.array([t if t is None else clean(t) for t in texts], b.column(place).type)
            yield pa.RecordBatch.from_arrays([*b.columns[:place], done, *b.columns[place + 1:]], b.schema.names)

    return docs.mapInArrow(run, docs.schema)
