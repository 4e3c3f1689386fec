"""License scans by conditional compression.

Candidate blocks are lines with a license word, joined where few lines lie
between.  A notice is looked for in a block and as many words on both sides as the longest
template can take.  A text is compressed alone and with each template as a zstandard
raw dictionary; the templates are ranked by how much smaller it gets, and the first in
rank whose wording differs little enough from the text is its license.  The
difference is exact, in words: those of the template that the text lacks and those
that the text has between the template's words.  The license's words are taken out and
what is left on both sides is searched again, until no template is confirmed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Wordings of common notices.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction, including without limitation the rights to "
            "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("All rights reserved", "All rights reserved."),
)
HINT = (r"(?i)licen[cs]e|copyright|rights[\W_]+reserved|permission|redistribut|public[\W_]+domain|"
        r"creative[\W_]+commons|spdx")
#: Lines without a hint that may lie inside a block.
GAP = 2
#: Largest share of the template's words that may differ.
MAX_DIFFERENCE = 0.1
#: Words that change what a license is; none of them may differ.
DECISIVE = frozenset("not no non without only affero lesser nc nd sa by cc0 mit apache gnu gpl mozilla bsd isc".split())
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[str, ...]
    packer: zstandard.ZstdCompressor


def words(text: str) -> list[str]:
    """Lower-case words; numbers keep their inner points."""
    return _WORD.findall(text.lower())


def packers() -> tuple[zstandard.ZstdCompressor, list[Template]]:
    plain = zstandard.ZstdCompressor(level=3)
    return plain, [Template(name, tuple(words(text)), zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(
        text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))) for name, text in TEMPLATES]


#: Words that a notice takes at most.
REACH = int(max(len(words(text)) for _, text in TEMPLATES) * (1 + MAX_DIFFERENCE)) + 1


def blocks(text: str, gap: int = GAP) -> list[tuple[int, int]]:
    """Candidate blocks as ``(start, end)``, code points: lines that a hint touches, joined
    over at most ``gap`` lines without one."""
    out, at, quiet = [], 0, gap + 1
    hints = [m.span() for m in re.finditer(HINT, text)]
    k = 0
    for line in text.split("\n"):
        while k < len(hints) and hints[k][1] <= at:
            k += 1
        if k < len(hints) and hints[k][0] < at + len(line):
            if out and quiet <= gap:
                out[-1] = out[-1][0], at + len(line)
            else:
                out.append((at, at + len(line)))
            quiet = 0
        else:
            quiet += 1
        at += len(line) + 1
    return out


@dataclass(frozen=True)
class Match:
    """Words ``start`` to ``end`` of a text against a template; ``longest`` is the
    longest run of equal words."""

    start: int
    end: int
    longest: tuple[int, int]
    missing: list[str]
    extra: list[str]

    def confirms(self, template: tuple[str, ...]) -> bool:
        return (len(self.missing) + len(self.extra) <= MAX_DIFFERENCE * len(template)
                and not any(w in DECISIVE or w[0].isdigit() for w in (*self.missing, *self.extra)))


def match(template: tuple[str, ...], block: list[str]) -> Match:
    """The runs of equal words, in order, without those at either end that lie
    farther off than they are long."""
    found = [m for m in SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
    if not found:
        return Match(0, 0, (0, 0), list(template), [])
    best, first, since, value = (0, 0, 0), 0, 0, 0
    for k, m in enumerate(found):
        value -= m.b - found[k - 1].b - found[k - 1].size if k else 0
        if value <= 0:
            value, since = 0, k
        value += m.size
        if value > best[0]:
            best = value, since, k + 1
    found = found[best[1]:best[2]]
    missing, extra, a, b = list(template[:found[0].a]), [], found[0].a, found[0].b
    for m in found:
        missing += template[a:m.a]
        extra += block[b:m.b]
        a, b = m.a + m.size, m.b + m.size
    run = max(found, key=lambda m: m.size)
    return Match(found[0].b, b, (run.b, run.b + run.size), missing + list(template[a:]), extra)


def difference(template: tuple[str, ...], block: list[str]) -> tuple[list[str], list[str]]:
    """Words of the template that the block lacks, and words of the block between
    the first and the last of the template's."""
    m = match(template, block)
    return m.missing, m.extra


def locate(template: tuple[str, ...], own: list[str], start: int, end: int) -> Match | None:
    """A confirmed match within words ``start`` to ``end``, if there is one beside
    the longest runs."""
    have = set(own[start:end])
    lacks = [w for w in template if w not in have]
    if len(lacks) > MAX_DIFFERENCE * len(template) or any(w in DECISIVE or w[0].isdigit() for w in lacks):
        return None
    m = match(template, own[start:end])
    if m.confirms(template):
        return Match(start + m.start, start + m.end, m.longest, m.missing, m.extra)
    left, right = m.longest
    if left == right:
        return None
    return locate(template, own, start, start + left) or locate(template, own, start + right, end)


def identify(block: str, plain: zstandard.ZstdCompressor, templates: list[Template]) -> tuple[str | None, int, list[str], list[str]]:
    """``(license, reduction, missing, extra)`` of a block; the license is None if
    no template in rank order is confirmed, and then the rest is the first one's."""
    own = words(block)
    first = None
    for reduction, k in ranked(block.lower().encode(), plain, templates):
        t = templates[-k]
        m = match(t.words, own)
        first = first or (None, reduction, m.missing, m.extra)
        if m.confirms(t.words):
            return t.name, reduction, m.missing, m.extra
    return first or (None, 0, [], [])


def ranked(data: bytes, plain: zstandard.ZstdCompressor, templates: list[Template]) -> list[tuple[int, int]]:
    """``(reduction, -number)`` of the templates that make the text smaller, the best first."""
    alone = len(plain.compress(data))
    return sorted(((r, -k) for k, t in enumerate(templates) if (r := alone - len(t.packer.compress(data))) > 0), reverse=True)


def _within(text: str, at: list[tuple[int, int]], own: list[str], start: int, end: int,
            plain: zstandard.ZstdCompressor, templates: list[Template]) -> list[tuple[Match, str, int]]:
    """All confirmed matches in words ``start`` to ``end``, with license and reduction: the templates
    are tried in the order of what they save as dictionaries, the first confirmed one
    wins (over its own words ranked again, where another may save more), and what lies
    before and after it is searched in turn."""

    def best(a: int, b: int) -> tuple[Match, str, int] | None:
        data = text[at[a][0]:at[b - 1][1]].lower().encode()
        return next(((m, templates[-k].name, reduction) for reduction, k in ranked(data, plain, templates)
                     if (m := locate(templates[-k].words, own, a, b))), None)

    out, parts = [], [(start, end)]
    while parts:
        a, b = parts.pop()
        found = best(a, b) if a < b else None
        if found:
            found = best(found[0].start, found[0].end) or found
            out.append(found)
            parts += [(a, found[0].start), (found[0].end, b)]
    return sorted(out, key=lambda x: x[0].start)


def notices(text: str, plain: zstandard.ZstdCompressor,
            templates: list[Template]) -> list[tuple[int, int, str | None, int, list[str], list[str]]]:
    """``(start, end, license, reduction, missing, extra)`` of a text: a row per
    license of a block, which is widened to the licenses' lines, or one
    without a license."""
    hinted = blocks(text)
    if not hinted:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    own, starts = [text[a:b].lower() for a, b in at], [a for a, _ in at]
    areas: list[list[int]] = []
    for a, b in hinted:
        area = [max(0, bisect_left(starts, a) - REACH), min(len(at), bisect_right(starts, b) + REACH)]
        if areas and area[0] <= areas[-1][1]:
            areas[-1][1] = area[1]
        else:
            areas.append(area)
    found = []
    for a, b in areas:
        while a < b:  # parts that overlap by more than a notice, so that the work is in proportion to the text
            end = min(b, a + 4 * REACH)
            sure = b if end == b else end - 2 * REACH
            hits = _within(text, at, own, a, end, plain, templates)
            found += [h for h in hits if h[0].end <= sure]
            a = min([sure, *(h[0].start for h in hits if h[0].end > sure)])
    spans = [(a, b, None) for a, b in hinted]
    for h in found:
        a, b = at[h[0].start][0], at[h[0].end - 1][1]
        after = text.find("\n", b)
        spans.append((text.rfind("\n", 0, a) + 1, len(text) if after < 0 else after, h))
    joined: list[tuple[int, int, list]] = []
    for a, b, h in sorted(spans, key=lambda x: (x[0], x[2] is not None, x[2][0].start if x[2] else 0)):
        if joined and a <= joined[-1][1]:
            joined[-1] = joined[-1][0], max(b, joined[-1][1]), joined[-1][2]
        else:
            joined.append((a, b, []))
        if h:
            joined[-1][2].append(h)
    out = []
    for a, b, hits in joined:
        out += [(a, b, name, reduction, m.missing, m.extra) for m, name, reduction in hits]
        if not hits:
            out.append((a, b, *identify(text[a:b], plain, templates)))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per license of each candidate block: ``doc_id, start, end, license,
    reduction, missing, extra`` (the block's code points, end exclusive); a block
    without a confirmed license has one row, its ``license`` null.

    Null and empty texts have no blocks; repeated rows have theirs each; an
    empty table gives no rows.  Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, templates = packers()
        for b in batches:
            of, rows = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                for start, end, name, reduction, missing, extra in notices(text, plain, templates):
                    of.append(i)
                    rows.append((start, end, name, reduction, " ".join(missing), " ".join(extra)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "start", "end", "license", "reduction", "missing", "extra"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    return docs.filter(text.rlike(HINT)).select(F.col(id_col), text).mapInArrow(
        run, f"doc_id {kind}, start long, end long, license string, reduction long, missing string, extra string")
