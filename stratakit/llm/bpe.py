"""BPE encoding and decoding with bounded lookahead.

Encoding
--------
A merge list decides, rule by rule, whether the boundary right of a token
survives.  Whether rule ``(u, v)`` fires at a boundary depends on the symbols
of ``v`` and on whether something steals the end of ``v`` first, that is on an
earlier rule whose left part is a node on the right spine of ``v``.  So

    reach(u, v) = len(v) + max(reach(r) for earlier rules r contesting v's end)

and ``lookahead = max(reach)`` symbols right of a boundary decide it for every
continuation.  `Transducer` keeps a window of a few lookaheads, merges it, and
emits the tokens whose ends lie at least ``lookahead`` symbols before the
window's edge; they never change again.  Its memory does not depend on the
length of the word.

Decoding
--------
`Decoder` is a byte-to-text state machine: ids become byte strings, and an
incremental UTF-8 decoder holds back the bytes of an unfinished character.
"""

from __future__ import annotations

import bisect
import codecs
import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain, islice, repeat

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose ids a worker remembers in each of two generations.  It bounds
#: memory only: a forgotten word is encoded again.
CACHE_WORDS = 150_000
_NO_RULE = 1 << 80
#: Ids that the decoder turns into text at a time.
DECODE_BLOCK = 1 << 16
#: Characters of a text that are encoded at a time, and ids of a word that are handed on at a time.
SEGMENT = 1 << 16


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level
    vocabularies: visible Latin-1 characters stand for themselves, the others
    follow from U+0100 in byte order."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class MergeTable:
    """Vocabulary and merge rules of a byte-level BPE with word-end marks,
    read from a ``tokenizers`` JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + end] for s in symbols]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("only plain added tokens are supported")
        self.names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        self.length = {i: 1 for i in (*self.inner, *self.final)}
        parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            u, v, w = vocab[left], vocab[right], vocab[left + right]
            if u not in self.length or v not in self.length:
                raise ValueError(f"merge {rank} uses a token that no earlier merge makes")
            if (u, v) in self.rules or w in parts:
                raise ValueError(f"merge {rank} repeats a pair or a token")
            self.rules[u, v] = (rank, w)
            parts[w] = (u, v, rank)
            self.length[w] = self.length[u] + self.length[v]
        #: Symbols of the longest token.
        self.longest = max(self.length.values())
        self.packed = {pair: rank << 32 | new for pair, (rank, new) in self.rules.items()}
        self.lookahead = self._lookahead(parts)
        back = {c: b for b, c in enumerate(symbols)}
        self.surface = {i: self._surface(s, end, back) for i, s in self.names.items()}

    def _surface(self, name: str, end: str, back: dict[str, int]) -> bytes:
        if name in self.special:
            return name.encode()
        stem = name[: -len(end)] if end and name.endswith(end) else name
        return bytes(back[c] for c in stem) + (b" " if stem != name else b"")

    def _lookahead(self, parts: dict[int, tuple[int, int, int]]) -> int:
        """Longest chain of rules of which each contests the end of the
        next one's right part (see the module's text)."""
        #: by left part: ranks so far and the running maximum of their reach
        seen: dict[int, tuple[list[int], list[int]]] = {}
        most = 0
        for (u, v), (rank, _) in self.rules.items():
            reach, node, until = 0, v, rank
            while True:
                if node in seen:
                    ranks, reaches = seen[node]
                    at = bisect.bisect_left(ranks, until)
                    if at:
                        reach = max(reach, reaches[at - 1])
                if node not in parts:
                    break
                _, child, made = parts[node]
                node, until = child, made
            reach += self.length[v]
            ranks, reaches = seen.setdefault(u, ([], []))
            ranks.append(rank)
            reaches.append(max(reach, reaches[-1] if reaches else 0))
            most = max(most, reach)
        return most

    def merge(self, seq: list[int]) -> list[int]:
        """All merges of a short sequence of symbols, lowest rank first."""
        get, none = self.packed.get, repeat(_NO_RULE)
        seq = list(seq)
        found = list(map(get, zip(seq, seq[1:]), none))
        while found and (best := min(found)) is not _NO_RULE:
            new, at = best & 0xFFFFFFFF, found.index(best)
            if found.count(best) > 1:  # all its places, left to right
                out = seq[:at]
                n = len(found)
                while at <= n:
                    if at < n and found[at] == best:
                        out.append(new)
                        at += 2
                    else:
                        out.append(seq[at])
                        at += 1
                seq = out
                found = list(map(get, zip(seq, seq[1:]), none))
                continue
            seq[at:at + 2] = (new,)
            del found[at]
            if at:
                found[at - 1] = get((seq[at - 1], new), _NO_RULE)
            if at < len(found):
                found[at] = get((new, seq[at + 1]), _NO_RULE)
        return seq


class Transducer:
    """Streaming encoder of one word: symbols in, stable tokens out.  The
    buffer never holds more than ``window`` symbols."""

    def __init__(self, table: MergeTable, lookahead: int | None = None):
        self.table = table
        self.lookahead = table.lookahead if lookahead is None else lookahead
        self.window = 2 * self.lookahead + table.longest
        self.buffer: list[int] = []

    def push(self, symbols: Iterable[int]) -> Iterator[int]:
        symbols = iter(symbols)
        while more := [*islice(symbols, self.window - len(self.buffer))]:
            self.buffer += more
            if len(self.buffer) >= self.window:
                yield from self._stable()

    def _stable(self) -> Iterator[int]:
        done, limit, length = 0, len(self.buffer) - self.lookahead, self.table.length
        for token in self.table.merge(self.buffer):
            if done + length[token] > limit:
                break
            done += length[token]
            yield token
        del self.buffer[:done]

    def finish(self) -> Iterator[int]:
        rest, self.buffer = self.buffer, []
        yield from self.table.merge(rest)


class Recent:
    """Values of recently used keys: when the young generation is full it
    becomes the old one, and what is still in use moves up again."""

    def __init__(self, make, size: int, longest: int = 64):
        self.make, self.size, self.longest = make, size, longest
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, key: str) -> bytes:
        """For keys that the caller hasn't found in ``young``."""
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self.young) >= self.size:
            self.old = dict(self.young)
            self.young.clear()
        self.young[key] = value
        return value


class Encoder:
    """Whole texts to ids, equal to the library's ``encode(text,
    add_special_tokens=False)`` for this kind of file: special strings are
    split off, the rest is composed (NFC), lower-cased character by character
    and cut into words."""

    WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    SPACE = regex.compile(r"\s+")
    #: Where a text may be cut: white space to both of the ways to split.
    CUT = regex.compile(r"[\x20\t\n\r]")
    #: str.split() also splits here, the word pattern doesn't.
    SEPARATORS = "\x1c\x1d\x1e\x1f"

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.table = MergeTable(path)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.table.special))) or r"(?!)")
        self.bytes_of = {i: struct.pack("<I", i) for i in self.table.names}
        self.words = Recent(self.word, cache_words)
        self.chunks = Recent(self.chunk, cache_words)

    def tokens(self, word: str) -> Iterator[int]:
        """Ids of one word as they become stable."""
        data, t = word.encode(), self.table
        machine = Transducer(t)
        yield from machine.push(chain(map(t.inner.__getitem__, memoryview(data)[:-1]), (t.final[data[-1]],)))
        yield from machine.finish()

    def word(self, word: str) -> bytes:
        """Packed ids (little-endian unsigned 32 bit) of one word."""
        return b"".join(map(self.bytes_of.__getitem__, self.tokens(word)))

    def chunk(self, chunk: str) -> bytes:
        """Packed ids of a stretch without white space."""
        text = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        text, known = text.lower(), self.words.young
        if text.isalpha():  # letters only: one word
            return known.get(text) or self.words(text)
        stem, last = text[:-1], text[-1:]
        if last in ".," and stem.isalpha():
            return (known.get(stem) or self.words(stem)) + (known.get(last) or self.words(last))
        return b"".join([known.get(w) or self.words(w) for w in self.WORD.findall(text)])

    def plain(self, text: str) -> list[bytes]:
        apart = any(c in text for c in self.SEPARATORS)
        chunks = self.SPACE.split(text) if apart else text.split()
        known = self.chunks.young
        found = [*map(known.get, chunks)]
        if None not in found:
            return found
        return [known.get(c) or self.chunks(c) if f is None else f for c, f in zip(chunks, found)]

    def part(self, text: str) -> bytes:
        """Packed ids of a text that begins and ends at white space or its own ends."""
        if "<|" not in text:
            return b"".join(self.plain(text))
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.plain(text[at:m.start()])
            out.append(struct.pack("<I", self.table.special[m[0]]))
            at = m.end()
        return b"".join(out + self.plain(text[at:]))

    def unbroken(self, text: str) -> Iterator[bytes]:
        """`part` for a long text, word by word."""
        at = 0
        for m in chain(self.special.finditer(text), (None,)):
            plain = text[at:m.start()] if m else text[at:]
            for chunk in (c[0] for c in regex.finditer(r"\S+", plain)):
                words = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
                for w in self.WORD.finditer(words):
                    if len(w[0]) <= SEGMENT:
                        yield self.word(w[0])
                    else:
                        ids = self.tokens(w[0])
                        while some := [*islice(ids, SEGMENT)]:
                            yield b"".join(map(self.bytes_of.__getitem__, some))
            if m:
                yield struct.pack("<I", self.table.special[m[0]])
                at = m.end()

    def stream(self, text: str | None) -> Iterator[bytes]:
        """Packed ids of a text as they come: ``SEGMENT`` characters and a word's rest at a time, and of
        a longer stretch without white space its words' stable tokens."""
        at, text = 0, text or ""
        while at < len(text):
            cut = self.CUT.search(text, at + SEGMENT)
            end = cut.start() if cut else len(text)
            part = text[at:end] if at or cut else text
            if len(part) <= 2 * SEGMENT:
                yield self.part(part)
            else:
                yield from self.unbroken(part)
            at = end

    def encode(self, text: str | None) -> bytes:
        """Packed ids of a text; null counts as empty."""
        return b"".join(self.stream(text))


class Decoder:
    """Ids to text, a block at a time.  ``names=True`` gives what the library's
    ``decode`` gives for a file without a decoder: the tokens' names with a
    space between; otherwise the bytes that they stand for."""

    def __init__(self, table: MergeTable, names: bool = True):
        self.pieces = {i: s.encode() for i, s in table.names.items()} if names else table.surface
        self.between = b" " if names else b""
        self.begun = False
        self.text = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: Iterable[int]) -> str:
        data = self.between.join(map(self.pieces.__getitem__, ids))
        if self.begun and ids:
            data = self.between + data
        self.begun = self.begun or bool(ids)
        return self.text.decode(data)

    def finish(self) -> str:
        return self.text.decode(b"", final=True)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file, made once per process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` for every row; a null or empty text has an
    empty array, repeated rows stay.  Other columns are not read.  ``path`` must
    be readable on the executors (an installed package's file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            packed = [enc.encode(t) for t in b.column(1).to_pylist()]
            offsets = [0]
            for p in packed:
                offsets.append(offsets[-1] + len(p) // 4)
            values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(packed))])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], ["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(rows: DataFrame, path: str, names: bool = False, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from arrays of ids; a null array gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = encoder(path).table
        for b in batches:
            texts = []
            for ids in b.column(1).to_pylist():
                machine, out = Decoder(table, names), []
                for at in range(0, len(ids or ()), DECODE_BLOCK):
                    out.append(machine.push(ids[at:at + DECODE_BLOCK]))
                texts.append("".join(out) + machine.finish())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, ids_col).mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per row: the ids of the
    whole text go to their digest and to the decoder as they become stable, what the decoder makes of
    them to its own; neither is kept, so beside the text memory doesn't depend on its length.  Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        machine = Decoder(enc.table)
        for b in batches:
            n, ids_hex, text_hex = [], [], []
            for text in b.column(1).to_pylist():
                count, ids, digest = 0, hashlib.sha256(), hashlib.sha256()
                machine.begun = False
                machine.text.reset()
                for packed in enc.stream(text):
                    ids.update(packed)
                    count += len(packed) // 4
                    for at in range(0, len(packed), 4 * DECODE_BLOCK):
                        block = packed[at:at + 4 * DECODE_BLOCK]
                        digest.update(machine.push(struct.unpack(f"<{len(block) // 4}I", block)).encode())
                digest.update(machine.finish().encode())
                n.append(count)
                ids_hex.append(ids.hexdigest())
                text_hex.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
