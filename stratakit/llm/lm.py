"""Language-model scoring with a log-bilinear neural model.

The model's vocabulary is the end mark, the most frequent words, more of them the larger
the corpus, and one entry for all others.  The two words before a position predict a vector,
the sum of their own vectors scaled by weights of the position.  Its product with a
word's output vector plus the word's bias is the word's score.  The vocabulary in order of frequency
is cut into about as many classes as each has words; a class has an output vector and a
bias too, and a word's probability is its class's times its own in the class, so no table of all
pairs of words is needed.  Training is noise-contrastive, on words and on their classes: each
task trains a copy in numpy on its part of the corpus, against shared noise words drawn from
the unigram distribution, and the copies' parameters are averaged by tokens seen, in an
aggregation over parameter rows.

A word of the entry "others" has the entry's probability times its smoothed share in it,
so the probabilities of all known words and of the unknown word sum to one.

Counts of all words are gathered over the whole corpus.  Words beyond a table of
bounded size reach their counts by a join; `bounded_words` finds the most frequent from a
histogram of counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_once
from .common import with_row_number_ids

#: Words with vectors as a multiple of the square root of the training tokens; words whose
#: counts every task holds (those with vectors at least), and their longest.
GROWTH, TABLE_WORDS, WORD_BYTES = 4, 200_000, 64
DIMENSIONS, NOISE, BATCH, RATE = 16, 32, 8192, 0.05
#: Tokens that training and scoring hold in arrays at a time, and bytes of a text that are split at a time.
BLOCK, SEGMENT = 1 << 18, 1 << 20
#: Tokens a copy of the model is trained on, as a multiple of the square root of all: copies and
#: their rows both grow with the root, what they hand on with the corpus.
PART = 250
#: Distinct words that a task counts before it hands its counts on.
COUNTED = 200_000
_END, _OTHER = 0, 1
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def held_out(id_col: Column) -> Column:
    """Rows that training doesn't see; a null id counts as an empty string."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def tokens(text: bytes | None) -> list[bytes]:
    """Words, lower-cased in A-Z; the end is not among them."""
    return (text or b"").lower().split()


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       held_out(F.col(id_col)).alias("held_out"))


def word_counts(rows: DataFrame) -> DataFrame:
    """``word, c`` over all training rows (``text, held_out``); the end mark is
    not a row here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "c"])

        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0).cast(pa.binary()).to_pylist():
                seen.update(tokens(text))
                if len(seen) > COUNTED:
                    yield out()
                    seen.clear()
        yield out()

    return (rows.filter(~F.col("held_out")).select("text").mapInArrow(run, "word binary, c long")
            .groupBy("word").agg(F.sum("c").alias("c")))


def bounded_words(counts: DataFrame, most: int) -> DataFrame:
    """The ``most`` words of at most ``WORD_BYTES`` with the largest counts; of
    equal counts the first words.  Only words of the eighth of an octave that crosses
    the bound are sorted."""
    short = counts.filter(F.octet_length("word") <= WORD_BYTES)
    level = F.floor(F.log2("c") * 8).cast("int")
    levels = sorted(short.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True)
    total = 0
    for r in levels:  # at most 8 x 63 rows
        if total + r["n"] > most:
            return short.filter(level > r["level"]).unionByName(
                short.filter(level == r["level"]).orderBy(F.desc("c"), "word").limit(most - total))
        total += r["n"]
    return short


def class_size(n: int) -> int:
    """Vocabulary numbers in a class, about as many as there are classes."""
    return max(1, math.isqrt(max(0, n - 1)) + 1)


def with_classes(unigram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distribution followed by that of the classes, and each word's row of its
    class: classes come after the words."""
    n = len(unigram)
    of = np.arange(n) // class_size(n)
    return np.concatenate([unigram, np.bincount(of, unigram)]), n + of


@dataclass
class Model:
    """``context`` and ``output`` vectors, position weights ``near`` and ``far``,
    biases, by vocabulary number."""

    context: np.ndarray
    output: np.ndarray
    near: np.ndarray
    far: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, unigram: np.ndarray, dimensions: int) -> Model:
        """Biases give the unigram distribution; small vectors from a fixed rule."""
        rng = np.random.default_rng(7)
        n = len(unigram)
        return cls(rng.normal(0, 0.1, (n, dimensions)).astype(np.float32), np.zeros((n, dimensions), dtype=np.float32),
                   np.ones(dimensions, dtype=np.float32), np.full(dimensions, 0.5, dtype=np.float32),
                   np.log(unigram).astype(np.float32))

    def zeros(self) -> Model:
        return Model(*(np.zeros_like(x) for x in vars(self).values()))

    def rows(self) -> np.ndarray:
        """Parameters as rows: one for each vocabulary number, then the weights."""
        d = self.context.shape[1]
        top = np.concatenate([self.context, self.output, self.bias[:, None]], axis=1)
        last = np.concatenate([self.near, self.far, [0.0]])
        return np.vstack([top, last]).astype(np.float64).reshape(-1, 2 * d + 1)

    @classmethod
    def from_rows(cls, rows: np.ndarray) -> Model:
        d = (rows.shape[1] - 1) // 2
        rows = rows.astype(np.float32)
        return cls(rows[:-1, :d].copy(), rows[:-1, d:2 * d].copy(), rows[-1, :d].copy(), rows[-1, d:2 * d].copy(), rows[:-1, -1].copy())

    def train(self, grams: np.ndarray, weight: np.ndarray, unigram: np.ndarray, rng: np.random.Generator,
              squares: Model, classes: np.ndarray | None = None, rate: float = RATE, noise: int = NOISE,
              batch: int = BATCH) -> None:
        """One pass over distinct ``(far, near, word)`` rows with their counts,
        in random order, by AdaGrad with the sums ``squares``.  A batch shares its
        noise words.  With ``classes`` the classes' rows learn from the words' classes."""
        log_noise = np.log(unigram * noise).astype(np.float32)
        order = rng.permutation(len(grams))
        cumulative = np.cumsum(unigram if classes is None else unigram[:len(classes)])

        def step(own: np.ndarray, square: np.ndarray, row, g: np.ndarray) -> None:
            total = square[row] + g * g
            square[row] = total
            own[row] += rate * g / np.sqrt(total + np.float32(1e-12))

        def by_row(where: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Distinct rows and the sums of their columns."""
            row, place = np.unique(where, return_inverse=True)
            return row, np.stack([np.bincount(place, c, len(row)) for c in columns], axis=1).astype(np.float32) * mean

        d = self.context.shape[1]
        for at in range(0, len(grams), batch):
            pick = order[at:at + batch]
            far, near, word = grams[pick].T
            w = weight[pick].astype(np.float32)
            mean = np.float32(1 / max(1.0, float(w.sum())))
            drawn = np.minimum(np.searchsorted(cumulative, rng.random(noise) * cumulative[-1], side="right"), len(cumulative) - 1)
            cf, cn = np.take(self.context, far, axis=0), np.take(self.context, near, axis=0)
            guess = cf * self.far + cn * self.near
            back, rows, moves = np.zeros_like(guess), [], []
            for right, wrong in [(word, drawn)] if classes is None else [(word, drawn), (classes[word], classes[drawn])]:
                out, others = np.take(self.output, right, axis=0), self.output[wrong]
                true = np.einsum("bd,bd->b", guess, out) + (self.bias[right] - log_noise[right])
                false = guess @ others.T
                false += self.bias[wrong] - log_noise[wrong]
                up = w / (1 + np.exp(np.clip(true, -30, 30)))
                np.clip(false, -30, 30, out=false)
                np.exp(np.negative(false, out=false), out=false)
                false += 1
                down = np.divide(-w[:, None], false, out=false)
                back += up[:, None] * out + down @ others
                rows += [right, wrong]
                moves += [np.vstack([guess.T * up, up]), np.vstack([guess.T @ down, down.sum(axis=0)])]
            row, g = by_row(np.concatenate(rows), np.concatenate(moves, axis=1))
            step(self.output, squares.output, row, g[:, :d])
            step(self.bias, squares.bias, row, g[:, d])
            step(self.context, squares.context, *by_row(np.concatenate([far, near]), np.concatenate([(back * self.far).T, (back * self.near).T], axis=1)))
            weights = np.einsum("bd,bd->d", back, cf) * mean, np.einsum("bd,bd->d", back, cn) * mean
            step(self.far, squares.far, slice(None), weights[0])
            step(self.near, squares.near, slice(None), weights[1])

    def log(self, far: np.ndarray, near: np.ndarray, word: np.ndarray, n: int, chunk: int = 1024) -> np.ndarray:
        """Natural log probabilities of words after contexts; rows from ``n`` on are the
        classes'.  The classes are normalised once for each pair of context words."""
        size = class_size(n)
        f, c = self.context * self.far, self.context * self.near
        biased = np.column_stack([self.output, self.bias])

        def guess_of(far: np.ndarray, near: np.ndarray) -> np.ndarray:
            return np.column_stack([np.take(f, far, axis=0) + np.take(c, near, axis=0), np.ones(len(far), dtype=np.float32)])

        def whole(guess: np.ndarray, first: int, last: int) -> np.ndarray:
            """The log of the sum of exponentials over rows."""
            score = guess @ biased[first:last].T
            top = score.max()
            sums = np.exp(score - top) @ np.ones(last - first, dtype=np.float32)
            if sums.min() > 1e-30:
                return np.log(sums.astype(np.float64)) + top
            tops = score.max(axis=1)  # rows too far apart for one reference
            return np.log(np.exp(score - tops[:, None]).sum(axis=1, dtype=np.float64)) + tops

        pairs, pair = np.unique(far * n + near, return_inverse=True)
        norm = np.empty(len(pairs))
        for at in range(0, len(pairs), chunk):
            part = pairs[at:at + chunk]
            norm[at:at + chunk] = whole(guess_of(part // n, part % n), n, len(self.bias))
        of = word // size
        by = np.argsort(of, kind="stable")
        ends = np.searchsorted(of[by], np.arange(len(self.bias) - n + 1))
        out = np.empty(len(word))
        for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            for at in range(a, b, chunk):
                pick = by[at:min(b, at + chunk)]
                guess = guess_of(far[pick], near[pick])
                own = np.einsum("bd,bd->b", guess, np.take(biased, word[pick], axis=0)) + guess @ biased[n + k]
                out[pick] = own - whole(guess, k * size, min(n, (k + 1) * size)) - norm[pair[pick]]
        return out

    def log10_grams(self, grams: np.ndarray, n: int) -> np.ndarray:
        """Log10 probability of each of the ``(far, near, word)`` rows."""
        distinct, place = unique_grams(grams)
        return self.log(*distinct.T, n)[place] / math.log(10)

    def log10_texts(self, texts: list[np.ndarray], n: int) -> np.ndarray:
        """Log10 probability of each text's numbers (its end included)."""
        grams = [with_context(ids, (_END, _END)) for ids in texts]
        owner = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
        return np.bincount(owner, self.log10_grams(np.concatenate(grams), n), len(texts)) if texts else np.zeros(0)


def with_context(ids: np.ndarray, before: tuple[int, int]) -> np.ndarray:
    """``(far, near, word)`` of numbers that follow the two ``before``; a text begins after two end marks."""
    row = np.concatenate([before, ids]).astype(np.int64)
    return np.stack([np.where(row[1:-1] == _END, _END, row[:-2]), row[1:-1], row[2:]], axis=1)


@dataclass
class Block:
    """Tokens in order: ``grams`` are their numbers with context, ``owner`` the number of each one's text,
    ``place`` which of ``words`` (distinct, ``known`` in the table or -1) it is, -1 for an end.  ``through``
    texts have ended so far."""

    grams: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    words: pa.Array
    known: np.ndarray
    through: int


def segments(text: bytes) -> Iterator[tuple[list[bytes], bool]]:
    """A text's words, ``SEGMENT`` bytes and a word's rest at a time, and whether the text ends there."""
    at = 0
    while True:
        cut = _SPACE.search(text, at + SEGMENT)
        yield tokens(text[at:cut.start()] if cut else text[at:]), cut is None
        if cut is None:
            return
        at = cut.start()


def word_blocks(texts: Iterable[bytes | None], table: pa.Array, vocabulary: int) -> Iterator[Block]:
    """The texts' tokens, each text's end included, in blocks of about ``BLOCK``; a text may lie in several.
    The first ``vocabulary`` words of the table are numbered from 2 on, all others are ``_OTHER``."""
    flat, parts, before = [], [], (_END, _END)

    def block() -> Block:
        nonlocal before
        coded = pa.array(flat, pa.binary()).dictionary_encode()
        place = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        known = pc.fill_null(pc.index_in(coded.dictionary, value_set=table), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        of = np.where((known >= 0) & (known < vocabulary), known + 2, _OTHER)
        owner, length, last = (np.array(x, dtype=np.int64) for x in zip(*parts, strict=True))
        ends = np.cumsum(length)[last == 1]
        grams = with_context(np.insert(of[place], ends, _END), before)
        before = int(grams[-1, 1]), int(grams[-1, 2])
        return Block(grams, np.repeat(owner, length + last), np.insert(place, ends, -1), coded.dictionary, known, int(owner[-1] + last[-1]))

    for i, text in enumerate(texts):
        for words, last in segments(text or b""):
            flat += words
            parts.append((i, len(words), int(last)))
            if len(flat) + len(parts) >= BLOCK:
                if flat or last:
                    yield block()
                    flat, parts = [], []
    if parts:
        yield block()


def unique_grams(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and each row's place among them.  Pairs of context words are numbered
    first, so the keys stay below the vocabulary times the larger of vocabulary and rows."""
    size = int(grams.max(initial=0)) + 1
    pairs, pair = np.unique(grams[:, 0] * size + grams[:, 1], return_inverse=True)
    keys, place = np.unique(pair * size + grams[:, 2], return_inverse=True)
    pair = pairs[keys // size]
    return np.stack([pair // size, pair % size, keys % size], axis=1), place


def grams_of(texts: Iterable[bytes | None], number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(far, near, word)`` numbers of texts and their counts."""
    return _counted(np.concatenate([np.zeros((0, 3), dtype=np.int64), *(b.grams for b in word_blocks(texts, *table_of(number)))]))


def table_of(number: dict[bytes, int]) -> tuple[pa.Array, int]:
    """The words in the order of their numbers (from 2 on), and how many they are."""
    return pa.array(sorted(number, key=number.get), pa.binary()), len(number)


def _counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = unique_grams(grams)
    return distinct, np.bincount(place, minlength=len(distinct))


def train(rows: DataFrame, number: dict[bytes, int], unigram: np.ndarray, tokens_seen: int,
          dimensions: int = DIMENSIONS) -> Model:
    """Trains copies over all training rows (of ``tokens_seen`` tokens) and averages them: a copy hands on the
    parameter rows that it moved, with how often it used each, which is the row's weight.  The
    driver gets one set of parameters."""
    unigram, classes = with_classes(unigram)
    start = Model.start(unigram, dimensions)
    width, table = 2 * dimensions + 1, table_of(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rng = Model.from_rows(start.rows()), np.random.default_rng(11)
        squares, uses = model.zeros(), np.zeros(len(unigram) + 1)
        for b in batches:
            for part in word_blocks((t.as_py() for t in b.column(0).cast(pa.binary())), *table):
                grams, weight = _counted(part.grams)
                model.train(grams, weight, unigram, rng, squares, classes)
                for place in (*grams.T, classes[grams[:, 2]]):
                    uses[:len(unigram)] += np.bincount(place, weight, len(unigram))
                uses[-1] += len(part.grams)
        moved = np.append((squares.bias > 0) | (squares.context > 0).any(axis=1), uses[-1] > 0)
        own, at = model.rows()[moved].astype(np.float32), np.flatnonzero(moved)
        for a in range(0, len(own), 4096):
            part = own[a:a + 4096]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[a:a + 4096]), pa.array(uses[at[a:a + 4096]] + 1), *(pa.array(part[:, k]) for k in range(width))],
                ["row", "uses", *(f"p{k}" for k in range(width))])

    copies = (rows.filter(~F.col("held_out")).select("text").coalesce(max(1, math.isqrt(tokens_seen) // PART))
              .mapInArrow(run, "row long, uses double, " + ", ".join(f"p{k} float" for k in range(width))))
    mean = copies.groupBy("row").agg(*((F.sum(F.col(f"p{k}") * F.col("uses")) / F.sum("uses")).cast("float").alias(f"p{k}") for k in range(width)))
    found, rows_now = mean.toArrow(), start.rows()
    rows_now[found.column("row").to_numpy()] = np.stack([found.column(f"p{k}").to_numpy() for k in range(width)], axis=1)
    return Model.from_rows(rows_now)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          model_words: int | None = None, table_words: int = TABLE_WORDS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score``.

    Learns from the rows that aren't held out.  ``base_score`` is the add-one
    unigram score, ``score`` the model's log10 probability of the text with its
    end, with vectors for ``model_words`` words, by default `GROWTH` times the square root
    of the training tokens.  A null text counts as empty and has the end alone.  With no training rows
    all words are unknown.  Repeated rows are counted and scored each; an empty
    table gives no rows; other columns are not read."""
    rows = _input(docs, id_col, text_col)
    counts = write_once(word_counts(rows), "word-counts")
    ends = rows.filter(~F.col("held_out")).count()
    total = counts.agg(F.sum("c"), F.count("*")).first()
    n, v = (total[0] or 0) + ends, total[1] + (ends > 0)
    model_words = GROWTH * math.isqrt(n) if model_words is None else model_words
    table_words = max(table_words, model_words)
    best = sorted(bounded_words(counts, table_words).collect(), key=lambda r: (-r["c"], bytes(r["word"])))
    top = best[:model_words]
    number = {bytes(r["word"]): k for k, r in enumerate(top, 2)}
    table = pa.array([bytes(r["word"]) for r in best], pa.binary())
    logs = np.log10(np.array([r["c"] for r in best] + [0.0]) + 1)
    inside = sum(r["c"] for r in top) + ends
    other_n, other_v = n - inside, v - len(number) - (ends > 0)
    other_mass = math.log10(other_n + other_v + 1)
    unigram = np.array([ends + 1.0, other_n + 1.0, *(r["c"] for r in top)])
    unigram /= unigram.sum()
    model = train(rows, number, unigram, n)
    vocabulary = len(number)

    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, begun = 0, np.zeros(6)  # the text that the last block ended in, and what it has so far
            for x in word_blocks((t.as_py() for t in b.column("text").cast(pa.binary())), table, vocabulary):
                owner, m = x.owner - first, x.through - first
                width = int(owner[-1]) + 1
                pair, times = np.unique((owner * (len(x.words) + 1) + x.place)[x.place >= 0], return_counts=True)
                text, word = np.divmod(pair, len(x.words) + 1)
                here = x.known[word] >= 0
                at_table, known, k = x.known[word[here]], text[here], times[here]
                log = k * logs[at_table]
                sums = np.stack([
                    np.bincount(owner, minlength=width), np.bincount(known, k, width), np.bincount(known, log, width),
                    np.bincount(known, log * (at_table >= vocabulary), width),
                    np.bincount(owner, model.log10_grams(x.grams, len(unigram)), width),
                    np.bincount(owner, x.grams[:, 2] == _OTHER, width)])
                sums[:, 0] += begun
                at, rare = pa.array(text[~here] + first), x.words.take(pa.array(word[~here]))
                yield pa.RecordBatch.from_arrays(
                    [b.column("__row").take(at), pa.nulls(len(at), b.column("doc_id").type), pa.nulls(len(at), pa.bool_()),
                     *(pa.nulls(len(at), kind) for kind in kinds), rare, pa.array(times[~here], pa.int64())], names)
                done = sums[:, :m]
                done[1] += ends > 0
                done[2] += math.log10(ends + 1)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(first, m) for c in ("__row", "doc_id", "held_out")),
                     *(pa.array(c.astype(kind.to_pandas_dtype()), kind) for c, kind in zip(done, kinds, strict=True)),
                     pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64())], names)
                begun = sums[:, m] if m < width else np.zeros(6)
                first = x.through

    names = ["__row", "doc_id", "held_out", "n_tokens", "seen", "local", "other", "class_score", "n_other", "word", "times"]
    kind = docs.schema[id_col].dataType.simpleString()
    both = write_once(with_row_number_ids(rows, "__row").mapInArrow(
        run, f"__row long, doc_id {kind}, held_out boolean, n_tokens long, seen long, local double, other double, "
             "class_score double, n_other long, word binary, times long"), "scores")
    rare = (both.filter("word IS NOT NULL").select("__row", "word", "times").join(counts, "word")
            .groupBy("__row").agg(F.sum("times").alias("rare_seen"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rare")))
    whole = both.filter("word IS NULL").drop("word", "times").join(rare, "__row", "left").fillna(0, ["rare_seen", "rare"])
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("seen") + F.col("rare_seen")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("local") + F.col("rare") - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
        (F.col("class_score") + F.col("other") + F.col("rare") - F.col("n_other") * other_mass).alias("score"))
