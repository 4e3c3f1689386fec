"""Quality rules with line labelling by a linear-chain conditional random field.

Every line with a word has a set of binary features (`line_features`).  A CRF
with the labels boilerplate (0) and content (1) scores label sequences.  It is trained here:
lines get their labels from what other labelled documents show of such lines and from their own
document's label (`line_labels`), so one document may have both.  Viterbi decoding labels a document's lines, and
the share of its word characters on content lines decides whether it stays.  Base rules on
length and repetition come first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Labelled documents that the CRF is fitted on, with all their lines.
SAMPLE_DOCS = 1500
#: Lines, with padding, of sequences of like length that are summed at once.
BATCH_LINES = 1 << 16
#: Least share of a kept document's word characters on content lines.
MIN_CONTENT = 0.5
#: Log odds that a line is of its document's kind, before other documents are asked.
DOCUMENT_ODDS = 0.5

_SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\v\f\r"
_ADDRESS = re.compile(r"https?://|www\.|@")
_NAVIGATION = re.compile(r"\b(cookies?|log ?in|sign ?up|subscribe|click here|all rights reserved|privacy policy)\b", re.I)
FEATURES = ("always", "symbols > 2 %", "symbols > 10 %", "all capitals", "up to 3 words", "8 words or more",
            "ends a sentence", "digits > 20 %", "equals an earlier line", "marks between cells", "many exclamations",
            "few distinct words", "very long or short words", "an address", "a navigation phrase", "half in repeated windows")


def line_features(line: str, words: list[str], repeated: bool, share_repeated: float) -> int:
    """The line's features as a bit set."""
    n, size = len(words), sum(map(len, words))
    symbols = sum(map(line.count, _SYMBOLS))
    last = words[-1][-1]
    upper = line.upper()
    tests = (True, symbols * 50 > size, symbols * 10 > size, upper == line != line.lower(), n <= 3, n >= 8,
             last in ".!?:;\"'”»…", sum(map(line.count, "0123456789")) * 5 > size, repeated,
             line.count("|") * 8 > n or line.count("\t") * 4 > n, line.count("!") * 3 > n, 2 * len(set(words)) < n,
             size > 12 * n or 2 * size < 5 * n, bool(_ADDRESS.search(line)), bool(_NAVIGATION.search(line)),
             share_repeated >= 0.5)
    return sum(1 << k for k, t in enumerate(tests) if t)


def repeat_mask(words: list, span: int = 3) -> np.ndarray:
    """Which words lie in a window of ``span`` words that the text has twice or
    more."""
    n = len(words)
    mask = np.zeros(n, dtype=bool)
    if n < span:
        return mask
    ids: dict = {}
    key = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    window = key[:n - span + 1]
    for k in range(1, span):  # numbered anew each time, so that pairs fit 64 bits
        window = np.unique(window, return_inverse=True)[1] * np.int64(len(ids)) + key[k:n - span + 1 + k]
    _, inverse, counts = np.unique(window, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[inverse] > 1)
    for k in range(span):
        mask[at + k] = True
    return mask


@dataclass
class Facts:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    features: np.ndarray  # by line with a word
    weights: np.ndarray  # word characters by such line

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words


def facts(text: str) -> Facts:
    """Counts and line features of a whole text."""
    lines = text.split("\n")
    words_of = [line.encode().split() for line in lines]
    words = [w for ws in words_of for w in ws]
    mask = repeat_mask(words)
    seen: set[str] = set()
    dup, at, features, weights = 0, 0, [], []
    covered = np.concatenate([[0], np.cumsum(mask)])
    for line, ws in zip(lines, words_of, strict=True):
        if not ws:
            continue
        again = line in seen
        dup += again
        seen.add(line)
        n = len(ws)
        own = [w.decode() for w in ws]
        features.append(line_features(line, own, again, (covered[at + n] - covered[at]) / n))
        weights.append(sum(map(len, own)))
        at += n
    return Facts(len(words), len(text) - sum(map(text.count, _SPACE)), sum(map(text.count, _SYMBOLS)), dup,
                 int(mask.sum()), np.array(features, dtype=np.int64), np.array(weights, dtype=np.int64))


@dataclass
class Crf:
    """Emission weights by feature and label, transition weights by label pair."""

    emit: np.ndarray
    move: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        return unpack(features) @ self.emit

    def decode(self, features: np.ndarray) -> np.ndarray:
        """Viterbi labels of one sequence; ties go to content."""
        score = self.scores(features)
        back = np.zeros((len(score), 2), dtype=np.int8)
        (a, b), ((aa, ab), (ba, bb)) = score[0].tolist(), self.move.tolist()
        for t, (x, y) in enumerate(score[1:].tolist(), 1):
            to_a, to_b = (aa + a, 0), (ab + a, 0)
            if ba + b >= to_a[0]:
                to_a = (ba + b, 1)
            if bb + b >= to_b[0]:
                to_b = (bb + b, 1)
            back[t] = to_a[1], to_b[1]
            a, b = to_a[0] + x, to_b[0] + y
        label = int(b >= a)
        out = np.empty(len(score), dtype=np.int8)
        for t in range(len(score) - 1, -1, -1):
            out[t] = label
            label = back[t, label]
        return out

    def content_share(self, f: Facts) -> float:
        """Share of word characters on content lines; 1 for a text without lines."""
        total = int(f.weights.sum())
        return float(f.weights[self.decode(f.features) == 1].sum() / total) if total else 1.0


def unpack(features: np.ndarray) -> np.ndarray:
    return (features[..., None] >> np.arange(len(FEATURES)) & 1).astype(np.float64)


def line_labels(sequences: list[tuple[list[int], list[int], int]], document_odds: float = DOCUMENT_ODDS,
                min_content: float = MIN_CONTENT) -> list[np.ndarray]:
    """A label for every line of labelled documents (line features, word characters
    by line, the document's label).

    A line's evidence is how much more often good documents have lines with its
    features than bad ones do (log odds over all *other* documents, each of weight one,
    smoothed by one document a side), plus or minus ``document_odds`` for its own
    document's label.  So a sound line of a bad document may be content and a menu line
    of a good one boilerplate.  The document's label still binds the whole: if its
    content share contradicts it, the lines of least contrary evidence change sides until
    it does not."""
    kinds, at = np.unique(np.concatenate([np.asarray(f, dtype=np.int64) for f, _, _ in sequences]), return_inverse=True)
    ends = np.cumsum([len(f) for f, _, _ in sequences])
    lines = np.split(at, ends[:-1])
    seen = np.zeros((2, len(kinds)))
    for own, (_, _, y) in zip(lines, sequences, strict=True):
        np.add.at(seen[y], own, 1 / len(own))
    documents = np.bincount([y for _, _, y in sequences], minlength=2).astype(np.float64)
    out = []
    for own, (_, weights, y) in zip(lines, sequences, strict=True):
        others, rest = seen[:, own].copy(), documents.copy()
        others[y] -= np.bincount(own, minlength=len(kinds))[own] / len(own)
        rest[y] -= 1
        share = (np.maximum(others, 0) + 1) / (rest + 2)[:, None]
        evidence = np.log(share[1] / share[0]) + (document_odds if y else -document_odds)
        label = evidence >= 0
        size = np.asarray(weights, dtype=np.float64)
        for k in np.argsort(-evidence if y else evidence, kind="stable").tolist():
            if (size[label].sum() >= min_content * size.sum()) == bool(y):
                break
            label[k] = bool(y)
        out.append(label.astype(np.int8))
    return out


def by_length(sequences: list[tuple[list[int], np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sequences of like length as arrays of line features and line labels, padded by 0."""
    out, batch = [], []
    for f, y in [*sorted(sequences, key=lambda s: len(s[0])), ([], None)]:
        if batch and (y is None or len(f) > 2 * len(batch[0][0]) or len(f) * (len(batch) + 1) > BATCH_LINES):
            x = np.zeros((len(batch), len(batch[-1][0])), dtype=np.int64)
            labels = np.zeros_like(x)
            for i, (own, told) in enumerate(batch):
                x[i, :len(own)], labels[i, :len(own)] = own, told
            out.append((x, labels))
            batch = []
        batch.append((f, y))
    return out


def gradient(x: np.ndarray, y: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Gradient of the log likelihood, summed over the sequences."""
    on = x > 0  # every line has the feature "always"
    steps, x = x.shape[1], unpack(x)
    gold = on[..., None] * np.eye(2)[y]
    want_move = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    score, move = x @ theta[:-2], theta[-2:]
    ahead = np.zeros_like(score)
    ahead[:, 0] = score[:, 0]
    for t in range(1, steps):
        new = np.logaddexp.reduce(ahead[:, t - 1, :, None] + move, axis=1) + score[:, t]
        ahead[:, t] = np.where(on[:, t, None], new, ahead[:, t - 1])
    log_z = np.logaddexp.reduce(ahead[:, -1], axis=1)
    after = np.zeros_like(score)
    got_move = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        step = move + (score[:, t + 1] + after[:, t + 1])[:, None, :]
        after[:, t] = np.where(on[:, t + 1, None], np.logaddexp.reduce(step, axis=2), 0.0)
        pair = np.exp(ahead[:, t, :, None] + step - log_z[:, None, None])
        got_move += (pair * on[:, t + 1, None, None]).sum(axis=0)
    p = np.exp(ahead + after - log_z[:, None, None]) * on[..., None]
    return np.concatenate([np.einsum("ntf,ntl->fl", x, gold - p), want_move - got_move])


def fit(sequences: list[tuple[list[int], list[int], int]], rounds: int = 80, rate: float = 0.2, shrink: float = 1e-3,
        document_odds: float = DOCUMENT_ODDS, min_content: float = MIN_CONTENT) -> Crf | None:
    """Maximum conditional likelihood of the `line_labels` by Adam on the exact
    gradient (forward and backward sums over batches of sequences).  None unless
    documents of both labels occur."""
    sequences = [s for s in sequences if len(s[0])]
    if len({y for _, _, y in sequences}) < 2:
        return None
    told = line_labels(sequences, document_odds, min_content)
    batches = by_length([(f, y) for (f, _, _), y in zip(sequences, told, strict=True)])
    total = sum(len(f) for f, _, _ in sequences)
    theta = np.zeros((len(FEATURES) + 2, 2))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for it in range(1, rounds + 1):
        grad = sum(gradient(x, y, theta) for x, y in batches) / total - shrink * theta
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        theta = theta + rate * (first / (1 - 0.9**it)) / (np.sqrt(second / (1 - 0.99**it)) + 1e-8)
    return Crf(theta[:-2], theta[-2:])


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS,
          id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Crf | None:
    """Fits the CRF on all lines of at most ``sample_docs`` labelled documents,
    chosen by a hash of their ids; the driver gets their line features and sizes.
    Of repeated labels of an id the smaller counts; null ids and labels other than 0
    and 1 are left out; rows that repeat an id each count, up to twice the sample."""
    chosen = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
              .filter("label IN (0, 1) AND id IS NOT NULL").groupBy("id").agg(F.min("label").alias("label"))
              .orderBy(F.xxhash64("id"), "id").limit(sample_docs))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [facts(t or "") for t in b.column("text").to_pylist()]
            features, weights = ([getattr(f, k).tolist() for f in own] for k in ("features", "weights"))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("label"), *(pa.array(c, pa.list_(pa.int64())) for c in (features, weights))],
                ["id", "label", "features", "weights"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = texts.join(F.broadcast(chosen), "id").select("id", "text", "label").mapInArrow(
        run, f"id {kind}, label int, features array<long>, weights array<long>")
    found = rows.orderBy("id", "label", "features", "weights").limit(2 * sample_docs).collect()
    return fit([(r["features"], r["weights"], r["label"]) for r in found])


def judge(docs: DataFrame, crf: Crf | None, min_content: float = MIN_CONTENT,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, content_share``.

    Null counts as empty; an empty text has no words and fails the base rules.
    Without a model (labels of one kind or none) all lines count as content.
    Repeated rows are judged alike; an empty table gives no rows; other columns
    are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                text = text or ""
                f = facts(text)
                share = crf.content_share(f) if crf and len(f.features) else 1.0
                rows.append((f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed,
                             not f.base_failed and share >= min_content, share))
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
             "content_share"]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
             "base_failed boolean, kept boolean, content_share double")


def keep_good(docs: DataFrame, crf: Crf | None, min_content: float = MIN_CONTENT,
              text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; repeated
    rows are judged alike and all stay.  The rules see one row at a time, so the whole row
    passes through the worker, and nothing is shuffled."""
    names, schema = docs.columns, docs.schema
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stay = []
            for text in b.column(at).to_pylist():
                f = facts(str(text) if text is not None else "")
                stay.append(not f.base_failed and (crf is None or crf.content_share(f) >= min_content))
            yield b.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(run, schema)
