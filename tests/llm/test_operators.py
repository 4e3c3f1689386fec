"""Every operator against a plain version of its contract on one small corpus."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import textwrap
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from stratakit.llm import bpe, chat, exact_dedup, licenses, lm, packing, pii, quality, sharding, simhash
from stratakit.llm.common import join_groups
from stratakit.llm.queries import tokenizer_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def packed_ids(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


# --- 10 BPE
def test_round_trip_equals_library(corpus, docs, library):
    got = Counter(tuple(r) for r in bpe.round_trip(docs, tokenizer_path()).collect())
    want = Counter()
    for i, t in corpus:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(packed_ids(ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert got == want


def test_encode_then_decode_gives_the_normalised_words(spark, docs):
    ids = bpe.encode(docs, tokenizer_path())
    texts = {r.doc_id: r.text for r in bpe.decode(ids, tokenizer_path()).collect()}
    assert texts[5] == "a b c " and texts[1] == ""


def test_encoder_on_odd_texts(library):
    rng, enc = random.Random(1), bpe.Encoder(tokenizer_path(), cache_words=50)
    parts = list("abcdetherinoſßΣİǺ̈é가ᄀ' \x1c\x85 \x0b,.!0१😀_ﬁ") + ["<|endoftext|>", "<|startoftext|>", "'ve", "the", "\x1c"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert enc.encode(text) == packed_ids(library.encode(text, add_special_tokens=False).ids)


def test_transducer_is_stable_and_bounded(library):
    table, rng = bpe.MergeTable(tokenizer_path()), random.Random(2)
    for _ in range(20):
        word = "".join(rng.choice(["a", "ab", "the", "in", "th", "aaaa", "ing", "xo"]) for _ in range(800))
        data = word.encode()
        machine, out = bpe.Transducer(table), []
        for s in [table.inner[b] for b in data[:-1]] + [table.final[data[-1]]]:
            out += machine.push([s])
            assert len(machine.buffer) <= machine.window
        assert out + [*machine.finish()] == library.encode(word, add_special_tokens=False).ids


def test_every_word_passes_the_transducer_at_constant_memory(library, monkeypatch):
    import tracemalloc

    enc = bpe.Encoder(tokenizer_path(), cache_words=50)
    pushed, push = [], bpe.Transducer.push
    monkeypatch.setattr(bpe.Transducer, "push", lambda self, s: pushed.append(1) or push(self, s))
    assert enc.encode("one two three") == packed_ids(library.encode("one two three", add_special_tokens=False).ids)
    assert len(pushed) == 3
    monkeypatch.setattr(bpe, "SEGMENT", 300)
    rng = random.Random(9)
    for text in ("the quick " * 500, "a" * 5000, "ab\x1c" * 700 + "Σς<|endoftext|>" * 90, "é" * 900 + " \u2003x" * 400,
                 "".join(rng.choice("thein<|>. \n\x1fé'sΣ") for _ in range(6000)), "<|endoftext|>" * 300):
        assert enc.encode(text) == packed_ids(library.encode(text, add_special_tokens=False).ids)
    peaks = []
    for times in (20_000, 80_000):
        for text in ("theinhe" * times, "some word " * times):
            list_of = enc.stream(text)
            tracemalloc.start()
            for _ in list_of:
                pass
            peaks.append(tracemalloc.get_traced_memory()[1] - 2 * len(text))
            tracemalloc.stop()
    assert max(peaks) < 3_000_000


# --- 1 packing
def test_packing_places_every_id_once(corpus, docs, library):
    width = 64
    got = packing.pack(docs, tokenizer_path(), width).collect()
    want = Counter()
    for i, t in corpus:
        want[i, packed_ids([*library.encode(t or "", add_special_tokens=False).ids, 1])] += 1
    whole = defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length <= 4 * width
        whole[r.doc_id, r.start].append(r)
    starts = Counter((i, s) for i, ids in want.elements() for s in range(0, len(ids) // 4, width))
    assert starts == Counter({k: len(v) for k, v in whole.items()})
    pieces = Counter((i, s, ids[4 * s:4 * (s + width)]) for i, ids in want.elements() for s in range(0, len(ids) // 4, width))
    assert pieces == Counter((r.doc_id, r.start, bytes(r.ids)) for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= width
    assert sum(r.length for r in got) > 0.9 * width * len(by)


def test_patterns_use_each_length_as_often_as_it_occurs():
    rng = random.Random(3)
    for width in (1, 8, 64, 2048):
        histogram = {n: rng.randint(1, 500) for n in rng.sample(range(1, width + 1), min(width, 90))}
        used = Counter()
        for pattern, uses in packing.plan_patterns(histogram, width):
            assert uses > 0 and sum(n * k for n, k in pattern) <= width
            for n, k in pattern:
                used[n] += uses * k
        assert used == histogram
    assert packing.plan_patterns({}, 8) == []


def test_a_length_goes_to_the_shortest_pack():
    assert sorted(packing.plan_patterns({8: 1, 6: 1, 2: 1}, 10)) == [([(6, 1), (2, 1)], 1), ([(8, 1)], 1)]


# --- 2 simhash
def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(fps, radius):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(fps)
    for i, a in enumerate(order):
        for b in order[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_near_duplicates(corpus, docs):
    got = simhash.near_duplicates(docs, 3, 3).collect()
    fp = {t: plain_fingerprint(t) for _, t in corpus}
    root = components_of(set(fp.values()), 3)
    least = {}
    for i, t in corpus:
        r = root[fp[t]]
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == Counter(
        (i, fp[t], least[root[fp[t]]]) for i, t in corpus)
    assert sum(r.kept for r in got) == len(least)


@pytest.mark.parametrize("narrow", [None, "k <> 0", "false"])
def test_hot_groups_are_joined_like_all_others(spark, narrow):
    """One group of a third of the rows, one at the bound, many small; and no rows."""
    sizes = [2000, 6, 7] + [1] * 3000 + [2] * 500
    rows = spark.createDataFrame([(k, i) for k, n in enumerate(sizes) for i in range(n)], "k long, i long")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("last"))
    hot = None if narrow is None else F.expr(narrow)
    got = join_groups(rows, groups, ["k"], "n", hot)
    assert Counter(map(tuple, got.select("k", "i", "n", "last").collect())) == Counter(
        (k, i, n, n - 1) for k, n in enumerate(sizes) for i in range(n))
    assert join_groups(rows.limit(0), groups.limit(0), ["k"], "n", hot).count() == 0


@pytest.mark.parametrize("radius", [2, 3])
def test_crowds_of_near_fingerprints(spark, radius):
    rng, fps = random.Random(radius), set()
    for size in (1, 2, 3, 40, 120):
        center = rng.getrandbits(64)
        fps.add(center)
        for _ in range(size):
            y = center if rng.random() < 0.6 else rng.choice(sorted(fps))
            for _ in range(rng.randint(1, 4)):
                y ^= 1 << rng.randrange(64)
            fps.add(y)
    signed = [simhash._signed(f) for f in fps]
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), radius)
    got = {r.node: r.root for r in simhash.components(links).collect()}
    want = components_of(signed, radius)
    assert {f: got.get(f, f) for f in signed} == want


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(300, 299), (301, 300)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 299: 299, 300: 299, 301: 299}


# --- 4 sharding
def test_shards(corpus, docs):
    got = sharding.assign(docs, 5).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in corpus)
    home, slots = defaultdict(set), defaultdict(list)
    for r in got:
        home[r.text_crc32, r["size"]].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in home.values()) and set(slots) <= set(range(5))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_contiguous_cuts_are_the_smallest_capacity(spark):
    rng = random.Random(8)
    for shards in (1, 3, 7):
        sizes = {rng.getrandbits(60): rng.randint(1, 100) for _ in range(300)}
        sizes |= {k + 1: 5 for k in list(sizes)[:40]}  # neighbours that differ in the last bits
        cuts = sharding.contiguous_cuts(spark.createDataFrame(list(sizes.items()), "key long, bytes long"), shards)
        order = sorted(sizes)
        largest = max(sum(sizes[k] for k in order if sum(k >= c for c in cuts) == s) for s in range(shards))

        def needs(capacity):
            n, room = 0, 0
            for k in order:
                if sizes[k] > room:
                    n, room = n + 1, capacity
                room -= sizes[k]
            return n

        best = next(c for c in range(max(sizes.values()), sum(sizes.values()) + 1) if needs(c) <= shards)
        assert len(cuts) <= shards - 1 and largest <= best


def test_a_hot_text_has_its_own_shard(spark):
    rows = [(i, "hot " * 50) for i in range(100)] + [(100 + i, f"text {i} " * 4) for i in range(200)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    hot = {r.shard for r in got if r.doc_id < 100}
    assert len(hot) == 1 and all(r.shard not in hot for r in got if r.doc_id >= 100)
    rest = [n for s, n in sizes.items() if s not in hot]
    assert len(rest) == 3 and max(rest) < 1.1 * min(rest)


# --- 5 exact dedup
def test_exact_groups(corpus, docs):
    got = exact_dedup.exact_groups(docs).collect()
    groups = defaultdict(list)
    for i, t in corpus:
        groups[(t or "").translate(LOWER)].append(i)
    want = Counter()
    for norm, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), hashlib.sha256(norm.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_colliding_identifiers_are_found(docs):
    def weak(chunk, key):  # two identifiers under the first two keys
        return bytes([len(chunk) % 2]) * 16 if key < 2 else exact_dedup.identifier(chunk, key)

    assert exact_dedup.verified_key(docs) == 0
    assert exact_dedup.verified_key(docs, weak) == 2


def test_cut_points_follow_content():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 123, 3_000_000, dtype=np.uint8).tobytes()
    ends = exact_dedup.cut_points(data)
    assert ends[-1] == len(data) and all(0 < b - a <= exact_dedup.LONGEST for a, b in zip([0, *ends], ends))
    moved = exact_dedup.cut_points(b"prefix" + data)
    assert len({e + 6 for e in ends} & set(moved)) > 0.95 * len(ends)
    assert exact_dedup.cut_points(b"a" * 200_000)[:2] == [65536, 131072] and exact_dedup.cut_points(b"") == []


# --- 6 quality
def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    repeated = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))


def test_quality_counts(corpus, docs):
    got = quality.judge(docs, None).collect()
    want = Counter()
    for i, t in corpus:
        c = plain_counts(t)
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        want[(i, *c, failed, not failed)] += 1
    assert Counter(tuple(r)[:8] for r in got) == want
    assert quality.keep_good(docs, None).count() == sum(r.kept for r in got)


def test_crf_fits_and_viterbi_is_exact():
    rng = random.Random(6)
    data = [([1 | rng.choice([2, 6]) if y == 0 else 1 | rng.choice([32, 64]) for _ in range(rng.randint(1, 9))], y)
            for y in (0, 1) * 60]
    data = [(f, [7] * len(f), y) for f, y in data]
    crf = quality.fit(data)
    assert all((crf.decode(np.array(f)) == y).all() for f, _, y in data)
    assert quality.fit([f for f in data if f[2]]) is None and quality.fit([]) is None
    features = np.array([1, 3, 33, 7, 65])
    score = crf.scores(features)
    best = max(range(32), key=lambda m: sum(score[t, m >> t & 1] for t in range(5))
               + sum(crf.move[m >> t & 1, m >> t + 1 & 1] for t in range(4)))
    assert crf.decode(features).tolist() == [best >> t & 1 for t in range(5)]


def test_quality_separates_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fit_on = labels.filter(F.col("doc_id") % 2 == 0)
    judged = quality.judge(docs, quality.train(docs, fit_on)).join(labels.filter(F.col("doc_id") % 2 == 1), "doc_id")
    good, bad = (judged.filter(f"quality = {q} AND NOT base_failed").agg(F.avg(F.col("kept").cast("int"))).first()[0] for q in (1, 0))
    assert good > 0.97 and bad < 0.2


def test_quality_learns_from_all_lines(spark, monkeypatch):
    given = []
    monkeypatch.setattr(quality, "fit", lambda sequences: given.extend(sequences))
    docs = spark.createDataFrame([(i, "a line of words\n" * n) for i, n in enumerate((3, 33, 500))], "doc_id long, text string")
    quality.train(docs, docs.selectExpr("doc_id", "doc_id % 2 AS quality"))
    assert sorted((len(f), len(w), sum(w)) for f, w, _ in given) == [(3, 3, 36), (33, 33, 396), (500, 500, 6000)]
    data = [([1 | 2 << k % 9] * n, np.arange(n) // 3 % 2) for k, n in enumerate((1, 2, 3, 9, 40, 41, 300))]
    theta = np.linspace(-1, 1, 2 * len(quality.FEATURES) + 4).reshape(-1, 2)
    one, told = np.zeros((2, len(data), 300), dtype=np.int64)
    for i, (f, y) in enumerate(data):
        one[i, :len(f)], told[i, :len(f)] = f, y
    assert len(quality.by_length(data)) > 2
    assert np.allclose(sum(quality.gradient(x, y, theta) for x, y in quality.by_length(data)),
                       quality.gradient(one, told, theta))


def test_gradient_is_the_slope_of_the_likelihood_of_mixed_labels():
    x, y = np.array([[1, 3, 33, 7], [65, 1, 0, 0]]), np.array([[1, 0, 0, 1], [0, 1, 0, 0]])

    def likelihood(theta):
        out = 0.0
        for f, gold in ((x[0], y[0]), (x[1, :2], y[1, :2])):
            score, n = quality.unpack(f) @ theta[:-2], len(f)
            paths = {m: sum(score[t, m >> t & 1] for t in range(n)) + sum(theta[-2 + (m >> t & 1), m >> t + 1 & 1] for t in range(n - 1))
                     for m in range(1 << n)}
            out += paths[sum(int(b) << t for t, b in enumerate(gold))] - np.log(sum(np.exp(v) for v in paths.values()))
        return out

    theta = np.random.default_rng(1).normal(size=(len(quality.FEATURES) + 2, 2))
    slope = np.zeros_like(theta)
    for at in np.ndindex(theta.shape):
        step = np.zeros_like(theta)
        step[at] = 1e-5
        slope[at] = (likelihood(theta + step) - likelihood(theta - step)) / 2e-5
    assert np.allclose(quality.gradient(x, y, theta), slope, atol=1e-6)


WORDS = "the quiet river runs past old mills and carries leaves into deep seas while tired farmers watch it go by".split()


def test_lines_of_one_document_get_both_labels(spark):
    """Bad documents are menus with some prose, good ones prose with some menu: the
    lines are told apart, the share lies between 0 and 1 and decides."""
    rng = random.Random(3)

    def text(menus, lines):
        return "\n".join([" | ".join(rng.sample(WORDS, 6)).upper() for _ in range(menus)]
                         + [" ".join(rng.sample(WORDS, 14)) + "." for _ in range(lines)])
    rows = [(k, text(30, 3), 0) if k % 2 else (k, text(3, 12), 1) for k in range(10, 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    crf = quality.train(docs.select("doc_id", "text"), docs.filter("doc_id < 50"))
    right, lines, mixed = 0, 0, 0
    for _, body, y in rows[40:]:
        f = quality.facts(body)
        got = crf.decode(f.features)
        right += sum(got == [0] * (30 if y == 0 else 3) + [1] * (3 if y == 0 else 12))
        lines, mixed = lines + len(got), mixed + (0 < got.mean() < 1)
        assert crf.content_share(f) == f.weights[got == 1].sum() / f.weights.sum()
    assert right >= 0.95 * lines and mixed > 20
    judged = {r.doc_id: r for r in quality.judge(docs, crf, min_content=0.5).collect()}
    assert all(r.kept == (not r.base_failed and r.content_share >= 0.5) for r in judged.values())
    assert all(judged[i].kept == bool(y) for i, _, y in rows if not judged[i].base_failed)
    stricter = quality.judge(docs, crf, min_content=0.99).filter("kept").count()
    assert stricter < sum(r.kept for r in judged.values())


def test_line_labels_obey_their_document():
    good, bad = [33, 33, 3], [3, 3, 33]
    told = quality.line_labels([(good, [9, 9, 9], 1)] * 20 + [(bad, [9, 9, 9], 0)] * 20, 0.5, 0.5)
    assert all(t.tolist() == [1, 1, 0] for t in told[:20]) and all(t.tolist() == [0, 0, 1] for t in told[20:])
    # a document whose lines all look like the other kind's: enough of them change sides
    told = quality.line_labels([(good, [9, 9, 9], 1)] * 20 + [(bad, [9, 9, 9], 0)] * 20 + [([3, 3, 3], [1, 1, 9], 1)], 0.5, 0.5)
    assert told[-1] @ np.array([1, 1, 9]) >= 5.5
    # alone of its kind, only its own label speaks
    assert [t.tolist() for t in quality.line_labels([([1], [5], 1), ([1], [5], 0)], 2.0)] == [[1], [0]]


# --- 7 language model
@dataclass
class Tables:
    """For few words and no classes: log scores by context word and by word, and the log
    normaliser by pair of context words, each from a matrix product."""

    far: np.ndarray
    near: np.ndarray
    norm: np.ndarray

    @classmethod
    def of(cls, m: lm.Model) -> Tables:
        far = (m.context * m.far) @ m.output.T
        near = (m.context * m.near) @ m.output.T + m.bias
        a, b = far.max(axis=1, keepdims=True), near.max(axis=1, keepdims=True)
        norm = np.log(np.exp(far - a) @ np.exp(near - b).T) + a + b.T
        return cls(far, near, norm)

    def log10(self, ids: np.ndarray) -> float:
        """Log10 probability of one text's numbers (its end included)."""
        near = np.concatenate([[0], ids[:-1]])
        far = np.concatenate([[0], near[:-1]])
        return float((self.far[far, ids].astype(np.float64) + self.near[near, ids] - self.norm[far, near]).sum() / np.log(10))


def test_base_scores_and_known_words(corpus, docs):
    got = lm.score(docs, model_words=4, table_words=6).collect()
    split = [(i, WORD.findall((t or "").translate(LOWER)), zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2) for i, t in corpus]
    counts, ends = Counter(), 0
    for _, words, held in split:
        if not held:
            counts.update(words)
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    want = sorted((i if i is not None else -1, held, len(w) + 1, 1 + sum(counts[x] > 0 for x in w), n,
                   sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in w) + np.log10((ends + 1) / (n + v + 1))) for i, w, held in split)
    have = sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    assert [x[:5] for x in have] == [x[:5] for x in want]
    assert np.allclose([x[5] for x in have], [x[5] for x in want])


def test_model_is_normalised_and_learns_order():
    number = {b"a": 2, b"b": 3, b"c": 4}
    texts = [b"a b c " * 40, b"b c a " * 40] * 20
    grams, weight = lm.grams_of(texts, number)
    unigram = np.array([0.02, 0.01, 0.33, 0.32, 0.32])
    model = lm.Model.start(unigram, 8)
    before = Tables.of(model).log10(np.array([2, 3, 4] * 10 + [0]))
    rng, squares = np.random.default_rng(0), model.zeros()
    for _ in range(200):
        model.train(grams, weight, unigram, rng, squares)
    tables = Tables.of(model)
    p = np.exp(tables.far[:, None, :] + tables.near[None] - tables.norm[:, :, None])
    assert np.allclose(p.sum(axis=2), 1, atol=1e-4)
    assert tables.log10(np.array([2, 3, 4] * 10 + [0])) > before + 5


def test_bounded_words_are_as_many_as_asked_for(spark):
    counts = spark.createDataFrame([(f"w{k:03d}".encode(), 5 + (k == 7)) for k in range(200)], "word binary, c long")
    assert sorted(bytes(r.word) for r in lm.bounded_words(counts, 10).collect()) == [b"w%03d" % k for k in range(10)]
    assert lm.bounded_words(counts, 500).count() == 200 and lm.bounded_words(counts, 0).count() == 0


def test_vocabulary_grows_and_classes_are_normalised(spark, monkeypatch):
    made, start = [], lm.Model.start
    monkeypatch.setattr(lm.Model, "start", lambda unigram, dimensions: made.append(len(unigram)) or start(unigram, dimensions))
    for n in (100, 4000):
        lm.score(spark.createDataFrame([(i, " ".join(f"w{i * 100 + k}" for k in range(100))) for i in range(n)], "doc_id long, text string"))
    assert made[1] > 1200 and made[1] > 5 * made[0]
    number = {b"w%d" % k: k + 2 for k in range(40)}
    grams, weight = lm.grams_of([b" ".join(b"w%d" % (k % 40) for k in range(400))] * 20, number)
    unigram = np.array([0.02, 0.01] + [0.97 / 40] * 40)
    both, classes = lm.with_classes(unigram)
    model = start(both, 8)
    text = [np.array([*range(2, 42), 0])]
    assert np.isclose(model.log10_texts(text, 42)[0], np.log10(unigram[text[0]]).sum(), atol=1e-3)
    rng, squares = np.random.default_rng(0), model.zeros()
    for _ in range(300):
        model.train(grams, weight, both, rng, squares, classes)
    far, near, word = (x.ravel() for x in np.meshgrid(np.arange(42), np.arange(42), np.arange(42), indexing="ij"))
    assert np.allclose(np.exp(model.log(far, near, word, 42)).reshape(-1, 42).sum(axis=1), 1, atol=1e-4)
    assert model.log10_texts(text, 42)[0] > np.log10(unigram[text[0]]).sum() + 10


def test_rows_of_a_large_vocabulary_keep_their_numbers():
    """Keys of three numbers in one would leave 64 bits from about 2.1 million words on."""
    rng = np.random.default_rng(5)
    for size in (3, 2_200_000, 50_000_000):
        grams = rng.integers(size - 3, size, (5000, 3))
        distinct, place = lm.unique_grams(grams)
        assert (distinct[place] == grams).all() and len(np.unique(distinct, axis=0)) == len(distinct) == len(np.unique(grams, axis=0))


def test_blocks_cut_texts_anywhere(monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 7)
    monkeypatch.setattr(lm, "SEGMENT", 10)
    number = {b"a": 2, b"b": 3}
    texts = [b"", b"a b c", b" b  a " * 30, None, b"c" * 40 + b"\n" + b"a", b"b", b" "]
    ids = [[*(number.get(w, 1) for w in (t or b"").split()), 0] for t in texts]
    parts = list(lm.word_blocks(texts, *lm.table_of(number)))
    assert len(parts) > 5 and parts[-1].through == len(texts)
    rows, owner = np.concatenate([x.grams for x in parts]), np.concatenate([x.owner for x in parts])
    for i, t in enumerate(ids):
        before = [0, 0, *t]
        assert rows[owner == i].tolist() == [before[k:k + 3] for k in range(len(t))]
    said = [x.words[p].as_py() if p >= 0 else None for x in parts for p in x.place]
    assert said == [w for t in texts for w in [*(t or b"").split(), None]]


def test_scores_equal_the_plain_model(docs, corpus, monkeypatch):
    """The whole score: the model's softmax over classes and words, and the share of the entry "others"."""
    kept = []
    train = lm.train
    monkeypatch.setattr(lm, "train", lambda *a: kept.append((a, train(*a))) or kept[-1][1])
    monkeypatch.setattr(lm, "BLOCK", 100)
    monkeypatch.setattr(lm, "SEGMENT", 50)
    got = {(r.doc_id, r.n_tokens): r.score for r in lm.score(docs, model_words=6, table_words=8).collect()}
    (_, number, unigram, n), m = kept[0]
    counts, ends = Counter(), 0
    for i, t in corpus:
        if zlib.crc32(str(i).encode() if i is not None else b"") % 7 != 2:
            counts.update(lm.tokens((t or "").encode()))
            ends += 1
    others = sum(c for w, c in counts.items() if w not in number)
    share = others + len(counts) - len(number) + 1
    size, vocabulary = lm.class_size(len(unigram)), len(unigram)

    def softmax(rows, guess):
        x = m.output[rows].astype(float) @ guess + m.bias[rows]
        return dict(zip(rows, x - np.logaddexp.reduce(x), strict=True))

    for i, t in corpus:
        words = lm.tokens((t or "").encode())
        if len(words) > 500:
            continue
        ids, far, near, total = [*(number.get(w, 1) for w in words), 0], 0, 0, 0.0
        for w, x in zip([*words, None], ids, strict=True):
            guess = m.context[far].astype(float) * m.far + m.context[near].astype(float) * m.near
            k = x // size
            total += softmax(range(vocabulary, len(m.bias)), guess)[vocabulary + k]
            total += softmax(range(k * size, min(vocabulary, k * size + size)), guess)[x]
            if x == 1:
                total += np.log((counts[w] + 1) / share)
            far, near = near, x
        assert np.isclose(got[i, len(ids)], total / np.log(10), atol=1e-3)


def test_model_beats_the_base_on_held_out_texts(spark):
    got = lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert got[1] > got[0]


# --- 8 personal data
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        if {"email": "@", "ip": "."}.get(kind, "") not in text:
            continue  # no match; the plain pattern would try every start of a long run
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))
                    or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15):
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(5)
    parts = ["a@b.c", "._x@d.e", "x@", "@y.z", "1.2.3.4", "256.1.1.1", "001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1111",
             "5500000000000004", " ", "  ", ".", "-", "é😀", "+1 (303) 555-0199", "+44 20 7946 0958", "+", "12", "Jane", "\n", "9" * 25, "(1"]
    texts = [None, ""] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(600)]
    texts += ["1 " * 20000, "a." * 30000 + "@x.y", "x" * 100000, "5" * 100000, "1.1." * 20000, "a@b" + ".c" * 30000]
    rows = pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.base_spans for r in rows} == {i: base_spans(t or "") for i, t in enumerate(texts)}


def test_revealing_terms_are_spans_and_common_ones_are_not(spark):
    rows = [(i, f"note {i} Zebulon wrote from zeb@x.org about things" if i % 50 == 0 else f"note {i} about things wrote from afar") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    assert spans[50] == "term:8:15,email:27:36" and spans[51] == ""
    new = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert new[50] == "note 50  wrote from [EMAIL] about things" and new[51] == rows[51][1] and len(new) == 300


def test_terms_of_entities_in_one_or_two_documents(spark):
    said = {10: "Ophelia writes as oph@x.org about things", 20: "Cassius writes as cas@y.org about things", 30: "then Cassius writes as cas@y.org about things"}
    rows = [(i, said.get(i, "note about things he then writes as told")) for i in range(300)]
    spans = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: x for i, x in spans.items() if x} == {
        10: "term:0:7,email:18:27", 20: "term:0:7,email:18:27", 30: "term:5:12,email:23:32"}


def test_revealing_terms_count_and_go_in_whole_documents(spark):
    far = " about things" * 20
    said = {10: f"Ophelia spoke{far} oph@x.org{far} OPHELIA", 20: f"oph@x.org{far} ophelia ophelia", 30: f"{far} oph@x.org or cas@y.org Ophelia"}
    rows = [(i, said.get(i, f"note spoke or so{far}")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    new = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert [new[i] for i in (10, 20, 30, 40)] == [
        f" spoke{far} [EMAIL]{far} ", f"[EMAIL]{far}  ", f"{far} [EMAIL] or [EMAIL] ", rows[40][1]]
    spans = {r.doc_id: r.spans.split(",") for r in pii.report(docs).collect()}
    assert [len(spans[i]) for i in (10, 20, 30)] == [3, 3, 3] and spans[10][0] == "term:0:7"


def plain_terms(t):
    return {w.lower() for w in regex.findall(r"[\p{L}\p{N}]{3,}", t)}


def plain_revealing(texts):
    """Terms by document, from the definition: all documents, entities and terms."""
    n = len(texts)
    entities, terms, copy = {}, [plain_terms(t) for t in texts], []
    for i, t in enumerate(texts):
        for kind, a, b in (x.split(":") for x in base_spans(t).split(",") if x):
            entities.setdefault(t[int(a):int(b)].lower(), set()).add(i)
        words = t.lower().split()
        copy.append({tuple(words[k:k + 3]) for k in range(len(words) - 2)} or {tuple(words)})
    out = {i: set() for i in range(n)}
    for hit, held in entities.items():
        share = len(held) / n
        parts = re.findall("[a-z]{3,}", hit.split("@")[0]) if "@" in hit else []
        for term in set().union(*(terms[i] for i in held)):
            df, joint = sum(term in t for t in terms), [i for i in held if term in terms[i]]
            if share == 1:
                continue
            alike = any(term.startswith(p) or term in p for p in parts)
            pmi = math.log2((len(joint) + 0.5 * share) / (df + 0.5) / share)
            goes = alike and pmi >= 0.9 * math.log2(1 / share)
            # in these texts documents are copies of each other or share few triples of words
            groups = []
            for i in joint:
                same = next((g for g in groups if 2 * len(copy[g[0]] & copy[i]) > len(copy[i])), None)
                groups.append([i]) if same is None else same.append(i)
            m, rate, z = df * len(joint) / sum(len(g)**2 for g in groups), len(joint) / df, 1.96
            low = (rate + z * z / (2 * m) - z * math.sqrt(rate * (1 - rate) / m + z * z / (4 * m * m))) / (1 + z * z / m)
            goes = goes or (low >= 0.5 and math.log2(low / share) >= 0.9 * math.log2(1 / share))
            if goes:
                for i in joint:
                    out[i].add(term)
    return out


def test_revealing_terms_equal_the_plain_rule(spark):
    """Planted: a word that comes with a number in ten unlike documents, names like
    their address, and words that only one document (or its copies) has."""
    rng = random.Random(12)

    def words(k):
        return " ".join("".join(rng.choice("bcdfghklmn") + rng.choice("aeiou") for _ in range(4)) for _ in range(k))

    texts = [f"{words(12)} weather {words(5)}" for _ in range(900)]
    texts += [f"{words(6)} Balthazar {words(6)} +1 (303) 555-0199 {words(4)}" for _ in range(12)]
    texts += [f"{words(6)} Balthazar {words(6)}"]
    texts += [f"{words(6)} Quentin {words(3)} quentin.marsh@x.org {words(6)} marsh {words(3)}" for _ in range(2)]
    texts += [f"{words(6)} {words(1)}@y.org {words(8)} weather" for _ in range(30)]
    texts += [f"{words(9)} 10.0.0.7 {words(9)}"] * 40  # copies: no repeated evidence
    texts += [f"{words(4)} 10.1.{k % 7}.9 {words(4)} weather" for k in range(40)]
    want = plain_revealing(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {}
    for r in pii.report(docs).collect():
        t = texts[r.doc_id]
        got[r.doc_id] = {t[int(a):int(b)].lower() for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if k == "term"}
    spelled = {i: plain_terms("".join(t[int(a):int(b)] + " " for _, a, b in (x.split(":") for x in base_spans(t).split(",") if x)))
               for i, t in enumerate(texts)}  # a term inside the address only has no span of its own
    assert {i: x for i, x in got.items() if x} == {
        i: y for i, x in want.items() if (y := {w for w in x if w not in spelled[i] or texts[i].lower().split().count(w)})}
    assert all(got[i] == {"balthazar"} for i in range(900, 912)) and got[912] == set()
    assert all(got[i] == {"quentin", "marsh"} for i in (913, 914))
    assert not any(got[i] for i in range(915, len(texts)))  # one-off words stay


def test_sanitise_keeps_columns_rows_and_clean_texts(corpus, docs):
    got = pii.sanitise(docs)
    assert got.columns == docs.columns
    texts = Counter((r.doc_id, r.text) for r in got.collect())
    assert sum(texts.values()) == len(corpus)
    clean = Counter((i, t) for i, t in corpus if not base_spans(t or ""))
    assert all(texts[k] == n for k, n in clean.items())
    assert not any(base_spans(t or "") for _, t in texts)


# --- 9 chat
def test_chat_round_trip(spark):
    rng = random.Random(9)
    parts = ["\\", "<|end|>", "<", "|", ">", "</s>", "[INST]", "[/", "e", "r", "\n", "é", "<|role|>"]
    rows = [(c % 13 if c % 11 else None, rng.choice([0, 1, 2, None]), rng.choice(["user", "assistant", "a\n<|end|>", None]),
             rng.choice([None, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))])) for c in range(400)]
    rows += [(99, t, "assistant", "z" * 1000) for t in range(300)] + rows[:5]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", F.lit("clash"))
    formatted = chat.format_turns(conversations)
    assert all(not any(c.decode() in unframed(r.formatted) for c in chat.CONTROL) for r in formatted.collect())
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(formatted).collect()}
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append(((turn is not None, turn or 0), role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort(key=lambda t: (t[0], t[1].encode(), t[2].encode()))
        told = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c][:4] == (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def unframed(formatted):
    return formatted.removeprefix(chat.ROLE.decode()).removesuffix(chat.END.decode() + "\n")


# --- 3 licenses
def test_license_blocks(spark):
    rows = [(1, "Some code\nReleased under the MIT License.\nmore"), (2, "Licensed under the Apache License, Version 1.1."),
            (3, "This work is licensed under the\nGNU General Public License, version 3."), (4, "no notice here"), (5, None), (6, ""),
            (7, "Licensed under CC BY-NC 4.0."), (7, "Licensed under CC BY-NC 4.0."), (8, "my driving license " + "was long lost " * 50)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit(1))).collect()
    assert Counter((r.doc_id, r.license) for r in got) == Counter(
        {(1, "MIT"): 1, (2, None): 1, (3, "GPL-3.0"): 1, (7, "CC-BY-NC-4.0"): 2, (8, None): 1})
    assert [(r.start, r.end) for r in got if r.doc_id == 1] == [(10, 41)]


def test_compression_finds_what_trying_all_differences_finds():
    plain, templates = licenses.packers()
    rng = random.Random(3)
    for t, (_, wording) in zip(templates, licenses.TEMPLATES, strict=True):
        noise = " ".join(rng.choice(["the", "a", "code", "file"]) for _ in range(5))
        for block in (wording, wording.upper(), f"{noise} {wording} {noise}"):
            fits = {x.name for x in templates if not any(licenses.difference(x.words, licenses.words(block)))}
            assert licenses.identify(block, plain, templates)[0] in fits and t.name in fits


MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""


def found_licenses(text):
    return [r[2] for r in licenses.notices(text, *licenses.packers())]


def test_compression_decides(monkeypatch):
    """With compressors that tell nothing no template is ranked, and none is confirmed."""
    text = "\n\n".join(wording for _, wording in licenses.TEMPLATES[:6])
    assert sum(x is not None for x in found_licenses(text)) >= 6

    class Blind:
        def compress(self, data):
            return b""

    _, templates = licenses.packers()
    blind = [licenses.Template(t.name, t.words, Blind()) for t in templates]
    assert all(x[2] is None for x in licenses.notices(text, Blind(), blind))


def test_wrapped_templates_are_found():
    around = "the code of a file that one may run " * 20
    assert found_licenses(MIT_TEXT)[0] == "MIT"
    for name, wording in licenses.TEMPLATES:
        for width in (10, 20, 40, 60, 72, 80, 1000):
            for mark in ("", "# ", " * "):
                notice = "\n".join(mark + x for x in textwrap.wrap(wording, width, break_long_words=False, break_on_hyphens=False))
                for text in (notice, f"{around}\n{notice}\n{around}"):
                    assert found_licenses(text) == [name], (name, width, mark)


def test_all_licenses_of_a_block_are_found():
    assert found_licenses("Licensed under the MIT License.\nAll rights reserved.") == ["MIT", "All rights reserved"]
    assert found_licenses("x All rights reserved. Licensed under CC BY 4.0. or Licensed under CC BY-NC 4.0. y") == [
        "All rights reserved", "CC-BY-4.0", "CC-BY-NC-4.0"]
    rng = random.Random(8)
    for sep in (" ", "\n", " or\n", "\n" + "some words of code\n" * 9):
        picked = [rng.choice(licenses.TEMPLATES) for _ in range(60)]
        assert found_licenses(sep.join(text for _, text in picked)) == [name for name, _ in picked]


# --- all
def test_empty_tables_of_stages_and_labels(spark, empty, docs):
    assert quality.keep_good(empty, None).count() == simhash.keep_one_of_near(empty).count() == 0
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(docs, no_labels) is None and quality.train(empty, no_labels) is None
    odd = spark.createDataFrame([(9, 1), (9, 0), (None, 1), (10, None), (11, 7)], "doc_id long, quality int")
    assert quality.train(docs, odd) is None  # one label is left: the smaller one of 9


def test_empty_tables(spark, empty):
    path = tokenizer_path()
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for frame in (packing.pack(empty, path), simhash.near_duplicates(empty), licenses.scan(empty), sharding.assign(empty, 3),
                  exact_dedup.exact_groups(empty), quality.judge(empty, None), lm.score(empty), pii.report(empty), pii.sanitise(empty),
                  chat.read_back(chat.format_turns(turns)), bpe.round_trip(empty, path), exact_dedup.keep_one_of_equal(empty)):
        assert frame.count() == 0
