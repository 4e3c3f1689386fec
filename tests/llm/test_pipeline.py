"""The pipeline's stages against plain versions on the hard-case corpus."""

from collections import Counter, defaultdict

import corpus_pipeline
from stratakit.llm import exact_dedup, simhash

from .test_operators import LOWER, components_of, plain_fingerprint


def test_exact_stage_keeps_one_of_each_text(corpus, docs):
    got = exact_dedup.keep_one_of_equal(docs)
    assert got.columns == docs.columns
    best = {}
    for i, t in corpus:
        key = (t or "").translate(LOWER)
        best[key] = max((x for x in (best.get(key), i) if x is not None), default=None)
    assert Counter(((r.text or "").translate(LOWER), r.doc_id) for r in got.collect()) == Counter(best.items())


def test_near_stage_keeps_the_smallest_id(corpus, docs):
    got = simhash.keep_one_of_near(docs)
    assert got.columns == docs.columns
    fp = {t: plain_fingerprint(t) for _, t in corpus}
    root = components_of(set(fp.values()), 3)
    least = defaultdict(list)
    for i, t in corpus:
        least[root[fp[t]]].append(i)
    want = Counter(min((i for i in ids if i is not None), default=None) for ids in least.values())
    assert Counter(r.doc_id for r in got.collect()) == want


def test_stages_run_over_documents(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
    packed = corpus_pipeline.run(spark, sf_dir)
    assert 0 < packed.select("doc_id").distinct().count() < before
