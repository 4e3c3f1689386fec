"""Forests of a search grow together, from counts, into the trees that Spark's trainer fits one by one."""

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from stratakit.operators import forests, learn
from stratakit.operators.forests import Packing, code_rows
from stratakit.operators.learn import DRAWN, TIMES, pooled_draws
from stratakit.plans import training

CV = dict(categorical=["c", "d"], numeric=["x", "y"], forbidden=[], row_id="row_id")
FOREST = {"numTrees": 3, "maxDepth": 4}


def _rows(spark, n=900):
    h = F.pmod(F.xxhash64("id"), F.lit(100))
    return spark.range(n).select(F.col("id").alias("row_id"), F.when(h < 8, 0).when(h < 40, 1).otherwise(2).alias("label"),
                                 F.when(F.col("id") % 13 > 0, F.concat(F.lit("c"), F.col("id") % 4)).alias("c"), (F.col("id") % 12).cast("int").alias("d"),
                                 F.sin(F.col("id") % 50).alias("x"), (h % 7).cast("int").alias("y"))


@pytest.fixture
def fits(monkeypatch):
    """Counts fits of Spark's trainer and passes over pooled rows."""
    seen = {"fits": 0, "passes": 0}
    fit, counted = RandomForestClassifier._fit, forests._counted

    def fitted(*a):
        seen["fits"] += 1
        return fit(*a)

    def passed(*a):
        seen["passes"] += 1
        return counted(*a)

    monkeypatch.setattr(RandomForestClassifier, "_fit", fitted)
    monkeypatch.setattr(forests, "_counted", passed)
    return seen


def test_search_passes_over_its_rows_once_a_level(spark, fits):
    """Before, three folds of four alphas with three trees were 36 fits, each with several passes of its own."""
    both, _, fine = training.interpolated_search(_rows(spark), [0.0, 1.0], 0.1, 0.1, kind="forest", params=FOREST, **CV)
    assert both.count() == 2 + len(fine)
    assert fits["fits"] == 0 and fits["passes"] <= 1 + 2 * FOREST["maxDepth"]


@pytest.mark.parametrize("weights", [None, {0: 4.0, 1: 2.0, 2: 1.0}])
def test_trees_are_those_of_the_trainer(spark, weights):
    """The same features a node, splits (32 bins of 50 values of x), stops and pruning, with unseen and null categories."""
    weight = F.lit(1.0) if weights is None else F.element_at(F.create_map(*[F.lit(x) for p in weights.items() for x in p]), F.col("label"))
    pooled = pooled_draws(_rows(spark), ["label"], ["c", "d", "x", "y"], "row_id", 3)
    coded = code_rows(pooled, None, ["c", "d"], ["x", "y"], [f"{DRAWN}{t}" for t in range(3)], TIMES)
    grown = learn.fit_coded_forest(coded, FOREST, weights)
    design = learn.Pipeline(stages=learn.build_preprocessor(["c", "d"], ["x", "y"])).fit(pooled).transform(pooled).withColumn("w", weight)
    want = learn.fit_forest(design, FOREST, "w", 3)
    tree = [m.toDebugString.split("\n", 1)[1] for m in want.models]
    assert [m.toDebugString.split("\n", 1)[1] for m in grown.models] == tree and "If" in tree[0]
    assert [m.numFeatures for m in grown.models] == [m.numFeatures for m in want.models]


def test_features_are_drawn_as_spark_draws_them(spark):
    random = spark._jvm.java.util.Random(45)
    assert [random.nextLong() for _ in range(4)] == [n for n, _ in zip(forests._longs(45), range(4))]
    sampling = spark._jvm.org.apache.spark.util.random.XORShiftRandom(-12345678901)
    want = list(range(5))
    for item in range(5, 40):
        at = int(sampling.nextDouble() * (item + 1))
        if at < 5:
            want[at] = item
    assert forests._reservoir(40, 5, -12345678901) == want


def test_scores_are_the_models_scores(spark):
    rows = _rows(spark)
    pooled = training.pooled_folds(rows, ["c", "d"], ["x", "y"], [], "row_id", "label", 2, 42, 3, True)
    coded = code_rows(pooled.packed, pooled.packing, ["c", "d"], ["x", "y"], [f"{DRAWN}{t}" for t in range(3)], TIMES)
    grown = training.fold_forests(coded, [{"params": FOREST, "balance": "weighted"}], 2)[0]
    got = {r.row_id: (r.p0, r.p1, r.p2) for r in forests.score(pooled.packed_single, coded, dict(enumerate(grown)), ["row_id"], learn.PROB_COLS).collect()}
    assert len(got) == 900
    for held in range(2):
        encoder = learn.Pipeline(stages=learn.build_preprocessor(["c", "d"], ["x", "y"])).fit(pooled.rows.where(F.col("fold") != held))
        model = learn.ForestModel(forests.tree_models(spark, coded, grown[held], held))
        scored = learn.with_probs(model.transform(encoder.transform(pooled.single.where(F.col("fold") == held))))
        for r in scored.select("row_id", "p0", "p1", "p2").collect():
            assert got[r.row_id] == pytest.approx((r.p0, r.p1, r.p2), abs=1e-12)


def test_parts_of_a_level_grow_the_same_trees(spark, monkeypatch):
    kw = dict(k=3, kind="forest", params=FOREST, balance="weighted", shared={}, **CV)
    whole = sorted(training.cross_validate(_rows(spark), **kw)[0].collect())
    monkeypatch.setattr(forests, "MOST_CELLS", 1)
    assert sorted(training.cross_validate(_rows(spark), **kw)[0].collect()) == whole


def test_inputs_of_many_values_are_left_to_the_trainer(spark, fits):
    rows = _rows(spark).withColumn("x", F.col("row_id") * 0.5)
    kept, _ = training.cross_validate(rows, k=3, kind="forest", params=FOREST, shared={}, **CV)
    assert sum(r.validation_rows for r in kept.collect()) == 900 and fits["fits"] == 9
    summary, _ = training.search(rows, [{"order": 0, "numTrees": 2}], rule="first", key_cols=["order"], kind="forest", params=FOREST, **CV)
    assert summary.count() == 1 and fits["fits"] == 15


def test_packing_tells_zero_of_either_sign_and_null(spark):
    rows = spark.createDataFrame([(1, -0.0, None), (2, 0.0, True), (3, None, False), (4, 2.5, True)], "i int, x double, b boolean")
    packing = Packing.of(rows, ["x", "b"])
    packed = packing.pack(rows)
    assert packed.columns == ["i", "__packed"]
    assert sorted(map(tuple, packing.unpack(packed).collect()), key=lambda r: r[0]) == [(1, 0.0, None), (2, 0.0, True), (3, None, False), (4, 2.5, True)]
    with pytest.raises(Exception, match="has changed"):
        packing.pack(rows.withColumn("x", F.lit(7.0))).collect()
