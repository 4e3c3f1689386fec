"""Frames that several jobs read are stored: nobody repeats the plan behind them."""

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratakit.operators import sampling as S
from stratakit.operators.explain import permutation_importance
from stratakit.operators.learn import BoostedOvR, fit_binary_pair, fit_multiclass, pooled_rows
from stratakit.plans import inputs as I
from stratakit.plans import q_evaluate, q_sampling
from stratakit.plans.training import cross_validate
from stratakit.session import fits_at_once, write_once

SF0001 = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(spark, n=300):
    return spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("label"),
                                 F.concat(F.lit("c"), F.col("id") % 4).alias("c"), (F.col("id") % 5).cast("double").alias("x"))


def _watched(df, column):
    """``df`` and a counter of how often a row's ``column`` was computed."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def look(v):
        seen.add(1)
        return v
    return df.withColumn(column, F.udf(look, T.DoubleType()).asNondeterministic()(column)), seen


def test_split_reads_its_input_once(spark):
    df, seen = _watched(_rows(spark), "x")
    train, test = S.train_test(df, "label", "row_id")
    assert train.count() + test.count() == 300 and train.agg(F.sum("x")).first()[0] > 0
    assert seen.value == 300
    assert "Exchange" not in _plan(train) + _plan(test)


def test_folds_join_no_rows_by_shuffle(spark):
    folds = S.stratified_kfold(write_once(_rows(spark), "rows"), "label", "row_id", k=3)
    assert "SortMergeJoin" not in _plan(folds) and "BroadcastHashJoin" in _plan(folds)
    assert sorted(r["count"] for r in folds.groupBy("fold").count().collect()) == [100, 100, 100]


@pytest.mark.parametrize("kind, params", [("logistic", {"maxIter": 3}), ("forest", {"numTrees": 2, "maxDepth": 2}),
                                          ("boosted", {"n_estimators": 2, "max_depth": 2})])
def test_fit_encodes_the_rows_once(spark, kind, params):
    df, seen = _watched(_rows(spark), "x")
    fit_multiclass(df, ["c"], ["x"], [], kind, None, params)
    assert seen.value == 300


def test_pooled_rows_weigh_what_their_rows_weigh(spark):
    df = _rows(spark).select("label", array_to_vector(F.array("x")).alias("features"),
                             (F.col("row_id") % 2 + 1).alias("w"))
    pooled, name = pooled_rows(df, "features", ["label"])
    assert pooled.count() == 15 and pooled.agg(F.sum(name)).first()[0] == 300
    weighed, name = pooled_rows(df, "features", ["label"], "w")
    assert weighed.agg(F.sum(name)).first()[0] == 450


def test_pooling_keeps_the_trees(spark):
    """Equal rows once with their number grow the trees of all rows; fits that sample rows see every row."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    df = _rows(spark).withColumn("z", (F.col("row_id") % 7).cast("double")).withColumn("label", ((F.col("x") * 3 + F.col("z")) % 3).cast("int"))
    design = VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(df).select("label", "features")
    model = BoostedOvR(maxIter=2, maxDepth=2).fit(design)
    for c, pooled in enumerate(model.models):
        alone = GBTClassifier(maxIter=2, maxDepth=2, stepSize=0.1, seed=42).fit(design.withColumn("label", (F.col("label") == c).cast("double")))
        points = [Vectors.dense(x, z) for x in range(5) for z in range(7)]
        assert [pooled.predict(p) for p in points] == [alone.predict(p) for p in points]
        assert max(abs(a - b) for p in points for a, b in zip(pooled.predictProbability(p), alone.predictProbability(p))) < 1e-9
    assert len(BoostedOvR(maxIter=1, maxDepth=1, subsamplingRate=0.5).fit(design).models) == 3
    assert len(fit_binary_pair(design, {"n_estimators": 1, "max_depth": 1, "min_child_weight": 5})) == 2


def test_validation_reads_the_frame_once(spark):
    df, seen = _watched(_rows(spark), "x")
    train, _ = S.train_test(df, "label", "row_id")
    rows, _ = cross_validate(train, categorical=["c"], numeric=["x"], forbidden=[], row_id="row_id", k=3, kind="boosted", params={"n_estimators": 1, "max_depth": 1},
                             balance="downsampled", caps={1: 50}, parallel_folds=3)
    assert rows.count() == 3 and seen.value == 300


def test_importance_reads_the_frame_once(spark):
    model = fit_multiclass(_rows(spark), ["c"], ["x"], [], "forest", None, {"numTrees": 2, "maxDepth": 2})
    df, seen = _watched(_rows(spark), "x")
    assert permutation_importance(model, df, ["c", "x"], "row_id").count() == 2
    assert seen.value == 300


def test_fits_at_once_follow_the_memory(spark):
    assert fits_at_once(spark, 3, 1_000) == 3
    assert fits_at_once(spark, 3, 10 ** 12) == 1


def test_fold_scores_are_the_joined_ones(spark):
    rows = I.labelled(spark, SF0001)
    got = I.fold_scores(rows).select("row_index", "p0", "fold")
    folds = S.stratified_kfold(I.model_frame(spark, SF0001).select("row_index", "label"), "label", "row_index", k=5)
    want = I.scores(spark, SF0001).join(folds.select("row_index", "fold"), "row_index").select("row_index", "p0", "fold")
    assert sorted(got.collect()) == sorted(want.collect())
    assert "Exchange" not in _plan(got)


@pytest.mark.parametrize("query", [q_evaluate.q_upsert, q_evaluate.q_candidate_summary, q_evaluate.q_fold_summary, q_evaluate.q_select_candidate,
                                   q_sampling.q_oof, q_sampling.q_balanced, q_sampling.q_one_hot])
def test_records_are_deduplicated_before_the_result_is_read(spark, query):
    """The result reads stored rows, so no plan of it goes back to the raw records."""
    assert "lineitem" not in _plan(query(spark, SF0001))
