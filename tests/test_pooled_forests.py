"""Forests grow from pooled rows; every row draws its own bootstrap count for every tree."""

import math
import os

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from stratakit.operators.learn import DRAWN, TIMES, ForestModel, build_preprocessor, fit_forest, fit_multiclass, pack_columns, pooled_draws, with_probs
from stratakit.plans import training
from stratakit.session import ensure_checkpoint_dir

CV = dict(categorical=["c"], numeric=["x"], forbidden=[], row_id="row_id")
FOREST = {"numTrees": 3, "maxDepth": 3}


def _rows(spark, n=600):
    return spark.range(n).select(F.col("id").alias("row_id"), F.when(F.col("id") % 10 == 0, 0).when(F.col("id") % 10 < 4, 1).otherwise(2).alias("label"),
                                 F.concat(F.lit("c"), F.col("id") % 4).alias("c"), (F.col("id") % 5).cast("double").alias("x"))


def _stored(spark, name):
    home = ensure_checkpoint_dir(spark)
    return {f"{home}/{f}" for f in os.listdir(home) if f.startswith(f"{name}-")}


def test_every_row_draws_a_poisson_number(spark):
    one = pooled_draws(_rows(spark, 40_000), ["row_id"], ["c"], "row_id", 2)
    for t in range(2):
        share = {r[0]: r["count"] / 40_000 for r in one.groupBy(f"{DRAWN}{t}").count().collect()}
        assert all(abs(share[k] - math.exp(-1) / math.factorial(k)) < 0.01 for k in range(4))
    assert abs(one.stat.corr(f"{DRAWN}0", f"{DRAWN}1")) < 0.02


def test_draws_add_up_and_depend_on_no_partition(spark):
    rows = _rows(spark)
    pooled = pooled_draws(rows, ["label"], ["c", "x"], "row_id", 2)
    alone = pooled_draws(rows.repartition(7), ["row_id", "label"], ["c", "x"], "row_id", 2)
    cols = [TIMES, f"{DRAWN}0", f"{DRAWN}1"]
    want = alone.groupBy("label", "c", "x").agg(*[F.sum(c) for c in cols])
    assert sorted(map(tuple, pooled.select("label", "c", "x", *cols).collect())) == sorted(map(tuple, want.collect()))
    assert pooled.count() < 60 and pooled.agg(F.sum(TIMES)).first()[0] == 600


def test_pooled_forest_is_that_of_its_rows(spark, tmp_path):
    """The trees are those of a forest fitted to the single rows, each as often as its bootstrap drew it."""
    rows = _rows(spark).withColumn("__w", F.lit(1.0) + F.col("label"))
    model = fit_multiclass(rows, ["c"], ["x"], [], "forest", "__w", FOREST, row_id="row_id")
    encode = PipelineModel(model.stages[:-1])
    drawn = pooled_draws(rows, ["row_id", "label", "__w"], ["c", "x"], "row_id", 3)
    single = encode.transform(drawn)
    trees = [RandomForestClassifier(numTrees=1, maxDepth=3, bootstrap=False, featureSubsetStrategy="sqrt", seed=42 + t, weightCol="w").fit(
        single.where(f"{DRAWN}{t} > 0").withColumn("w", F.col("__w") * F.col(f"{DRAWN}{t}"))) for t in range(3)]
    path = str(tmp_path / "model")
    model.write().save(path)
    again = PipelineModel.load(path)
    assert isinstance(again.stages[-1], ForestModel) and len(again.stages[-1].models) == 3
    points = rows.select("c", "x").distinct()
    want = {}
    for m in trees:
        for r in m.transform(encode.transform(points)).select("c", "x", vector_to_array("probability").alias("p")).collect():
            want.setdefault((r.c, r.x), []).append(r.p)
    got = with_probs(again.transform(points)).collect()
    assert len(got) == 20
    for r in got:
        means = [sum(p) / 3 for p in zip(*want[r.c, r.x])]
        assert [r.p0, r.p1, r.p2] == pytest.approx(means, abs=1e-9)
        assert r.prediction == max(range(3), key=lambda c: (r[f"p{c}"], -c))


def test_bootstrap_without_a_class_keeps_it(spark):
    rows = _rows(spark, 200)
    design = build_preprocessor([], ["x"])[-1].transform(rows).select("label", "features", (F.col("label") < 2).cast("int").alias(f"{DRAWN}0"))
    scored = with_probs(fit_forest(design, {"numTrees": 1, "maxDepth": 2}).transform(design))
    assert scored.where("p2 != 0 OR abs(p0 + p1 - 1) > 1e-9").count() == 0


def test_search_stores_and_scores_pooled_rows(spark):
    """Before, every fold's design held a row for each of the frame's rows, and every forest cached them all."""
    before = _stored(spark, "design-0"), _stored(spark, "folds")
    summary, winner = training.search(_rows(spark), [{"candidate": 1, "alpha": 0.3}, {"candidate": 2, "alpha": 0.8, "numTrees": 5}], rule="joint",
                                      key_cols=["candidate", "alpha"], kind="forest", params=FOREST, balance="interpolated", **CV)
    (design,) = _stored(spark, "design-0") - before[0]
    stored = spark.read.parquet(design)
    assert stored.count() <= 180 and stored.agg(F.sum(TIMES)).first()[0] == 600 and f"{DRAWN}4" in stored.columns
    assert _stored(spark, "folds") == before[1]
    assert summary.count() == 2 and winner["candidate"] in (1, 2)


def test_pooled_validation_counts_what_single_scores_say(spark):
    kw = dict(k=3, kind="forest", params=FOREST, balance="weighted", parallel_folds=3, **CV)
    pooled, none = training.cross_validate(_rows(spark), **kw)
    single, oof = training.cross_validate(_rows(spark).repartition(5), collect_oof=True, **kw)
    assert none is None and oof.count() == 600
    assert sorted(pooled.collect()) == sorted(single.collect())
    assert sorted((r.validation_rows, r.training_rows) for r in pooled.collect()) == [(200, 400)] * 3


def test_forests_that_count_rows_see_single_rows(spark):
    rows, _ = training.cross_validate(_rows(spark), k=3, kind="forest", params={**FOREST, "minInstancesPerNode": 4}, **CV)
    assert rows.count() == 3


def test_packed_columns_come_back(spark):
    """Nulls, NaN and columns with many values or of other types too; a shuffle of the packed rows is narrow."""
    rows = _rows(spark).select("row_id", "label", F.when(F.col("row_id") % 7 > 0, F.col("c")).alias("c"),
                               F.when(F.col("row_id") % 11 == 0, float("nan")).otherwise(F.col("x")).alias("x"),
                               F.lit(None).cast("string").alias("none"), (F.col("row_id") % 2 == 0).alias("even"),
                               F.md5(F.col("row_id").cast("string")).alias("many"), F.array("x").alias("list"))
    packed, unpack = pack_columns(rows, ["c", "x", "none", "even", "many", "list"], 100)
    assert packed.columns == ["row_id", "label", "none", "many", "list", "__packed"]
    back = unpack(packed).select(*rows.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect())) and back.dtypes == rows.dtypes
    assert pack_columns(rows, ["many"], 100)[0].columns == rows.columns
    wide = rows.select(*[F.concat(F.lit("v"), F.col("row_id") % 100).alias(f"w{i}") for i in range(12)])
    some, back = pack_columns(wide, wide.columns, 200)
    assert some.columns == ["w9", "w10", "w11", "__packed"] and back(some).select(*wide.columns).distinct().count() == 100
