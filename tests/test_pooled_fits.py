"""Parts of a split are filters on rows stored once, and boosted fits read their rows once, pooled."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratakit.operators import sampling as S
from stratakit.operators.learn import fit_ordinal_pair, pooled_rows
from stratakit.plans import training
from stratakit.plans.heldout import Family, HeldOut
from stratakit.plans.ledger import SearchLedger
from stratakit.session import ensure_checkpoint_dir

TINY = {"n_estimators": 1, "max_depth": 2}


def _rows(spark, n=300):
    return spark.range(n).select(F.col("id").alias("row_id"), F.when(F.col("id") % 10 == 0, 0).when(F.col("id") % 10 < 4, 1).otherwise(2).alias("label"),
                                 F.concat(F.lit("c"), F.col("id") % 4).alias("c"), (F.col("id") % 5).cast("double").alias("x"))


def _watched(df, column):
    seen = df.sparkSession.sparkContext.accumulator(0)

    def look(v):
        seen.add(1)
        return v
    return df.withColumn(column, F.udf(look, T.DoubleType()).asNondeterministic()(column)), seen


def _stored(spark, name):
    return {f for f in os.listdir(ensure_checkpoint_dir(spark)) if f.startswith(f"{name}-")}


@pytest.mark.parametrize("n, digits", [(300, 3), (300, 1), (7, 1), (1, 3), (0, 3)])
def test_rule_tags_the_rows_of_the_split(spark, n, digits):
    df = _rows(spark, n).withColumn("label", F.when(F.col("row_id") % 13 != 5, F.col("label")))
    want = S.stratified_split(df, "label", "row_id", 0.3, digits=digits).where("is_test").select("row_id").collect()
    got = df.where(S.split_rule(df, "label", "row_id", 0.3, digits=digits)).select("row_id").collect()
    assert sorted(got) == sorted(want)


def test_split_is_not_stored_beside_its_rows(spark):
    before = _stored(spark, "split"), _stored(spark, "rows")
    train, test = S.train_test(_rows(spark), "label", "row_id")
    assert test.count() == 60 and train.count() == 240 and train.columns == _rows(spark).columns
    assert _stored(spark, "split") == before[0] and len(_stored(spark, "rows") - before[1]) == 1


def test_pair_reads_its_rows_once(spark):
    df, seen = _watched(_rows(spark), "x")
    fit_ordinal_pair(df, ["c"], ["x"], TINY)
    assert seen.value == 300


def test_families_read_the_training_rows_once(spark):
    train, test = S.train_test(_rows(spark), "label", "row_id")
    watched, seen = _watched(train, "x")
    held = HeldOut.fit(watched, test, [Family("a", params=TINY, balance="interpolated", alpha=0.5), Family("b", params=TINY, balance="weighted"),
                                       Family("o", "ordinal", TINY)], categorical=["c"], numeric=["x"], forbidden=[], row_id="row_id")
    assert held.scores().count() == 180 and seen.value == 240


def test_pooled_weights_are_the_rows_weights(spark):
    pooled, times = pooled_rows(_rows(spark), ["c", "x"], ["label"])
    for balance in ("weighted", "interpolated", "none"):
        rows, w = training.prepare_training(pooled, "label", "row_id", balance, 0.4, None, times)
        single, v = training.prepare_training(_rows(spark), "label", "row_id", balance, 0.4, None)
        told = {r[0]: r[1] for r in single.groupBy("label").agg(F.sum(v) if v else F.count("*")).collect()}
        assert {r[0]: r[1] for r in rows.groupBy("label").agg(F.sum(w)).collect()} == pytest.approx(told)
    with pytest.raises(ValueError, match="single rows"):
        training.prepare_training(pooled, "label", "row_id", "downsampled", None, {1: 5}, times)


def test_stages_of_a_search_share_designs_and_candidates(spark, monkeypatch):
    """The coarse winner is on the fine grid; before, it was fitted twice, on a second set of designs."""
    evaluated, made = [], []
    cross, designs = training.cross_validate, training.fold_designs
    monkeypatch.setattr(training, "cross_validate", lambda *a, **k: evaluated.append(k["alpha"]) or cross(*a, **k))
    monkeypatch.setattr(training, "fold_designs", lambda *a: made.append(1) or designs(*a))
    ledger = SearchLedger(spark)
    both, winner, fine = training.interpolated_search(_rows(spark), [0.0, 1.0], 0.5, 0.5, ledger=ledger, kind="forest", params={"numTrees": 2, "maxDepth": 2},
                                                      categorical=["c"], numeric=["x"], forbidden=[], row_id="row_id")
    assert sorted(evaluated) == [0.0, 0.5, 1.0] and len(made) == 1
    assert both.where("stage = 'fine'").count() == len(fine) == 2 and both.count() == 4
    assert ledger.table.read().count() == 12 and ledger.rows([winner["key"]]).where("stage = 'fine'").count() == 3
