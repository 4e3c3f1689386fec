"""Folds of several sizes come from one ranking, and metrics of folds from stored counts."""

import pytest
from pyspark.sql import functions as F

from stratakit.operators import sampling as S
from stratakit.plans import inputs as I
from stratakit.plans import q_evaluate as Q

SF0001 = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(spark, n=500):
    return spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("label"))


def test_folds_of_several_sizes_equal_those_of_each(spark):
    both = S.stratified_folds(_rows(spark), "label", "row_id", {"three": 3, "five": 5})
    assert both.columns == ["row_id", "label", "three", "five"]
    for name, k in (("three", 3), ("five", 5)):
        one = S.stratified_kfold(_rows(spark), "label", "row_id", k=k)
        assert sorted(both.select("row_id", name).collect()) == sorted(one.select("row_id", "fold").collect())
    with pytest.raises(ValueError):
        S.stratified_folds(_rows(spark), "label", "row_id", {"three": 3, "one": 1})


def test_shuffled_rows_of_folds_carry_no_order_key(spark):
    plan = S.stratified_kfold(_rows(spark), "label", "row_id", k=3)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression"):].splitlines()
    assert not any("__h" in line for line in below)


@pytest.mark.parametrize("key", ["null", "twice"])
def test_folds_still_refuse_ids_that_have_no_order(spark, key):
    bad = _rows(spark, 20).withColumn("row_id", F.when(F.col("row_id") > 2, F.col("row_id")) if key == "null" else F.lit(7))
    with pytest.raises(Exception, match="null" if key == "null" else "not unique"):
        S.stratified_kfold(bad, "label", "row_id", k=3).collect()


@pytest.mark.parametrize("query", [Q.q_upsert, Q.q_candidate_summary, Q.q_fold_summary, Q.q_fold_rows])
def test_metrics_of_folds_read_counts(spark, query):
    """Before, the result read every row's scores again, once a fold table or threshold."""
    plan = _plan(query(spark, SF0001))
    assert "fold-counts" in plan and "fold-scores" not in plan


def test_counts_hold_every_scored_row(spark):
    rows = I.labelled(spark, SF0001)
    counts = I.fold_counts(rows, {"a": 5, "b": 3}, {"first": F.col("p0") >= 0.2})
    scored = I.fold_scores(rows)
    assert counts.agg(F.sum("n")).first()[0] == scored.count() == rows.where("whole").count()
    assert counts.where("a = 2 AND first").agg(F.sum("n")).first()[0] == scored.where("fold = 2 AND p0 >= 0.2").count()
