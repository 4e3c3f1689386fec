"""Fitted models on the held-out split: comparison (F14) and error analysis."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from stratakit.operators import evaluate as E
from stratakit.operators import explain as G
from stratakit.operators.learn import PROB_COLS, fit_multiclass, fit_ordinal_pair, ordinal_scores, with_probs
from stratakit.operators.sampling import train_test
from stratakit.plans import inputs as I
from stratakit.plans.heldout import Family, HeldOut, model_error_analysis
from stratakit.presets import SURROGATE as L

from conftest import SF0001

CAT, NUM = L.categorical_inputs, L.numeric_inputs
TINY = {"n_estimators": 2, "max_depth": 2}


@pytest.fixture(scope="module")
def splits(spark):
    return train_test(I.model_frame(spark, SF0001).cache(), "label", "row_index")


def _fit(splits, families):
    return HeldOut.fit(*splits, families, categorical=CAT, numeric=NUM, forbidden=list(L.forbidden), row_id="row_index")


def test_every_model_scores_as_it_does_alone(spark, splits):
    train, test = splits
    held = _fit(splits, [Family("plain", "boosted", TINY), Family("pair", "ordinal", TINY)])
    long = held.scores()
    assert long.count() == 2 * test.count() == long.select("model", "row_index").distinct().count()
    alone = with_probs(fit_multiclass(train, CAT, NUM, list(L.forbidden), "boosted", None, TINY).transform(test))
    pair = ordinal_scores(*fit_ordinal_pair(train, CAT, NUM, TINY, list(L.forbidden)), test, ["row_index"])
    for name, other in (("plain", alone), ("pair", pair)):
        j = long.where(F.col("model") == name).join(other.select("row_index", *[F.col(p).alias(f"a_{p}") for p in PROB_COLS]), "row_index")
        assert j.count() == test.count()
        assert j.where(" OR ".join(f"abs({p} - a_{p}) > 1e-9" for p in PROB_COLS)).count() == 0


def test_comparison_keeps_the_order_and_equals_metrics_by_hand(spark, splits):
    held = _fit(splits, [Family("b", "forest", {"numTrees": 3, "maxDepth": 3}, "weighted"), Family("a", "boosted", TINY, "downsampled", caps={1: 200, 2: 200})])
    preds = held.predictions().cache()
    rows = E.model_comparison(preds, ["b", "a"]).orderBy("position").collect()
    assert [r.model for r in rows] == ["b", "a"]
    for r in rows:
        told = [(x.y, x.pred) for x in preds.where(F.col("model") == r.model).collect()]
        assert r.accuracy == pytest.approx(sum(y == p for y, p in told) / len(told))
        hits, claimed, real = (sum(c) for c in zip(*[((y == p == 0), (p == 0), (y == 0)) for y, p in told], strict=True))
        assert r.fatal_recall == pytest.approx(hits / real) and r.fatal_precision == pytest.approx(hits / claimed if claimed else 0.0)


def test_families_need_names_and_a_clean_frame(splits):
    with pytest.raises(ValueError, match="distinct names"):
        _fit(splits, [Family("a"), Family("a")])
    train, test = splits
    with pytest.raises(ValueError, match="leaks"):
        HeldOut.fit(train.withColumn("number_of_vehicles", F.lit(1)), test, [Family("a")], categorical=CAT, numeric=NUM,
                    forbidden=list(L.forbidden), row_id="row_index")


def test_error_analysis_ranks_by_attribution_of_the_rows_themselves(spark, splits):
    train, test = splits
    model = fit_multiclass(train, CAT, NUM, list(L.forbidden), "logistic", None, {"maxIter": 10, "regParam": 0.01})
    got = model_error_analysis(model, test, CAT, NUM).collect()
    assert len(got) == 15 and sorted({r.rank for r in got}) == [1, 2, 3, 4, 5]
    # plain version: mean |coefficient * (x - mean)| of the rare class over the design's rows, summed by source
    names = G.feature_table_from_model(model, CAT, NUM).orderBy("position").collect()
    coef = model.stages[-1].coefficientMatrix.toArray()[0]
    rows = [r.v for r in model.transform(test).select(vector_to_array("features").alias("v")).collect()]
    means = [sum(c) / len(rows) for c in zip(*rows, strict=True)]
    by: dict[str, float] = {}
    for j, f in enumerate(names):
        source = "Hour_of_Day" if f.source in ("hour_sin", "hour_cos") else f.source
        by[source] = by.get(source, 0.0) + sum(abs(coef[j] * (r[j] - means[j])) for r in rows) / len(rows)
    want = sorted(by, key=by.get, reverse=True)[:5]
    assert [f for _, f in sorted({(r["rank"], r.feature) for r in got})] == want
    for r in got:
        assert r.mean_abs_shap == pytest.approx(by[r.feature], abs=1e-8) and 0 <= r.overlap <= 1
