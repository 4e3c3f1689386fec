"""Models: preprocessing, boosted one-vs-rest, persistence, CV."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from stratakit.operators.learn import build_preprocessor, feature_names, fit_multiclass, make_pipeline, \
    make_classifier, with_probs
from stratakit.operators.sampling import train_test
from stratakit.plans import inputs as I
from stratakit.plans.training import cross_validate
from stratakit.presets import SURROGATE as L

from conftest import SF0001

CAT, NUM = L.categorical_inputs, L.numeric_inputs
SMALL = {"n_estimators": 2, "max_depth": 2}


def test_unseen_category_becomes_the_zero_block(spark):
    train = spark.createDataFrame([("a", 1.0, 0), ("b", 2.0, 1)], "c string, x double, label int")
    pre = make_pipeline(["c"], ["x"], make_classifier("logistic", maxIter=5)).fit(train)
    test = spark.createDataFrame([("zzz", 3.0, 0), (None, 1.0, 0), ("b", 0.0, 1)], "c string, x double, label int")
    vecs = [r.v for r in pre.transform(test).select(vector_to_array("features").alias("v")).collect()]
    assert vecs[0] == [0.0, 0.0, 3.0] and vecs[1] == [0.0, 0.0, 1.0] and vecs[2] == [0.0, 1.0, 0.0]
    assert feature_names(pre, ["c"], ["x"]) == ["c_a", "c_b", "x"]


@pytest.fixture(scope="module")
def frame(spark):
    return I.model_frame(spark, SF0001).cache()


def test_boosted_ovr_probabilities_and_roundtrip(spark, frame, tmp_path):
    train, test = train_test(frame, "label", "row_index")
    model = fit_multiclass(train, CAT, NUM, list(L.forbidden), "boosted", None, SMALL)
    scored = with_probs(model.transform(test))
    bad = scored.where(F.abs(F.col("p0") + F.col("p1") + F.col("p2") - 1) > 1e-9).count()
    assert bad == 0
    path = str(tmp_path / "model")
    model.write().overwrite().save(path)
    again = with_probs(PipelineModel.load(path).transform(test))
    a = {r.row_index: (r.p0, r.p1, r.p2) for r in scored.select("row_index", "p0", "p1", "p2").collect()}
    b = {r.row_index: (r.p0, r.p1, r.p2) for r in again.select("row_index", "p0", "p1", "p2").collect()}
    assert a == b


def test_leakage_guard_runs_before_fit(spark, frame):
    with pytest.raises(ValueError, match="model inputs: leaks"):
        fit_multiclass(frame.withColumn("number_of_vehicles", F.lit(1)), CAT, NUM,
                       list(L.forbidden), "forest", None, {"numTrees": 2})


def test_cross_validation_gives_one_row_per_fold_and_full_oof(spark, frame):
    train, _ = train_test(frame, "label", "row_index")
    rows, oof = cross_validate(train, categorical=CAT, numeric=NUM, forbidden=list(L.forbidden),
                               row_id="row_index", k=3, kind="forest", params={"numTrees": 3, "maxDepth": 3},
                               balance="weighted", collect_oof=True)
    r = rows.collect()
    assert sorted(x.fold for x in r) == [0, 1, 2]
    assert sum(x.validation_rows for x in r) == train.count() == oof.count()


def test_fold_local_fit_ignores_validation_labels(spark, frame):
    """Changing labels of the validation fold must not change the fitted model."""
    from stratakit.operators.sampling import stratified_kfold

    tagged = stratified_kfold(frame, "label", "row_index", 3).cache()
    fit_rows = tagged.where("fold != 0").drop("fold")
    flipped = tagged.withColumn("label", F.when(F.col("fold") == 0, 2 - F.col("label"))
                                .otherwise(F.col("label"))).where("fold != 0").drop("fold")
    m1 = fit_multiclass(fit_rows, CAT, NUM, list(L.forbidden), "logistic", None, {"maxIter": 5})
    m2 = fit_multiclass(flipped, CAT, NUM, list(L.forbidden), "logistic", None, {"maxIter": 5})
    assert m1.stages[-1].coefficientMatrix == m2.stages[-1].coefficientMatrix


def test_parallel_folds_give_the_same_result(spark, frame):
    train, _ = train_test(frame, "label", "row_index")
    kw = dict(categorical=CAT, numeric=NUM, forbidden=list(L.forbidden), row_id="row_index", k=3,
              kind="boosted", params={**SMALL, "parallelism": 3}, balance="weighted")
    a = {r.fold: r.macro_f1 for r in cross_validate(train, **kw)[0].collect()}
    b = {r.fold: r.macro_f1 for r in cross_validate(train, parallel_folds=3, **kw)[0].collect()}
    assert a == b


def test_alphas_near_the_winner():
    from stratakit.plans.training import alphas_near

    assert alphas_near(0.4) == [0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55]
    assert alphas_near(0) == [0.0, 0.05, 0.1, 0.15]
    assert alphas_near(1.0, 0.1, 0.04) == [0.92, 0.96, 1.0]
    assert alphas_near(0.12, 0.0, 0.1) == [0.12]
    for bad in ((1.01, 0.1, 0.1), (0.5, -0.1, 0.1), (0.5, 0.1, 0.0)):
        with pytest.raises(ValueError):
            alphas_near(*bad)


KW = dict(categorical=CAT, numeric=NUM, forbidden=list(L.forbidden), row_id="row_index")
FOREST = {"numTrees": 3, "maxDepth": 3}


def by_fold(rows):
    return {r.fold: (r.validation_rows, r.training_rows, round(r.macro_f1, 9), round(r.accuracy, 9)) for r in rows.collect()}


def test_shared_designs_give_the_folds_own_results(spark, frame):
    from stratakit.operators.sampling import stratified_kfold
    from stratakit.plans.training import fold_designs

    tagged = stratified_kfold(frame, "label", "row_index", 3).cache()
    designs = fold_designs(tagged, CAT, NUM, list(L.forbidden), "row_index", "label", 3)
    # a forest's bootstrap depends on how rows are dealt; boosted trees don't
    kw = dict(k=3, kind="boosted", params={**SMALL, "parallelism": 3}, balance="weighted", tagged=tagged, **KW)
    assert by_fold(cross_validate(frame, **kw)[0]) == by_fold(cross_validate(frame, designs=designs, **kw)[0])
    with pytest.raises(ValueError, match="leaks"):
        fold_designs(tagged.withColumn("number_of_vehicles", F.lit(1)), CAT, NUM, list(L.forbidden), "row_index", "label", 3)


def test_ordinal_pair_scores_every_row_once(spark, frame):
    rows, oof = cross_validate(frame, k=3, params=SMALL, ordinal=True, collect_oof=True, **KW)
    assert sum(r.validation_rows for r in rows.collect()) == oof.count() == frame.count()
    assert oof.where("p0 < 0 OR p1 < -1e-12 OR p2 < 0 OR abs(p0 + p1 + p2 - 1) > 1e-9").count() == 0


def test_stopped_search_goes_on_and_finishes(spark, frame, tmp_path, monkeypatch):
    """Killed after one candidate, a search evaluates only the others; other data share nothing."""
    from stratakit.operators.decide import threshold_match
    from stratakit.plans import training
    from stratakit.plans.ledger import SearchLedger, finish, registry
    from stratakit.sources.store import StoredTable

    cands = [{"order": i, "numTrees": 2 + i, "maxDepth": 2 + i} for i in range(3)]
    kw = dict(kind="forest", balance="weighted", **KW)
    done, whole = [], training.cross_validate

    def counted(*a, **k):
        if len(done) == 1 and k["params"]["numTrees"] == 3 and not any(d == "killed" for d in done):
            done.append("killed")
            raise KeyboardInterrupt
        done.append(k["params"]["numTrees"])
        return whole(*a, **k)

    monkeypatch.setattr(training, "cross_validate", counted)
    path = str(tmp_path / "search")
    with pytest.raises(KeyboardInterrupt):
        training.search(frame, cands, rule="first", key_cols=["order"], ledger=SearchLedger(spark, path, "v1"), **kw)
    ledger = SearchLedger(spark, path, "v1")
    summary, winner = training.search(frame, cands, rule="first", key_cols=["order"], ledger=ledger, **kw)
    assert done == [2, "killed", 3, 4]
    again, same = training.search(frame, cands, rule="first", key_cols=["order"], ledger=ledger, **kw)
    assert done == [2, "killed", 3, 4] and same == winner and summary.count() == 3
    best = max(r.macro_f1_mean for r in summary.collect())
    assert winner["macro_f1_mean"] == best and winner["numTrees"] == 2 + winner["order"]
    other = SearchLedger(spark, path, "v2")
    assert other.key("search", cands[0], {}) != ledger.key("search", cands[0], {})

    end = finish(frame, winner, ledger=ledger, slug="tuned", name="Tuned", artifact="models/tuned", fresh_folds=5, with_threshold=True, **kw)
    assert sorted(r.fold for r in end.folds.collect()) == [0, 1, 2, 3, 4]
    entry = registry(ledger).collect()
    assert [(r.model_artifact, r.status, r.threshold) for r in entry] == [("models/tuned", "ready", end.threshold["threshold"])]
    assert StoredTable(spark, f"{path}/threshold_results").read().count() == 201
    scored = with_probs(end.model().transform(frame)).withColumn("model_artifact", F.lit("models/tuned"))
    assert threshold_match(scored, registry(ledger)).where("threshold IS NULL").count() == 0
    once_more = finish(frame, winner, ledger=ledger, slug="tuned", name="Tuned", artifact="models/tuned", fresh_folds=None,
                       searched=ledger.rows([winner["key"]]), **kw)
    results = StoredTable(spark, f"{path}/cv_results").read()
    assert sorted((r.slug, r.fold) for r in results.collect()) == [("tuned", 0), ("tuned", 1), ("tuned", 2)]
    assert once_more.threshold is None
