"""Model-based queries (no SQL oracle: rows-only check; invariants are unit
tests).  Small settings keep them quick at sf0.01; every one trains on the
whole training split of the given tables."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ..operators import decide as Dc
from ..operators import evaluate as E
from ..operators import explain as G
from ..operators.clean import TimeFeatures, target_encode
from ..operators.learn import PROB_COLS, fit_multiclass, with_probs
from ..operators.sampling import train_test
from ..session import ensure_checkpoint_dir
from ..sources.sinks import scratch_path
from ..streaming.scoring import run_until, start_scoring
from . import inputs as I
from .heldout import Family, HeldOut, fitted_attribution, model_error_analysis
from .ledger import SearchLedger, finish
from .oracle_base import with_ctes
from .q_sampling import QUOTAS, SPLIT
from .registry import register
from .training import cross_validate, interpolated_search, search

L = I.L
CAT, NUM = L.categorical_inputs, L.numeric_inputs
SMALL = {"n_estimators": 3, "max_depth": 3, "learning_rate": 0.3, "parallelism": 3}
FOREST = {"numTrees": 8, "maxDepth": 5}
CV = dict(categorical=CAT, numeric=NUM, forbidden=list(L.forbidden), row_id="row_index",
          parallel_folds=3)
DERIVED = {"Season", "hour_sin", "hour_cos", "rush_hour"}
RAW_INPUTS = [c for c in CAT + NUM if c not in DERIVED] + [L.date, L.time]


def _train(spark, d):
    return train_test(I.model_frame(spark, d, once=True), "label", "row_index")


@register("cv_baseline")
def q_cv_baseline(spark, d):
    """E3 + D3 + E12: boosted one-vs-rest, majority caps inside each fold."""
    train, _ = _train(spark, d)
    rows, _ = cross_validate(train, k=3, kind="boosted", params=SMALL, balance="downsampled",
                             caps={1: 6000, 2: 6000}, name="Boosted baseline (downsampled)",
                             slug="baseline_boosted", **CV)
    return rows


@register("cv_weighted")
def q_cv_weighted(spark, d):
    """Fold-local balanced class weights."""
    train, _ = _train(spark, d)
    rows, _ = cross_validate(train, k=3, kind="boosted", params=SMALL, balance="weighted",
                             name="Boosted weighted", slug="weighted_boosted", **CV)
    return rows


@register("cv_ordinal")
def q_cv_ordinal(spark, d):
    """E8 + E9 + E10: two balanced binary boosters composed per fold."""
    train, _ = _train(spark, d)
    rows, _ = cross_validate(train, k=3, params=SMALL, ordinal=True, name="Ordinal pair",
                             slug="ordinal_boosted", **CV)
    return rows


@register("oof_threshold")
def q_oof_threshold(spark, d):
    """E12 with OOF scores -> one-pass sweep -> selected threshold."""
    train, _ = _train(spark, d)
    _, oof = cross_validate(train, k=3, kind="forest", params=FOREST, balance="weighted",
                            collect_oof=True, **CV)
    return E.select_threshold(E.threshold_sweep(oof, "y"))


@register("tuned_search")
def q_tuned_search(spark, d):
    """E5: candidates x 3 folds, winner by mean macro-F1 (first on a tie)."""
    train, _ = _train(spark, d)
    cands = [{"order": 0, "numTrees": 5, "maxDepth": 3}, {"order": 1, "numTrees": 8, "maxDepth": 5}]
    summary, _ = search(train, cands, rule="first", key_cols=["order"], kind="forest",
                        balance="weighted", **CV)
    return summary


@register("interpolated_search")
def q_interpolated_search(spark, d):
    """Coarse alphas then the fine grid; the winner is from fine rows."""
    train, _ = _train(spark, d)
    both, _, _ = interpolated_search(train, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0], 0.15, 0.05,
                                     kind="forest", params=FOREST, **CV)
    return both


@register("joint_search")
def q_joint_search(spark, d):
    """(parameters, alpha) candidates, ties -> lower candidate number."""
    train, _ = _train(spark, d)
    cands = [{"candidate": 1, "alpha": 0.3, "maxDepth": 4, "numTrees": 6},
             {"candidate": 2, "alpha": 0.8, "maxDepth": 5, "numTrees": 6}]
    summary, _ = search(train, cands, rule="joint", key_cols=["candidate", "alpha"],
                        kind="forest", balance="interpolated", **CV)
    return summary


# --- whole searches: ledger, validation, results, model, registry entry ---------

#: Folds of the training rows: per k, fold and its rows.
FOLD_SIZES = f"""
  SELECT k, CAST((off + rk - 1) % k AS INTEGER) AS fold, count(*) AS n
  FROM (SELECT t.label, o.off, row_number() OVER (PARTITION BY t.label ORDER BY
               md5(concat('42:', CAST(t.row_index AS VARCHAR))), t.row_index) AS rk
        FROM train t JOIN (SELECT label, coalesce(sum(count(*)) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING
                                                                      AND 1 PRECEDING), 0) AS off
                           FROM train GROUP BY label) o USING (label)) r
       CROSS JOIN (VALUES (3), (5)) ks(k)
  GROUP BY k, fold"""


def _folds_sql(stages: list[tuple[str, int, str, str]], candidates: str) -> str:
    """Rows of the ledger as SQL sees them: every stage's candidates and folds."""
    parts = [f"SELECT '{stage}' AS stage, {number} AS candidate, fold, n AS validation_rows, (SELECT count(*) FROM train) - n AS training_rows "
             f"FROM sizes {join} WHERE k = {k}" for stage, k, number, join in stages]
    body = "\n  UNION ALL ".join(parts)
    return with_ctes(["model_frame"], f"""
  SELECT stage, CAST(candidate AS INTEGER) AS candidate, fold, CAST(validation_rows AS BIGINT) AS validation_rows,
         CAST(training_rows AS BIGINT) AS training_rows, 1 AS ready_models, {candidates} AS evaluated
  FROM ({body}) x""", extra=[("quotas", QUOTAS), ("split", SPLIT), ("train", "SELECT row_index, label FROM split WHERE NOT is_test"),
                             ("sizes", FOLD_SIZES)])


def _ledger_rows(ledger: SearchLedger, end, column: str):
    """The ledger's fold rows and how many candidates were evaluated; a model that can be
    loaded and, where a threshold belongs to it, is ``ready``, counts."""
    rows = ledger.table.read()
    searched = rows.where(F.col("stage") != "validation").select("key").distinct().count()
    return rows.select("stage", F.col(column).cast("int").alias("candidate"), "fold", F.col("validation_rows").cast("bigint").alias("validation_rows"),
                       F.col("training_rows").cast("bigint").alias("training_rows"),
                       F.lit(int(len(end.model().stages) > 0)).alias("ready_models"), F.lit(searched).alias("evaluated"))


@register("tuned_search_folds", _folds_sql([("search", 3, "o", "CROSS JOIN (VALUES (0), (1)) c(o)"),
                                            ("validation", 5, "NULL", "")], "2"))
def q_tuned_search_folds(spark, d):
    """E5 to its end: search, fresh five folds with OOF, threshold, upsert, refit, ``ready`` entry."""
    train, _ = _train(spark, d)
    ledger = SearchLedger(spark)
    cands = [{"order": 0, "numTrees": 3, "maxDepth": 3}, {"order": 1, "numTrees": 5, "maxDepth": 4}]
    cv = dict(kind="forest", balance="weighted", **CV)
    _, winner = search(train, cands, rule="first", key_cols=["order"], ledger=ledger, **cv)
    end = finish(train, winner, ledger=ledger, slug="tuned_forest", name="Tuned", artifact="models/tuned", with_threshold=True, **cv)
    rows = _ledger_rows(ledger, end, "order")
    return rows.withColumn("candidate", F.when(F.col("stage") == "search", F.col("candidate")))


@register("interpolated_search_folds", _folds_sql([("coarse", 3, "a", "CROSS JOIN (VALUES (0), (100)) c(a)"),
                                                   ("fine", 3, "NULL", "CROSS JOIN (VALUES (0), (1)) c(x)")], "4"))
def q_interpolated_search_folds(spark, d):
    """E6 to its end: the coarse ends 0 and 1, the two fine alphas that lie near either, the winner's
    folds as results, refit.  The candidate is the alpha in hundredths; fine ones depend on the model."""
    train, _ = _train(spark, d)
    ledger = SearchLedger(spark)
    cv = dict(kind="forest", params={"numTrees": 4, "maxDepth": 4}, ledger=ledger, **CV)
    _, winner, _ = interpolated_search(train, [0.0, 1.0], 0.05, 0.05, **cv)
    end = finish(train, winner, slug="interpolated_forest", name="Interpolated", artifact="models/interpolated", fresh_folds=None,
                 searched=ledger.rows([winner["key"]]), balance="interpolated", **cv)
    rows = _ledger_rows(ledger, end, "alpha")
    return rows.withColumn("candidate", F.when(F.col("stage") == "coarse", F.col("candidate") * 100))


@register("joint_search_folds", _folds_sql([("search", 3, "o", "CROSS JOIN (VALUES (1), (2)) c(o)"),
                                            ("validation", 5, "NULL", "")], "2"))
def q_joint_search_folds(spark, d):
    """E7 to its end: search, fresh five folds, upsert, refit."""
    train, _ = _train(spark, d)
    ledger = SearchLedger(spark)
    cands = [{"candidate": 1, "alpha": 0.3, "maxDepth": 3, "numTrees": 4}, {"candidate": 2, "alpha": 0.8, "maxDepth": 4, "numTrees": 4}]
    cv = dict(kind="forest", balance="interpolated", **CV)
    _, winner = search(train, cands, rule="joint", key_cols=["candidate", "alpha"], ledger=ledger, **cv)
    end = finish(train, winner, ledger=ledger, slug="joint_forest", name="Joint", artifact="models/joint", **cv)
    rows = _ledger_rows(ledger, end, "candidate")
    return rows.withColumn("candidate", F.when(F.col("stage") == "search", F.col("candidate")))


def _raw_pipeline(spark, d):
    """Pipeline on raw prediction-time fields: date/time strings go through
    the TimeFeatures stage inside the fitted model."""
    ret = target_encode(I.retained(spark, d, once=True), L.severity, check="plan").drop(L.severity)
    train, test = train_test(ret, "label", "row_index")
    model = fit_multiclass(train, CAT, NUM, list(L.forbidden), "boosted", None, SMALL,
                           pre_stages=[TimeFeatures(dateCol=L.date, timeCol=L.time)],
                           required=RAW_INPUTS)
    return model, test


@register("model_roundtrip")
def q_model_roundtrip(spark, d):
    """Save to the shared checkpoint folder, reload, identical scores
    that sum to one."""
    model, test = _raw_pipeline(spark, d)
    path = f"{ensure_checkpoint_dir(spark)}/models/{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    a = with_probs(model.transform(test)).select("row_index", *PROB_COLS)
    b = with_probs(again.transform(test)).select(
        "row_index", *[F.col(p).alias(f"r_{p}") for p in PROB_COLS])
    j = a.join(b, "row_index")
    diff = F.greatest(*[F.abs(F.col(p) - F.col(f"r_{p}")) for p in PROB_COLS])
    return j.agg(F.count(F.lit(1)).alias("rows"), F.max(diff).alias("max_abs_diff"),
                 F.max(F.abs(F.col("p0") + F.col("p1") + F.col("p2") - 1)).alias("max_sum_error"))


@register("score_scenarios")
def q_score_scenarios(spark, d):
    """E13 as a batch job: transform + registered-threshold decision."""
    model, test = _raw_pipeline(spark, d)
    reg = spark.createDataFrame([("baseline", "ready", 0.2)],
                                "model_artifact string, status string, threshold double")
    dec = Dc.score_scenarios(model, test.drop("label"), reg, "baseline", list(L.forbidden),
                             RAW_INPUTS)
    return dec.groupBy("decision").agg(F.count(F.lit(1)).alias("count"))


_TEST_ROWS = [("quotas", QUOTAS), ("split", SPLIT), ("test", "SELECT row_index, label FROM split WHERE is_test")]


@register("stream_scoring", with_ctes(["model_frame"], """
  SELECT CAST(row_index % 2 AS INTEGER) AS wave, count(*) AS rows, CAST(0 AS BIGINT) AS repeated,
         CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS differing
  FROM test GROUP BY 1""", extra=_TEST_ROWS))
def q_stream_scoring(spark, d):
    """E13 as a stream over the test split: one wave of files is scored by a stream that is stopped
    after its first batch, a second wave arrives, and a new stream goes on from the checkpoint.
    Per wave: rows, and how many the sink has twice, lacks, or has unlike the batch job's."""
    model, test = _raw_pipeline(spark, d)
    home = scratch_path(spark, "stream")
    source, sink = f"{home}/incoming", f"{home}/scored"
    arriving = test.drop("label").withColumn("wave", F.pmod(F.col("row_index"), F.lit(2)).cast("int"))
    reg = spark.createDataFrame([("baseline", "ready", 0.2)], "model_artifact string, status string, threshold double")
    stream = dict(schema=arriving.schema, model=model, registry=reg, artifact="baseline", sink=sink, keep=["row_index", "wave"],
                  checkpoint=f"{home}/progress", forbidden=list(L.forbidden), required=RAW_INPUTS)
    arriving.where("wave = 0").write.mode("append").parquet(source)
    run_until(start_scoring(spark, source, available_now=False, files_per_batch=1, **stream), 1)
    arriving.where("wave = 1").write.mode("append").parquet(source)
    start_scoring(spark, source, **stream).awaitTermination()
    cells = [*PROB_COLS, "threshold", "decision"]
    streamed = spark.read.parquet(sink).select("row_index", F.struct(*cells).alias("streamed"))
    seen = streamed.groupBy("row_index").agg(F.count(F.lit(1)).alias("times"), F.first("streamed").alias("streamed"))
    batch = Dc.score_scenarios(model, spark.read.schema(arriving.schema).parquet(source), reg, "baseline", list(L.forbidden), RAW_INPUTS,
                               ["row_index", "wave"])
    both = batch.select("row_index", "wave", F.struct(*cells).alias("batch")).join(seen, "row_index", "left")
    return both.groupBy("wave").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("times") > 1).alias("repeated"),
        F.count_if(F.col("times").isNull()).alias("missing"),
        F.count_if(~F.col("batch").eqNullSafe(F.col("streamed"))).alias("differing"))


#: Six settings, as small as the other queries' here; positions as in the study's comparison.
FAMILIES = [
    Family("baseline", "boosted", SMALL, "downsampled", caps={1: 6000, 2: 6000}),
    Family("weighted", "boosted", SMALL, "weighted"),
    Family("tuned", "boosted", {**SMALL, "max_depth": 4}, "weighted"),
    Family("interpolated", "boosted", SMALL, "interpolated", alpha=0.6),
    Family("joint", "boosted", {**SMALL, "max_depth": 2}, "interpolated", alpha=0.3),
    Family("ordinal", "ordinal", SMALL),
]


def _held_out(spark, d, families):
    train, test = _train(spark, d)
    return HeldOut.fit(train, test, families, categorical=CAT, numeric=NUM, forbidden=list(L.forbidden), row_id="row_index")


@register("held_out_comparison")
def q_held_out_comparison(spark, d):
    """F14 on fitted models: six families fitted on one design of the training rows, the test split
    scored by all of them in one plan, metrics of one grouped aggregate."""
    return E.model_comparison(_held_out(spark, d, FAMILIES).predictions(), [f.name for f in FAMILIES])


@register("held_out_support", with_ctes(["model_frame"], """
  SELECT f.model, CAST(t.label AS INTEGER) AS y, count(*) AS rows, count(*) AS predicted
  FROM test t CROSS JOIN (VALUES ('interpolated'), ('ordinal')) f(model) GROUP BY 1, 2""", extra=_TEST_ROWS))
def q_held_out_support(spark, d):
    """Coverage of the held-out frame: every model has every test row once, with a class in range."""
    long = _held_out(spark, d, [f for f in FAMILIES if f.name in ("interpolated", "ordinal")]).predictions()
    return long.groupBy("model", F.col("y").cast("int").alias("y")).agg(
        F.countDistinct("row_index").alias("rows"), F.count_if(F.col("pred").isin(0, 1, 2)).alias("predicted"))


@register("held_out_error_analysis")
def q_held_out_error_analysis(spark, d):
    """G7 on a fitted model: its sources ranked by attribution on the test split, the top five with
    their kinds and class overlaps in the test split."""
    train, test = _train(spark, d)
    model = fit_multiclass(train, CAT, NUM, list(L.forbidden), "logistic", None, {"maxIter": 50, "regParam": 0.01})
    return model_error_analysis(model, test, CAT, NUM, labelled=frozenset(L.label_maps()))


@register("permutation_importance")
def q_permutation_importance(spark, d):
    """G4 (model-agnostic): macro-F1 drop when one source column is replaced
    by a deterministic derangement of itself, all columns in one job."""
    train, test = _train(spark, d)
    model = fit_multiclass(train, CAT, NUM, list(L.forbidden), "forest", None, FOREST, row_id="row_index")
    return G.permutation_importance(model, test, CAT + ["speed_limit", "rush_hour"],
                                    "row_index", "label",
                                    groups={"Hour_of_Day": ["hour_sin", "hour_cos"]})


@register("lr_attribution")
def q_lr_attribution(spark, d):
    """G4 (linear): exact attribution of a fitted multinomial logistic
    model on the test split, summarised by source column (G5)."""
    train, test = _train(spark, d)
    model = fit_multiclass(train, CAT, NUM, list(L.forbidden), "logistic", None,
                           {"maxIter": 50, "regParam": 0.01})
    counts = G.level_counts(test, {c: F.col(c) for c in CAT + NUM})
    return fitted_attribution(model, counts, CAT, NUM)
