"""Metrics, thresholds, curves, cohorts, registry."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratakit.operators import decide as Dc
from stratakit.operators import evaluate as E


def _yp(spark, y, p):
    return spark.createDataFrame(list(zip(y, p)), "y int, pred int")


def test_confusion_rows_are_true_labels(spark):
    m = E.confusion(_yp(spark, [0, 1, 2], [0, 2, 2]))
    grid = [[0] * 3 for _ in range(3)]
    for r in m.collect():
        grid[r.true_label][r.pred_label] = r["count"]
    assert grid == [[1, 0, 0], [0, 0, 1], [0, 0, 1]]


def _metrics_from_matrix(spark, cm):
    rows = [(i, j) for i in range(3) for j in range(3) for _ in range(cm[i][j])]
    return E.class_metrics(spark.createDataFrame(rows, "y int, pred int")).first()


def test_published_matrix_golden(spark):
    cm = [[113, 2681, 1014], [320, 21201, 18258], [974, 98337, 151071]]
    m = _metrics_from_matrix(spark, cm)
    assert m.macro_f1 == pytest.approx(0.3410755195970963, abs=1e-12)
    assert m.accuracy == pytest.approx(0.5864053692736308, abs=1e-12)


def test_macro_f1_averages_labels_seen_in_truth_or_prediction(spark):
    m = E.class_metrics(_yp(spark, [1, 1, 2, 2], [1, 2, 2, 2])).first()
    # label 0 is absent from both: macro over {1, 2}
    assert m.macro_f1 == pytest.approx((2 / 3 + 0.8) / 2)
    assert m.fatal_precision == 0.0 and m.fatal_f1 == 0.0


def test_threshold_decision(spark):
    df = spark.createDataFrame([(.4, .5, .1), (.2, .3, .5), (.7, .2, .1)], "p0 double, p1 double, p2 double")
    assert [r.pred for r in E.apply_threshold(df, 0.4).collect()] == [0, 2, 0]
    with pytest.raises(ValueError):
        E.apply_threshold(df, 0.4, ("p0", "p1"))


def test_one_pass_sweep_equals_separate_passes(spark):
    rng = np.random.default_rng(11)
    p = rng.dirichlet([1, 2, 3], 400)
    p[:5, 0] = [0.0, 0.005, 0.015, 0.5, 1.0]          # values exactly on grid points
    y = rng.integers(0, 3, 400)
    df = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(y, p)],
                               "y int, p0 double, p1 double, p2 double")
    sweep = {round(r.threshold, 6): r for r in E.threshold_sweep(df).collect()}
    grid = np.linspace(0, 1, 201)
    assert len(sweep) == 201
    for t in grid[::10]:
        ref = E.threshold_metrics(df, float(t)).first()
        got = sweep[round(float(t), 6)]
        assert got.macro_f1 == pytest.approx(ref.macro_f1, abs=1e-12)
        assert got.predicted_fatal_proportion == pytest.approx(ref.predicted_fatal_proportion)
    best = E.select_threshold(E.threshold_sweep(df)).first()
    key = max(sweep.values(), key=lambda r: (r.macro_f1, r.fatal_f1, r.threshold))
    assert best.threshold == key.threshold


def test_candidate_selection_rules(spark):
    rows = spark.createDataFrame([(.6, .4), (.4, .4), (.2, .3)], "alpha double, macro_f1_mean double")
    assert E.select_candidate(rows, "alpha").first().alpha == 0.4
    joint = spark.createDataFrame([(3, .5), (1, .5), (2, .4)], "candidate int, macro_f1_mean double")
    assert E.select_candidate(joint, "joint").first().candidate == 1



def _ap_brute(y, s):
    order = np.argsort(-s, kind="stable")
    ys, ss = y[order], s[order]
    ap, tp, prev_r = 0.0, 0, 0.0
    pos = ys.sum()
    i = 0
    while i < len(ss):
        j = i
        while j < len(ss) and ss[j] == ss[i]:
            j += 1
        tp += ys[i:j].sum()
        prec = tp / j
        r = tp / pos
        ap += (r - prev_r) * prec
        prev_r = r
        i = j
    return ap


def test_pr_curve_and_average_precision_with_ties(spark):
    rng = np.random.default_rng(5)
    s = np.round(rng.random(400), 2)          # many ties
    y = (rng.random(400) < s * 0.5).astype(int)
    df = spark.createDataFrame([(0 if a else 1, float(b)) for a, b in zip(y, s)], "y int, score double")
    curve = E.pr_curve(df, "y", "score")
    pts = curve.collect()
    assert len(pts) == len(set(s)) + 1
    end = [r for r in pts if r.threshold is None][0]
    assert (end.precision, end.recall) == (1.0, 0.0)
    ap = E.average_precision(curve).first().average_precision
    assert ap == pytest.approx(_ap_brute(y, s), abs=1e-9)


def test_operating_point_zero_when_nothing_selected(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.2)], "y int, score double")
    r = E.operating_point(df, "y", "score", 0.9).first()
    assert (r.precision, r.recall) == (0.0, 0.0)


def test_error_cohorts(spark):
    out = E.error_cohorts(_yp(spark, [0, 1], [1, 1])).collect()
    assert [r.error_type for r in out] == ["Fatal → Serious", "Correct"]


def test_cumulative_targets_and_ordinal_composition(spark):
    t = Dc.cumulative_targets(spark.createDataFrame([(0,), (1,), (2,)], "label int")).collect()
    assert [(r.serious_or_worse, r.rare) for r in t] == [(1, 1), (1, 0), (0, 0)]
    df = spark.createDataFrame([(.4, .7), (.8, .2)], "s_worse double, s_rare double")
    got = [(r.p0, r.p1, r.p2) for r in Dc.ordinal_compose(df, check=True).collect()]
    assert got[0] == pytest.approx((.55, 0.0, .45)) and got[1] == pytest.approx((.2, .6, .2))


def test_argmax_prefers_the_lowest_index_on_ties(spark):
    df = spark.createDataFrame([(.4, .4, .2), (.2, .4, .4), (.1, .2, .7)], "p0 double, p1 double, p2 double")
    assert [r.pred for r in Dc.argmax_predict(df).collect()] == [0, 1, 2]


def test_threshold_registry_match(spark):
    models = spark.createDataFrame([("m/a",), ("m/b",), ("m/c",)], "model_artifact string")
    reg = spark.createDataFrame([("m/a", "ready", 0.3), ("m/b", "pending", 0.2), ("m/x", "ready", 0.1)],
                                "model_artifact string, status string, threshold double")
    got = {r.model_artifact: r.threshold for r in Dc.threshold_match(models, reg).collect()}
    assert got == {"m/a": 0.3, "m/b": None, "m/c": None}


def test_threshold_match_by_broadcast_and_by_shuffle(spark):
    """One artifact on nearly every scored row (the hot key): the salted join
    gives the same rows broadcast or shuffled."""
    models = spark.range(500).select(F.col("id").alias("row_id"),
                                     F.when(F.col("id") % 50 == 0, "m/b").otherwise("m/a")
                                      .alias("model_artifact"))
    reg = spark.createDataFrame([("m/a", "ready", 0.3), ("m/b", "pending", 0.2), ("m/x", "ready", 0.1)],
                                "model_artifact string, status string, threshold double")
    want = sorted(tuple(r) for r in Dc.threshold_match(models, reg).collect())
    salted = Dc.threshold_match(models, reg.hint("merge"))
    assert salted.columns == ["row_id", "model_artifact", "threshold"]
    got = sorted(tuple(r) for r in salted.collect())
    assert got == want and len(got) == 500
    assert sum(1 for r in got if r[2] == 0.3) == 490


def test_upsert_replaces_only_the_new_keys(spark):
    cur = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "slug string, fold int")
    new = spark.createDataFrame([("a", 9)], "slug string, fold int")
    got = sorted((r.slug, r.fold) for r in E.upsert_by_key(cur, new).collect())
    assert got == [("a", 9), ("b", 1)]


def test_fold_summary_uses_sample_std(spark):
    rows = spark.createDataFrame([("s", 0, .3, .5), ("s", 1, .5, .5)],
                                 "slug string, fold int, macro_f1 double, accuracy double")
    for c in E.FOLD_METRICS[2:]:
        rows = rows.withColumn(c, F.lit(0.0))
    got = {r.metric: r for r in E.fold_summary(rows).collect()}
    assert got["macro_f1"].mean == pytest.approx(0.4) and got["macro_f1"].std == pytest.approx(np.std([.3, .5], ddof=1))


def test_threshold_match_with_vector_columns(spark):
    """Scored frames carry ML vectors; the salt hashes atomic columns only."""
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("row_id", T.LongType()),
                           T.StructField("model_artifact", T.StringType()),
                           T.StructField("probability", VectorUDT())])
    models = spark.createDataFrame([(i, "m/a", Vectors.dense([0.1 * i, 1.0])) for i in range(20)],
                                   schema)
    reg = spark.createDataFrame([("m/a", "ready", 0.3)], "model_artifact string, status string, threshold double")
    got = Dc.threshold_match(models, reg).collect()
    assert len(got) == 20 and all(r.threshold == 0.3 for r in got)
