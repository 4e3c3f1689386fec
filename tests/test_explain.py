"""Overlap and attribution."""

import pytest

from stratakit.operators import explain as G


def _ov(df):
    return {(r.class_a, r.class_b): r.overlap for r in df.collect()}


def test_numeric_overlap_uses_common_bins(spark):
    df = spark.createDataFrame(list(zip([0, 0, 0, 0, 10, 10], [0, 0, 1, 1, 2, 2])), "x int, label int")
    got = _ov(G.overlap_numeric(df, "x", bins=2))
    assert got[("Fatal", "Serious")] == pytest.approx(1.0)
    assert got[("Fatal", "Slight")] == pytest.approx(0.0)


def test_categorical_overlap(spark):
    df = spark.createDataFrame(list(zip(["wet"] * 3 + ["dry"] * 3, [0, 0, 1, 1, 2, 2])), "x string, label int")
    assert _ov(G.overlap_categorical(df, "x"))[("Fatal", "Serious")] == pytest.approx(0.5)


def test_overlap_class_without_rows_and_missing_level(spark):
    df = spark.createDataFrame([("a", 0), (None, 0), ("a", 2)], "x string, label int")
    got = _ov(G.overlap_categorical(df, "x"))
    assert got[("Fatal", "Serious")] == 0.0 and got[("Fatal", "Slight")] == pytest.approx(0.5)
    const = spark.createDataFrame([(5.0, 0), (5.0, 1)], "x double, label int")
    assert _ov(G.overlap_numeric(const, "x"))[("Fatal", "Serious")] == pytest.approx(1.0)
    none = spark.createDataFrame([(float("nan"), 0)], "x double, label int")
    with pytest.raises(ValueError):
        G.overlap_numeric(none, "x")


def test_dist_kind_rule(spark):
    df = spark.createDataFrame([(i % 3, float(i), str(i)) for i in range(30)], "a int, b double, c string")
    kinds = {r.feature: r.kind for r in G.dist_kind(df, ["a", "b", "c"]).collect()}
    assert kinds == {"a": "categorical", "b": "numeric", "c": "categorical"}
    kinds = {r.feature: r.kind for r in G.dist_kind(df, ["b"], frozenset({"b"})).collect()}
    assert kinds["b"] == "categorical"


def test_attribution_is_summed_to_source_columns(spark):
    names = ["Road_Type_1", "Road_Type_6", "Light_Conditions_1", "hour_sin", "hour_cos"]
    sources = ["Road_Type", "Road_Type", "Light_Conditions", "hour_sin", "hour_cos"]
    feats = spark.createDataFrame([(n, s, None, i) for i, (n, s) in enumerate(zip(names, sources))],
                                  "feature string, source string, level string, position int")
    attr = spark.createDataFrame([(r, i, 0, 1.0) for r in range(3) for i in range(len(names))],
                                 "row_id int, position int, class int, value double")
    by = {r.source_feature: r for r in G.attribution_by_source(attr, feats).collect()}
    assert by["Road_Type"].mean_abs_shap == pytest.approx(2.0)
    assert by["Road_Type"].components == ["Road_Type_1", "Road_Type_6"]
    assert by["Hour_of_Day"].components == ["hour_sin", "hour_cos"]
    # equal totals tie-break by name; the single-column source ranks last
    assert (by["Hour_of_Day"].rank, by["Road_Type"].rank, by["Light_Conditions"].rank) == (1, 2, 3)


def test_linear_attribution_sums_to_margin_minus_mean(spark):
    design = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 0, 0.0), (1, 1, 1.0)],
                                   "row_id int, position int, x double")
    coef = [[2.0, -1.0], [0.5, 0.5]]
    attr = {(r.row_id, r.position, r["class"]): r.value
            for r in G.linear_attribution(design, "row_id", coef).collect()}
    # means: x0 = .5, x1 = 2
    assert attr[(0, 0, 0)] == pytest.approx(1.0) and attr[(0, 1, 0)] == pytest.approx(-1.0)
    assert attr[(1, 1, 1)] == pytest.approx(-0.5)


def test_summaries_from_counts_equal_the_row_level_attribution(spark):
    """The closed form against every row's own attribution, with nulls and a numeric one-hot source."""
    from pyspark.sql import functions as F

    rows = [(i, None if i % 11 == 0 else "abc"[i % 3], 10 if i % 4 else 9, float(i * i % 17), None if i == 5 else i % 5 - 2.0, i % 3) for i in range(80)]
    df = spark.createDataFrame(rows, "row_id int, a string, b int, x double, y double, label int")
    counts = G.level_counts(df, {c: F.col(c) for c in ("a", "b", "x", "y")})
    feats = G.design_columns(counts, ["a", "b"], ["x", "y"])
    assert [tuple(r) for r in feats.orderBy("position").collect()] == [
        ("a_a", "a", "a", 0), ("a_b", "a", "b", 1), ("a_c", "a", "c", 2), ("b_9", "b", "9", 3), ("b_10", "b", "10", 4), ("x", "x", None, 5), ("y", "y", None, 6)]
    design = G.one_hot_long(df, "row_id", ["a", "b"], ["x", "y"], feats)
    attr = G.linear_attribution(design, "row_id", G.fixed_coefficients(7))
    want = {(r.position, r["class"]): tuple(r)[2:] for r in attr.groupBy("position", "class").agg(
        F.avg(F.abs("value")), F.max("value"), F.min("value"), F.count("value")).collect()}
    got = {(r.position, r["class"]): (r.m, r.largest, r.smallest, r.n) for r in G.linear_means(G.deviations(counts, feats), G.fixed_coefficient).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-12)


def test_feature_without_values_and_text_that_is_no_number(spark):
    df = spark.createDataFrame([(None, "1", 0), (None, "x", 1), (None, "3", 2)], "gone double, text string, label int")
    assert {(r.feature, r.levels, r.kind) for r in G.dist_kind(df, ["gone", "text"]).collect()} == {("gone", 0, "categorical"), ("text", 3, "categorical")}
    assert {r.overlap for r in G.overlaps_by_kind(df, ["gone"]).collect()} == {1.0}
    assert _ov(G.overlap_numeric(df, "text", bins=2))[("Fatal", "Slight")] == 0.0
