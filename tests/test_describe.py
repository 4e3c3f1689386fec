"""Descriptive tables against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratakit.operators import describe as D


def test_cramers_v_perfect_association_and_symmetry(spark):
    df = spark.createDataFrame(list(zip("aabbcc", [1, 1, 2, 2, 3, 3])), "a string, b int")
    assert D.cramers_v(df, "a", "b").first().cramers_v == pytest.approx(1.0)
    m = {(r.feature_a, r.feature_b): r.cramers_v for r in D.association_matrix(df, ["a", "b"]).collect()}
    assert m[("a", "b")] == m[("b", "a")] == pytest.approx(1.0) and m[("a", "a")] == 1.0


def test_cramers_v_degenerate_is_zero(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "a string, b int")
    assert D.cramers_v(df, "a", "b").first().cramers_v == 0.0
    empty = df.where("false")
    assert D.cramers_v(empty, "a", "b").first().cramers_v == 0.0


def _bias_corrected(x, y):
    t = pd.crosstab(pd.Series(x), pd.Series(y)).to_numpy().astype(float)
    n = t.sum()
    e = np.outer(t.sum(1), t.sum(0)) / n
    chi2 = ((t - e) ** 2 / e).sum()
    r, c = t.shape
    phi2 = max(0.0, chi2 / n - (c - 1) * (r - 1) / (n - 1))
    rc, cc = r - (r - 1) ** 2 / (n - 1), c - (c - 1) ** 2 / (n - 1)
    return float(np.sqrt(phi2 / min(rc - 1, cc - 1)))


def test_cramers_v_matches_the_chi_square_definition(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, 500)
    y = (x + rng.integers(0, 3, 500)) % 5
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    assert D.cramers_v(df, "x", "y").first().cramers_v == pytest.approx(_bias_corrected(x, y), abs=1e-9)


def test_spearman_matches_pandas_with_ties(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"a": rng.integers(0, 5, 300), "b": rng.integers(0, 3, 300),
                        "c": rng.normal(size=300)})
    pdf["b"] = pdf["b"] + pdf["a"]
    expected = pdf.corr(method="spearman")
    for columns in (["a", "b", "c"], ["a", "b"]):     # with a continuous column, and compacted
        got = D.spearman(spark.createDataFrame(pdf), columns)
        for r in got.collect():
            assert r.spearman == pytest.approx(expected.loc[r.column_a, r.column_b], abs=1e-9)


def test_class_summary_keeps_absent_classes(spark):
    df = spark.createDataFrame([("Slight",), ("Slight",), ("Serious",), (None,)], "severity string")
    got = {r.severity: (r["count"], r.percent) for r in D.class_summary(df).collect()}
    assert got["Fatal"] == (0, 0.0) and got["Slight"] == (2, 50.0)


def test_category_by_class_denominator_includes_null_levels(spark):
    df = spark.createDataFrame([("x", "Fatal"), ("x", "Slight"), (None, "Slight"), ("y", "Serious")],
                               "f string, severity string")
    rows = {r.level: r for r in D.category_by_class(df, ["f"]).collect()}
    assert set(rows) == {"x", "y"}
    assert rows["x"]["count"] == 2 and rows["x"].percent_of_cleaned_rows == 50.0
    assert rows["x"].fatal_share_percent == 50.0


def test_weekday_hour_pivot_is_dense(spark):
    df = spark.createDataFrame([("Monday", 3), ("Monday", 3), ("Sunday", 23)], "day_of_week string, hour int")
    rows = {r.day_of_week: r for r in D.weekday_hour_pivot(df).collect()}
    assert len(rows) == 7 and rows["Monday"].h3 == 2 and rows["Tuesday"].h0 == 0
    assert rows["Sunday"].h23 == 1


def test_numeric_summary_matches_pandas_describe(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, 3.0, 4.0, 10.0]})
    r = D.numeric_summary(spark.createDataFrame(pdf), ["a"]).first()
    d = pdf["a"].describe()
    assert (r.p25, r.p50, r.p75) == (d["25%"], d["50%"], d["75%"])
    assert r.std == pytest.approx(d["std"], abs=1e-9)


def test_numeric_summary_of_continuous_values_gaps_and_ties(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.normal(size=3001).round(6), "b": rng.integers(0, 3, 3001).astype(float)})
    pdf.loc[::7, "a"] = None
    pdf.loc[1000:2000, "b"] = 2.0   # a third of all rows is one value
    rows = [tuple(None if pd.isna(x) else float(x) for x in r) for r in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "a double, b double").withColumn("c", F.lit(None).cast("double")).repartition(7)
    got = {r["column"]: r for r in D.numeric_summary(df, ["a", "b", "c"]).collect()}
    for name in ("a", "b"):
        d, r = pdf[name].describe(), got[name]
        assert r["count"] == d["count"] and (r["min"], r["max"]) == (d["min"], d["max"])
        assert [r.p25, r.p50, r.p75] == pytest.approx([d["25%"], d["50%"], d["75%"]], abs=1e-12)
        assert (r["mean"], r["std"]) == pytest.approx((d["mean"], d["std"]), abs=1e-9)
    assert tuple(got["c"])[1:] == (0,) + (None,) * 7
    one = D.numeric_summary(spark.createDataFrame([(4.0,), (None,)], "a double"), ["a"]).first()
    assert tuple(one)[1:] == (1, 4.0, None, 4.0, 4.0, 4.0, 4.0, 4.0)
    empty = D.numeric_summary(spark.createDataFrame([], "a double"), ["a"]).first()
    assert tuple(empty)[1:] == (0,) + (None,) * 7


def test_histogram_edges_follow_numpy(spark):
    vals = [0.1, 0.35, 2.0, 7.7, 9.9]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert D.histogram_edges(df, "x", 20) == list(np.histogram_bin_edges(vals, bins=20))
    hist = D.within_class_hist(df.selectExpr("x", "0 AS label"), "x", classes=(0,), bins=20)
    counts = [r["count"] for r in hist.orderBy("bin").collect()]
    assert counts == list(np.histogram(vals, bins=np.histogram_bin_edges(vals, bins=20))[0])


def test_association_matrix_agrees_with_each_pair(spark):
    from stratakit.operators import describe as D

    rows = [(i % 3, (i * 7) % 5, None if i % 11 == 0 else (i * 13) % 4) for i in range(400)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    got = {(r.feature_a, r.feature_b): r.cramers_v for r in D.association_matrix(df, ["a", "b", "c"]).collect()}
    assert len(got) == 9
    for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
        assert got[a, b] == got[b, a] == D.cramers_v(df, a, b).first().cramers_v


def test_within_class_dist_shows_absent_classes_with_zero_share(spark):
    """Class 2 has no rows: it is still shown, with zero counts and share 0."""
    from stratakit.operators import describe as D

    df = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a"), (1, None)], "label int, f string")
    got = {(r["class"], r.level): (r["count"], r.proportion)
           for r in D.within_class_dist(df, "f").collect()}
    assert got == {(0, "a"): (1, 0.5), (0, "b"): (1, 0.5), (1, "a"): (1, 1.0), (1, "b"): (0, 0.0),
                   (2, "a"): (0, 0.0), (2, "b"): (0, 0.0)}
