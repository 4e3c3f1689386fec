"""Exact, partition-independent sampling (R, D1-D9)."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stratakit.operators import sampling as S


def _frame(spark, n=3000, parts=None):
    df = spark.range(n).select(F.col("id").alias("row_id"),
                               F.when(F.col("id") % 50 == 0, 0).when(F.col("id") % 7 == 0, 1)
                               .otherwise(2).cast("int").alias("label"))
    return df.repartition(parts) if parts else df


def test_exact_rank_equals_the_plain_window(spark):
    df = _frame(spark, 10_000)
    got = S.exact_rank(df, "row_id", "label", digits=1)   # 16 buckets: big windows
    w = Window.partitionBy("label").orderBy(S.order_key("row_id"), "row_id")
    ref = df.withColumn("ref", F.row_number().over(w))
    j = got.join(ref, ["row_id", "label"])
    assert j.where(F.col("rank") != F.col("ref")).count() == 0 and j.count() == 10_000


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_split_is_partition_independent_and_exact(spark, parts):
    base = S.stratified_split(_frame(spark), "label", "row_id").where("is_test") \
        .select("row_id").collect()
    other = S.stratified_split(_frame(spark, parts=parts), "label", "row_id", ) \
        .where("is_test").select("row_id").collect()
    assert sorted(base) == sorted(other)
    counts = {r.label: r["count"] for r in _frame(spark).groupBy("label").count().collect()}
    quotas = S.split_quotas(counts, 0.2)
    planned = {r.label: r["__q"] for r in S.split_quota_table(
        spark.createDataFrame(list(counts.items()), "label int, n_c long"), "label").collect()}
    assert planned == quotas
    assert sum(quotas.values()) == math.ceil(0.2 * 3000)
    tagged = S.stratified_split(_frame(spark, parts=parts), "label", "row_id", digits=1)
    got = {r.label: r["count"] for r in tagged.where("is_test").groupBy("label").count().collect()}
    assert got == quotas


def test_split_quotas_reproduce_the_published_counts():
    counts = {1: 19_039, 2: 198_894, 3: 1_251_912}
    q = S.split_quotas(counts, 0.2)
    assert q == {1: 3_808, 2: 39_779, 3: 250_382}
    assert sum(counts.values()) - sum(q.values()) == 1_175_876


def test_kfold_sizes_differ_by_at_most_one(spark):
    folds = S.stratified_kfold(_frame(spark), "label", "row_id", k=5, digits=2)
    per = folds.groupBy("label", "fold").count().collect()
    for lab in (0, 1, 2):
        sizes = [r["count"] for r in per if r.label == lab]
        assert max(sizes) - min(sizes) <= 1
    tot = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert max(tot) - min(tot) <= 1 and sum(tot) == 3000


def test_caps_keep_rare_rows_and_cap_others(spark):
    out = S.undersample_caps(_frame(spark), "label", "row_id", {1: 100, 2: 100})
    got = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert got == {0: 60, 1: 100, 2: 100}


def test_interpolated_weights(spark):
    df = spark.createDataFrame([(i, y) for i, y in enumerate([0, 1, 1, 2, 2, 2])], "row_id int, label int")
    w0 = [r.weight for r in S.interp_weights(df, "label", 0.0).orderBy("row_id").collect()]
    w1 = [r.weight for r in S.interp_weights(df, "label", 1.0).orderBy("row_id").collect()]
    wh = [r.weight for r in S.interp_weights(df, "label", 0.5).orderBy("row_id").collect()]
    assert w0 == [1.0] * 6
    assert w1 == pytest.approx([2.0, 1.0, 1.0, 2 / 3, 2 / 3, 2 / 3])
    assert wh == pytest.approx([(a + b) / 2 for a, b in zip(w0, w1)])
    for bad in (-0.1, 1.1, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            S.interp_weights(df, "label", bad)


def test_fixed_sample_size_and_membership(spark):
    df = _frame(spark)
    a = S.fixed_sample(df, "row_id", 200)
    b = S.fixed_sample(df.repartition(7), "row_id", 200)
    assert a.count() == 200 and sorted(a.collect()) == sorted(b.collect())
    assert S.fixed_sample(df, "row_id", 10_000).count() == 3000


def test_oof_assembly_rejects_gaps_and_duplicates(spark):
    df = spark.createDataFrame([(1, 0.2, 0.3, 0.5), (2, 0.1, 0.1, 0.8)], "row_id int, p0 double, p1 double, p2 double")
    assert S.oof_assemble([df.limit(1), df.where("row_id = 2")], "row_id", ["p0", "p1", "p2"], 2).count() == 2
    with pytest.raises(RuntimeError):
        S.oof_assemble([df, df.where("row_id = 2")], "row_id", ["p0", "p1", "p2"], 2)
    nan = spark.createDataFrame([(1, float("nan"), 0.3, 0.5)], "row_id int, p0 double, p1 double, p2 double")
    with pytest.raises(RuntimeError):
        S.oof_assemble([nan], "row_id", ["p0", "p1", "p2"], 1)


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_folds_caps_and_ranks_are_partition_independent(spark, parts):
    def rows(df, cols):
        return sorted(tuple(r) for r in df.select(*cols).collect())

    base, other = _frame(spark), _frame(spark, parts=parts)
    assert rows(S.stratified_kfold(base, "label", "row_id", 5), ["row_id", "fold"]) == \
        rows(S.stratified_kfold(other, "label", "row_id", 5), ["row_id", "fold"])
    caps = {1: 100, 2: 100}
    assert rows(S.undersample_caps(base, "label", "row_id", caps), ["row_id"]) == \
        rows(S.undersample_caps(other, "label", "row_id", caps), ["row_id"])
    assert rows(S.exact_rank(base, "row_id", None), ["row_id", "rank"]) == \
        rows(S.exact_rank(other, "row_id", None), ["row_id", "rank"])


def test_repeated_or_null_row_id_fails_instead_of_ranking_arbitrarily(spark):
    """A repeated id ties the order key (undefined rank) and, when it holds
    many rows, would put them all in one task: the plan raises instead."""
    from stratakit.operators import sampling as S

    dup = spark.createDataFrame([(1, 0), (2, 0), (2, 0), (3, 1)], "rid long, label int")
    with pytest.raises(Exception, match="not unique"):
        S.exact_rank(dup, "rid", "label").collect()
    nul = spark.createDataFrame([(1, 0), (None, 0)], "rid long, label int")
    with pytest.raises(Exception, match="unique, non-null"):
        S.stratified_kfold(nul, "label", "rid", k=2).collect()


def test_a_dominant_repeated_id_fails(spark):
    from stratakit.operators import sampling as S

    rows = spark.range(300).select(F.when(F.col("id") < 100, F.lit(7)).otherwise(F.col("id"))
                                   .alias("rid"), F.lit(0).alias("label"))
    with pytest.raises(Exception, match="not unique"):
        S.stratified_kfold(rows, "label", "rid").collect()


def test_fixed_sample_is_the_smallest_keys(spark):
    from stratakit.operators import sampling as S

    df = spark.range(5000).select(F.col("id").alias("rid"), (F.col("id") % 7).alias("v")).repartition(5)
    want = df.orderBy(S.order_key("rid"), "rid").limit(300)
    got = sorted(tuple(r) for r in S.fixed_sample(df, "rid", 300).collect())
    assert got == sorted(tuple(r) for r in want.collect()) and len(got) == 300


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_running_totals_in_one_range_and_in_many(spark, coalesce):
    from stratakit.operators import sampling as S

    key = "spark.sql.adaptive.coalescePartitions.enabled"
    rows = [(g, float(v), (v * 7) % 5) for g in "ab" for v in range(-20, 60 if g == "a" else 5)]
    df = spark.createDataFrame(rows, "g string, v double, n long").repartition(3)
    spark.conf.set(key, coalesce)
    try:
        for down in (False, True):
            got = S.running_totals(df, "v", ["n"], down, by=["g"], total_suffix="_all").collect()
            assert len(got) == len(rows)
            for r in got:
                same = [(v, n) for g, v, n in rows if g == r.g]
                assert r.cum_n == sum(n for v, n in same if (v >= r.v if down else v <= r.v))
                assert r.n_all == sum(n for _, n in same)
    finally:
        spark.conf.unset(key)
