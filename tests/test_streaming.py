"""The fitted scoring pipeline runs unchanged on a streaming source."""

from pyspark.sql import functions as F

from stratakit.operators.clean import TimeFeatures
from stratakit.operators.learn import fit_multiclass, with_probs
from stratakit.operators.sampling import train_test
from stratakit.plans import inputs as I
from stratakit.presets import SURROGATE as L
from stratakit.streaming.scoring import run_until, start_scoring

from conftest import SF0001

DERIVED = {"Season", "hour_sin", "hour_cos", "rush_hour"}


def test_stream_scores_equal_batch_scores(spark, tmp_path):
    ret = I.retained(spark, SF0001).withColumn("label", (F.col(L.severity) - 1).cast("int")) \
        .drop(L.severity)
    train, test = train_test(ret, "label", "row_index")
    required = [c for c in L.categorical_inputs + L.numeric_inputs if c not in DERIVED] + [L.date, L.time]
    model = fit_multiclass(train, L.categorical_inputs, L.numeric_inputs, list(L.forbidden), "forest",
                           None, {"numTrees": 3, "maxDepth": 3},
                           pre_stages=[TimeFeatures(dateCol=L.date, timeCol=L.time)], required=required)
    src = str(tmp_path / "incoming")
    test.drop("label").write.parquet(src)
    reg = spark.createDataFrame([("m", "ready", 0.05)], "model_artifact string, status string, threshold double")
    q = start_scoring(spark, src, spark.read.parquet(src).schema, model, reg, "m", "scored_out",
                      keep=["row_index"], fmt="memory", checkpoint=str(tmp_path / "ckpt"),
                      forbidden=list(L.forbidden), required=required)
    q.awaitTermination(120)
    out = spark.sql("SELECT * FROM scored_out")
    assert out.count() == test.count()
    batch = with_probs(model.transform(test)).select("row_index", "p0")
    j = out.join(batch.withColumnRenamed("p0", "b0"), "row_index")
    assert j.where(F.abs(F.col("p0") - F.col("b0")) > 0).count() == 0
    assert j.where("p0 >= 0.05 AND decision != 0").count() == 0


def test_stream_scoring_rejects_post_outcome_fields(spark, tmp_path):
    import pytest

    from stratakit.streaming.scoring import scored_stream

    src = str(tmp_path / "bad")
    spark.createDataFrame([(1, 3)], "row_index long, number_of_vehicles int").write.parquet(src)
    stream = spark.readStream.schema("row_index long, number_of_vehicles int").parquet(src)
    reg = spark.createDataFrame([("m", "ready", 0.05)], "model_artifact string, status string, threshold double")
    with pytest.raises(ValueError, match=r"leaks \['number_of_vehicles'\]"):
        scored_stream(stream, None, reg, "m", forbidden=list(L.forbidden), required=[])


def test_a_stopped_stream_goes_on_where_it_stopped(spark, tmp_path):
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import SQLTransformer

    rule = PipelineModel([SQLTransformer(statement="SELECT *, x / 100 AS p0, 0.5 * (1 - x / 100) AS p1, 0.5 * (1 - x / 100) AS p2 FROM __THIS__")])
    reg = spark.createDataFrame([("m", "ready", 0.25)], "model_artifact string, status string, threshold double")
    src, sink = str(tmp_path / "incoming"), str(tmp_path / "scored")
    rows = spark.range(100).select(F.col("id").alias("row_index"), F.col("id").cast("double").alias("x"))
    rows.where("row_index < 60").repartition(6).write.mode("append").parquet(src)
    told = dict(keep=["row_index"], checkpoint=str(tmp_path / "progress"))
    first = start_scoring(spark, src, rows.schema, rule, reg, "m", sink, available_now=False, files_per_batch=1, **told)
    assert run_until(first, 2, 120) >= 1 and not first.isActive
    rows.where("row_index >= 60").write.mode("append").parquet(src)
    second = start_scoring(spark, src, rows.schema, rule, reg, "m", sink, files_per_batch=2, **told)
    second.awaitTermination(120)
    out = {r.row_index: r for r in spark.read.parquet(sink).collect()}
    assert spark.read.parquet(sink).count() == 100 and sorted(out) == list(range(100))
    assert {i for i, r in out.items() if r.decision == 0} == set(range(25, 100))


def test_run_until_raises_what_stopped_the_stream(spark, tmp_path):
    import pytest
    from pyspark.errors import StreamingQueryException
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import SQLTransformer

    rule = PipelineModel([SQLTransformer(statement="SELECT *, CAST(raise_error('bad row') AS DOUBLE) AS p0, 0.0D AS p1, 0.0D AS p2 FROM __THIS__")])
    reg = spark.createDataFrame([("m", "ready", 0.25)], "model_artifact string, status string, threshold double")
    src = str(tmp_path / "incoming")
    spark.range(3).withColumnRenamed("id", "row_index").write.parquet(src)
    q = start_scoring(spark, src, spark.read.parquet(src).schema, rule, reg, "m", str(tmp_path / "out"), available_now=False,
                      checkpoint=str(tmp_path / "progress"))
    with pytest.raises(StreamingQueryException):
        run_until(q, 1, 120)
