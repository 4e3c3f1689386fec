"""What follows a search reads the rows that its validation has pooled."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from stratakit.operators import learn
from stratakit.operators.learn import fit_multiclass, pooled_draws
from stratakit.plans import training
from stratakit.plans.ledger import SearchLedger, finish

CV = dict(categorical=["c", "d"], numeric=["x", "y"], forbidden=[], row_id="row_id")
FOREST = {"numTrees": 3, "maxDepth": 4}


def _rows(spark, n=900):
    h = F.pmod(F.xxhash64("id"), F.lit(100))
    return spark.range(n).select(F.col("id").alias("row_id"), F.when(h < 8, 0).when(h < 40, 1).otherwise(2).alias("label"),
                                 F.when(F.col("id") % 13 > 0, F.concat(F.lit("c"), F.col("id") % 4)).alias("c"), (F.col("id") % 12).cast("int").alias("d"),
                                 F.sin(F.col("id") % 50).alias("x"), (h % 7).cast("int").alias("y"))


def test_finish_fits_on_the_rows_that_validation_has_pooled(spark, monkeypatch):
    """Before, the fit on all training rows pooled the frame once more."""
    rows, pools = _rows(spark), []
    monkeypatch.setattr(learn, "pooled_draws", lambda *a, f=pooled_draws: pools.append("fit") or f(*a))
    monkeypatch.setattr(training, "pooled_draws", lambda *a, f=pooled_draws: pools.append("folds") or f(*a))
    cv = dict(kind="forest", params=FOREST, balance="weighted", **CV)
    end = finish(rows, {"entry": {"order": 0}}, ledger=SearchLedger(spark), slug="s", name="S", artifact="models/s", with_threshold=True, **cv)
    assert pools == ["folds"]
    train, wcol = training.prepare_training(rows, "label", "row_id", "weighted", None, None)
    want = fit_multiclass(train, ["c", "d"], ["x", "y"], [], "forest", wcol, FOREST, row_id="row_id")
    got, points = end.model(), rows.select("c", "d", "x", "y").distinct()
    assert isinstance(got, PipelineModel) and pools == ["folds", "fit"]
    a, b = ({(r.c, r.d, r.x, r.y): (r.p0, r.p1, r.p2) for r in learn.with_probs(m.transform(points)).collect()} for m in (got, want))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)
