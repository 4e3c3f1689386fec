"""Searches that survive their driver: a ledger of evaluated candidates, and what follows a winner.

The ledger is a stored table of fold metrics, keyed by the search's settings and the
candidate.  A candidate's rows are published in one step when its folds are through; a
restarted search evaluates only candidates that have none.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import scratch_path
from ..sources.store import StoredTable


#: What the ledger adds to a candidate's fold rows.
LEDGER_COLUMNS = ("key", "stage", "candidate", "order", "alpha", "settings")


def digest(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()[:20]


class SearchLedger:
    """Fold rows of the candidates of searches under ``path`` (by default a folder of this run, which
    resumes nothing).  ``data`` names the training rows (a fingerprint, a table version): rows of
    other data or settings are never taken for this search's."""

    def __init__(self, spark: SparkSession, path: str | None = None, data: str = "") -> None:
        self.spark, self.data = spark, data
        self.path = path or scratch_path(spark, "searches")
        self.table = StoredTable(spark, f"{self.path}/ledger")

    def key(self, stage: str, candidate: dict, settings: dict) -> str:
        return digest([self.data, stage, candidate, settings])

    def rows(self, keys: list[str]) -> DataFrame | None:
        """The rows of the candidates with these keys (as many as a search has candidates)."""
        table = self.table.read()
        return None if table is None else table.where(F.col("key").isin(keys))

    def done(self) -> set[str]:
        table = self.table.read()
        return set() if table is None else {r["key"] for r in table.select("key").distinct().collect()}

    def record(self, key: str, stage: str, candidate: dict, rows: DataFrame) -> None:
        """Publishes one candidate's fold rows (as many as folds)."""
        told = {"key": F.lit(key), "stage": F.lit(stage), "candidate": F.lit(candidate.get("candidate")).cast("int"),
                "order": F.lit(candidate.get("order")).cast("int"), "alpha": F.lit(candidate.get("alpha")).cast("double"),
                "settings": F.lit(json.dumps(candidate, sort_keys=True))}
        self.table.upsert(rows.select(*(c.alias(n) for n, c in told.items()), *rows.columns), "key")


@dataclass
class Finished:
    """What a search leaves: tables under ``path`` and the saved model."""

    winner: dict
    folds: DataFrame
    threshold: dict | None
    model_path: str
    path: str

    def model(self) -> PipelineModel:
        return PipelineModel.load(self.model_path)


def finish(frame: DataFrame, winner: dict, *, ledger: SearchLedger, slug: str, name: str, artifact: str,
           fresh_folds: int | None = 5, with_threshold: bool = False, searched: DataFrame | None = None, **cv) -> Finished:
    """After a search: ``fresh_folds``-fold validation of the winner (None: the winner's own rows
    ``searched`` are its folds), its rows in the table of results, with ``with_threshold`` a threshold
    from out-of-fold scores alone, a fit on all training rows, and the model's registry entry.

    The order makes a stop harmless: results are upserts by ``slug`` or artifact, the model is
    saved under a new name, and the entry that makes it ``ready`` comes last."""
    from .training import candidate_settings, cross_validate, refit, threshold_from_oof

    spark = frame.sparkSession
    settings = candidate_settings(winner["entry"], cv)
    best, shared = None, {}
    if fresh_folds is None:
        folds = searched
    else:
        folds, oof = cross_validate(frame, k=fresh_folds, slug=slug, name=name, collect_oof=with_threshold, shared=shared, **settings)
        key = ledger.key("validation", winner["entry"], {"slug": slug, "k": fresh_folds})
        ledger.record(key, "validation", winner["entry"], folds)
        folds = ledger.rows([key])
        if with_threshold:
            best, sweep = threshold_from_oof(oof)
            StoredTable(spark, f"{ledger.path}/threshold_results").publish(sweep)
    StoredTable(spark, f"{ledger.path}/cv_results").upsert(
        folds.drop("key", "stage", "settings").withColumn("slug", F.lit(slug)).withColumn("model", F.lit(name)), "slug")
    wanted = {k: settings[k] for k in ("categorical", "numeric", "forbidden", "row_id", "label", "kind", "params", "balance",
                                       "alpha", "caps", "pre_stages") if k in settings}
    model_path = f"{ledger.path}/models/{slug}-{uuid.uuid4().hex}"
    refit(frame, pooled=shared.get("pooled"), **wanted).write().save(model_path)
    entry = spark.createDataFrame(
        [(artifact, "ready" if best else "saved", best and float(best["threshold"]), model_path,
          "out-of-fold training scores" if best else None, json.dumps(winner, sort_keys=True, default=str))],
        "model_artifact string, status string, threshold double, model_path string, selection_data string, winner string")
    StoredTable(spark, f"{ledger.path}/registry").upsert(entry, "model_artifact")
    return Finished(winner, folds, best, model_path, ledger.path)


def registry(ledger: SearchLedger) -> DataFrame:
    """``model_artifact, status, threshold, ...`` as `operators.decide.threshold_match` reads it."""
    return StoredTable(ledger.spark, f"{ledger.path}/registry").read()
