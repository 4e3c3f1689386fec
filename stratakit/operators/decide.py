"""Decisions: ordinal composition, argmax, registered thresholds, scoring.

All row-level logic is column expressions; the threshold registry is a small
configuration table joined by model artifact (broadcast: its size is the
number of registered models).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import argmax3, ordinal_probabilities, threshold_decision


def cumulative_targets(df: DataFrame, y: str = "label") -> DataFrame:
    """``serious_or_worse`` = y in {0, 1}; ``rare`` = y == 0 (0/1 ints)."""
    return df.withColumn("serious_or_worse", F.col(y).isin(0, 1).cast("int")) \
             .withColumn("rare", (F.col(y) == 0).cast("int"))


def ordinal_compose(df: DataFrame, s: str = "s_worse", f: str = "s_rare",
                    out: tuple[str, str, str] = ("p0", "p1", "p2"), check: bool = False
                    ) -> DataFrame:
    """Class probabilities from P(y<=1) and P(y=0); crossings meet at
    the midpoint.  ``check`` verifies rows sum to one (one aggregate)."""
    p0, p1, p2 = ordinal_probabilities(s, f)
    res = df.withColumn(out[0], p0).withColumn(out[1], p1).withColumn(out[2], p2)
    if check:
        tot = F.col(out[0]) + F.col(out[1]) + F.col(out[2])
        if res.where(F.abs(tot - 1.0) > 1e-8).limit(1).count():
            raise RuntimeError("ordinal class probabilities must sum to one")
    return res


def argmax_predict(df: DataFrame, probs=("p0", "p1", "p2"), out: str = "pred") -> DataFrame:
    """Highest probability, lowest index on a tie."""
    return df.withColumn(out, argmax3(*probs))


REGISTRY_SALTS = 64


def threshold_match(models: DataFrame, registry: DataFrame, artifact: str = "model_artifact"
                    ) -> DataFrame:
    """Per model, the registered threshold if (and only if) the entry is
    ``ready``, belongs to that artifact and has a threshold; else null.

    Scored rows of one model all carry the same artifact, so a plain shuffle
    join on it would send every row to one task.  Each registry row is
    replicated over ``REGISTRY_SALTS`` salts and every scored row takes a salt
    from a hash of its own values, so one artifact spreads over that many tasks;
    a registry of few bytes is broadcast by its size all the same."""
    ok = (F.col("r.status") == "ready") & F.col("r.threshold").isNotNull()
    reg = registry.select(F.col(artifact).alias("__a"), "status", "threshold")
    salted = reg.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(REGISTRY_SALTS - 1)))) \
        .alias("r")
    # any salt is correct (every salt of an artifact is replicated): hash
    # the atomic columns only (vectors from a fitted pipeline, maps are not)
    atomic = [f.name for f in models.schema.fields if isinstance(f.dataType, T.AtomicType)]
    salt = F.xxhash64(*[F.col(f"`{c}`") for c in atomic]) if atomic else F.lit(0)
    m = models.withColumn("__s", F.pmod(salt, F.lit(REGISTRY_SALTS)).cast("int")).alias("m")
    j = m.join(salted, (F.col(f"m.{artifact}") == F.col("r.__a")) & (F.col("m.__s") == F.col("r.__s")),
               "left")
    return j.select(*[F.col(f"m.`{c}`") for c in models.columns],
                    F.when(ok, F.col("r.threshold")).alias("threshold"))


def decide(scored: DataFrame, probs=("p0", "p1", "p2"), threshold_col: str = "threshold",
           out: str = "decision") -> DataFrame:
    """E13 decision: threshold rule where a threshold is registered, else argmax."""
    p0, p1, p2 = probs
    return scored.withColumn(
        out, F.when(F.col(threshold_col).isNotNull(),
                    threshold_decision(p0, p1, p2, F.col(threshold_col)))
        .otherwise(argmax3(p0, p1, p2)))


def score_scenarios(model, scenarios: DataFrame, registry: DataFrame, artifact: str,
                    forbidden: list[str], required: list[str], keep: list[str] = ()
                    ) -> DataFrame:
    """Validate the prediction-time fields (schema only, no job), score
    with the fitted pipeline, and decide with the artifact's registered
    threshold (argmax when none is ready).  Works on batch and streaming
    frames alike."""
    from .clean import validate_model_inputs
    from .learn import PROB_COLS, with_probs

    validate_model_inputs(scenarios.columns, forbidden, required)
    scored = with_probs(model.transform(scenarios)).withColumn("model_artifact", F.lit(artifact))
    decided = decide(threshold_match(scored, registry))
    return decided.select(*keep, *PROB_COLS, "threshold", "decision")
