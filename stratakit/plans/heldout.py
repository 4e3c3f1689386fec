"""Fitted models on the held-out rows: comparison (F14) and model-ranked error analysis.

All families share one preprocessing, fitted once on the training rows, which are pooled first: families that grow
from weighted sums share the encoded distinct rows, the others the encoded rows.  The held-out rows are scored by every model in one plan, each adding
a prediction to the row, and become long form last, so they are read once however many models there are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Model, Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import argmax3, hour_from_cyclical
from ..operators import explain as G
from ..operators.clean import validate_model_inputs
from ..operators.decide import ordinal_compose
from ..operators.learn import PROB_COLS, build_preprocessor, fit_binary_pair, make_classifier, pair_pools, pooled_rows, with_probs
from ..presets import HOUR_SOURCE
from ..session import write_once
from .training import prepare_training


@dataclass(frozen=True)
class Family:
    """One model of a comparison.  ``kind`` is a classifier kind or ``ordinal``, which balances its own targets."""

    name: str
    kind: str = "boosted"
    params: dict = field(default_factory=dict)
    balance: str = "none"
    alpha: float | None = None
    caps: dict | None = None


@dataclass
class HeldOut:
    """Models by name, in the order given, and the encoded held-out rows."""

    models: dict[str, Model | tuple[Model, Model]]
    test: DataFrame
    row_id: str

    @classmethod
    def fit(cls, train: DataFrame, test: DataFrame, families: list[Family], *, categorical: list[str], numeric: list[str],
            forbidden: list[str], row_id: str, label: str = "label") -> HeldOut:
        """Fits every family on ``train`` alone.  Categories that only ``test`` has become zeros."""
        names = [f.name for f in families]
        if len(set(names)) < len(names) or not names:
            raise ValueError(f"families need distinct names, at least one: {names}")
        validate_model_inputs([c for c in train.columns if c != label], forbidden, categorical + numeric)
        pooled, times = pooled_rows(train.withColumnRenamed(label, "label"), [*categorical, *numeric], ["label"])
        fitted = Pipeline(stages=build_preprocessor(categorical, numeric)).fit(pooled)

        def design(rows: DataFrame, name: str, *kept: str) -> DataFrame:
            return write_once(fitted.transform(rows).select(*kept, "features"), name)

        single, models = None, {}
        distinct = design(pooled, "heldout-pooled", "label", times)
        for f in families:
            if f.kind == "ordinal" and pair_pools(f.params):
                models[f.name] = fit_binary_pair(distinct, f.params, times)
                continue
            clf = make_classifier(f.kind, None, **f.params) if f.kind != "ordinal" else None
            if f.kind == "boosted" and clf.pools() and f.balance != "downsampled":
                rows, weight = prepare_training(distinct, "label", row_id, f.balance, f.alpha, f.caps, times)
                clf._set(weightCol=weight, pooled=True)
                models[f.name] = clf.fit(rows)
                continue
            if single is None:   # for those that sample or cap rows or count them
                single = design(train.withColumnRenamed(label, "label"), "heldout-train", row_id, "label")
            if f.kind == "ordinal":
                models[f.name] = fit_binary_pair(single, f.params)
                continue
            rows, weight = prepare_training(single, "label", row_id, f.balance, f.alpha, f.caps)
            models[f.name] = make_classifier(f.kind, weight, **f.params).fit(rows)
        return cls(models, design(test.withColumnRenamed(label, "label"), "heldout-test", row_id, "label"), row_id)

    def scores(self) -> DataFrame:
        """``row_id, y, model, p0, p1, p2``: every held-out row once for every model."""
        out, told = self.test, []
        for i, (name, model) in enumerate(self.models.items()):
            kept = [F.col(c) for c in out.columns]
            scored = _pair_scores(model, out) if isinstance(model, tuple) else with_probs(model.transform(out))
            out = scored.select(*kept, F.struct(F.lit(name).alias("model"), *PROB_COLS).alias(f"__m{i}"))
            told.append(F.col(f"__m{i}"))
        return out.select(self.row_id, F.col("label").alias("y"), F.inline(F.array(*told)))

    def predictions(self) -> DataFrame:
        """`scores` with ``pred``, the most likely class."""
        return self.scores().withColumn("pred", argmax3(*PROB_COLS))


def _pair_scores(pair: tuple[Model, Model], rows: DataFrame) -> DataFrame:
    out = rows
    for model, name in zip(pair, ("s_worse", "s_rare"), strict=True):
        out = model.transform(out).select(*out.columns, vector_to_array("probability")[1].alias(name))
    return ordinal_compose(out)


def fitted_attribution(model, counts: DataFrame, categorical: list[str], numeric: list[str]) -> DataFrame:
    """G5 of a fitted logistic pipeline over the rows that ``counts`` (`explain.level_counts`) describes."""
    coefficients = model.stages[-1].coefficientMatrix.toArray().tolist()
    feats = G.feature_table_from_model(model, categorical, numeric)
    array = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in coefficients])

    def coefficient(position: Column, k: int) -> Column:
        return F.element_at(F.element_at(array, k + 1), position + 1)

    return G.attribution_by_source(G.linear_means(G.deviations(counts, feats, nulls_as_zero=True), coefficient), feats)


def model_error_analysis(model, rows: DataFrame, categorical: list[str], numeric: list[str], top: int = 5,
                         labelled: frozenset = frozenset(), label: str = "label") -> DataFrame:
    """The ``top`` sources of a fitted logistic pipeline on ``rows``, with rank, mean absolute attribution, kind
    and pair overlaps.  Attribution and overlaps come from the same counts: one pass over the rows."""
    sources = {c: F.col(c) for c in categorical + numeric}
    if {"hour_sin", "hour_cos"} <= sources.keys():
        sources[HOUR_SOURCE] = hour_from_cyclical("hour_sin", "hour_cos").cast("double")
    counts = G.level_counts(rows, sources, label)
    ranked = write_once(fitted_attribution(model, counts, categorical, numeric), "ranking")   # read twice
    typed = {f.name for f in rows.schema.fields if isinstance(f.dataType, T.NumericType)}
    overlaps = G.top_feature_overlap(ranked, counts, typed | {HOUR_SOURCE}, top, labelled)
    told = ranked.select(F.col("source_feature").alias("feature"), "mean_abs_shap")
    return overlaps.join(F.broadcast(told), "feature")   # one row a source column
