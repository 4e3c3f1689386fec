"""Models on Spark ML: preprocessing, boosted one-vs-rest, ordinal pair.

* ``build_preprocessor`` (E1): ``StringIndexer(handleInvalid='keep',
  alphabetAsc)`` + ``OneHotEncoder(dropLast=True)`` + ``VectorAssembler``.
  Unseen and null categories become the all-zero block (the dropped slot is
  the "unknown" index), known ones keep their full one-hot width.
* ``BoostedOvR`` (E3): Spark's GBT is binary, so one GBT per class and
  ``p_c = q_c / sum(q)``; emits ``probability``, ``p0..p2`` and ``prediction``.
  It is a regular pipeline stage with its own persistence (A7).
* ``fit_forest``: a random forest over pooled rows; each row draws its own bootstrap count for
  every tree from its id (`pooled_draws`), so the forest doesn't depend on partitions.  Where the
  inputs have few values, `forests.grow` grows the same trees together (``fit_coded_forest``).
* ``fit_ordinal_pair`` (E9): two balanced binary GBTs on the cumulative
  targets, composed by ``decide.ordinal_compose``.

Fitting is the distributed part (Spark ML trains on the executors); the
driver only holds model parameters.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasSeed, HasWeightCol, Param, \
    Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, \
    MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import argmax3
from ..session import fits_at_once, write_once
from .clean import validate_model_inputs
from .forests import MOST_VALUES, Coded, Forest, Packing, code_rows, grow, growable, tree_models

PROB_COLS = ("p0", "p1", "p2")


# --- E1 ---------------------------------------------------------------------

def build_preprocessor(categorical: list[str], numeric: list[str],
                       features_col: str = "features") -> list:
    """Unfitted stages; fitted per training fold so category discovery is
    fold-local."""
    idx = [f"__idx_{c}" for c in categorical]
    ohe = [f"__ohe_{c}" for c in categorical]
    return [
        StringIndexer(inputCols=categorical, outputCols=idx, handleInvalid="keep",
                      stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True, handleInvalid="error"),
        VectorAssembler(inputCols=ohe + numeric, outputCol=features_col, handleInvalid="keep"),
    ]


def feature_names(model: PipelineModel, categorical: list[str], numeric: list[str]) -> list[str]:
    """``Column_value`` names in vector order, from the fitted indexer."""
    from pyspark.ml.feature import StringIndexerModel

    sim = next(s for s in model.stages if isinstance(s, StringIndexerModel))
    names = []
    for c, labels in zip(categorical, sim.labelsArray):
        names += [f"{c}_{v}" for v in labels]
    return names + list(numeric)


# --- E3 ---------------------------------------------------------------------

def pooled_rows(design: DataFrame, features: str | list[str], keys: list[str], weight: str | None = None) -> tuple[DataFrame, str]:
    """One stored row for every distinct (``keys``, ``features``) and the name of its weight, the sum over its
    rows (their number without ``weight``).  ``features`` is an encoded column or, cheaper, the columns to encode.  Trees that take no sample of the rows and ask for no number of rows
    a node grow from weighted sums alone, which stay the same; the trainer caches the pooled rows instead of all."""
    total = F.sum(F.col(weight).cast("double")) if weight else F.count(F.lit(1)).cast("double")
    return write_once(design.groupBy(*keys, *([features] if isinstance(features, str) else features)).agg(total.alias("__pooled")), "pooled"), "__pooled"


class _OvRParams(HasFeaturesCol, HasLabelCol, HasWeightCol, HasSeed):
    numClasses = Param(Params._dummy(), "numClasses", "number of classes",
                       typeConverter=TypeConverters.toInt)
    maxIter = Param(Params._dummy(), "maxIter", "boosting rounds", typeConverter=TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "tree depth", typeConverter=TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "learning rate", typeConverter=TypeConverters.toFloat)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "row subsample",
                            typeConverter=TypeConverters.toFloat)
    featureSubsetStrategy = Param(Params._dummy(), "featureSubsetStrategy", "column subsample",
                                  typeConverter=TypeConverters.toString)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "min rows per node",
                                typeConverter=TypeConverters.toInt)
    minInfoGain = Param(Params._dummy(), "minInfoGain", "min gain", typeConverter=TypeConverters.toFloat)
    maxBins = Param(Params._dummy(), "maxBins", "histogram bins", typeConverter=TypeConverters.toInt)
    parallelism = Param(Params._dummy(), "parallelism", "per-class fits run at once",
                        typeConverter=TypeConverters.toInt)
    pooled = Param(Params._dummy(), "pooled", "the rows are pooled already, the weight says how many each stands for",
                   typeConverter=TypeConverters.toBoolean)

    def _ovr_defaults(self):
        self._setDefault(featuresCol="features", labelCol="label", numClasses=3, maxIter=20,
                         maxDepth=5, stepSize=0.1, subsamplingRate=1.0,
                         featureSubsetStrategy="all", minInstancesPerNode=1, minInfoGain=0.0,
                         maxBins=32, seed=42, parallelism=1, pooled=False)


class BoostedOvR(Estimator, _OvRParams, MLReadable, MLWritable):
    """Multiclass boosted trees as one binary GBT per class."""

    @keyword_only
    def __init__(self, **kwargs):
        super().__init__()
        self._ovr_defaults()
        self._set(**self._input_kwargs)

    def _gbt(self, label: str) -> GBTClassifier:
        g = GBTClassifier(featuresCol=self.getFeaturesCol(), labelCol=label,
                          maxIter=self.getOrDefault("maxIter"), maxDepth=self.getOrDefault("maxDepth"),
                          stepSize=self.getOrDefault("stepSize"),
                          subsamplingRate=self.getOrDefault("subsamplingRate"),
                          featureSubsetStrategy=self.getOrDefault("featureSubsetStrategy"),
                          minInstancesPerNode=self.getOrDefault("minInstancesPerNode"),
                          minInfoGain=self.getOrDefault("minInfoGain"),
                          maxBins=self.getOrDefault("maxBins"), seed=self.getOrDefault("seed"))
        return g

    def pools(self) -> bool:
        """Whether the trees grow from weighted sums alone (`pooled_rows`)."""
        return self.getOrDefault("subsamplingRate") == 1.0 and self.getOrDefault("minInstancesPerNode") == 1

    def _fit(self, dataset: DataFrame) -> "BoostedOvRModel":
        label = self.getLabelCol()
        weight = self.getWeightCol() if self.isSet("weightCol") and self.getWeightCol() else None
        if self.pools() and not self.getOrDefault("pooled"):
            base, weight = pooled_rows(dataset, self.getFeaturesCol(), [label], weight)
        else:
            base = write_once(dataset.select(self.getFeaturesCol(), label, *([weight] if weight else [])), "boosted")

        def fit_one(c: int) -> GBTClassificationModel:
            lab = f"__y{c}"
            gbt = self._gbt(lab)
            if weight:
                gbt.setWeightCol(weight)
            return gbt.fit(base.withColumn(lab, (F.col(label) == c).cast("double")))

        classes = range(self.getOrDefault("numClasses"))
        par = self.getOrDefault("parallelism")
        par = fits_at_once(dataset.sparkSession, par, base.count()) if par > 1 else 1
        if par > 1:   # like OneVsRest.parallelism: concurrent jobs from driver threads
            with ThreadPoolExecutor(max_workers=par) as pool:
                models = list(pool.map(fit_one, classes))
        else:
            models = [fit_one(c) for c in classes]
        m = BoostedOvRModel(models)
        m._set(featuresCol=self.getFeaturesCol(), numClasses=self.getOrDefault("numClasses"))
        return m

    def write(self):
        return DefaultParamsWriter(self)

    @classmethod
    def read(cls):
        return DefaultParamsReader(cls)


class BoostedOvRModel(Model, _OvRParams, MLReadable, MLWritable):
    def __init__(self, models: list[GBTClassificationModel] | None = None):
        super().__init__()
        self._ovr_defaults()
        self.models = models or []

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset
        qs = []
        for c, m in enumerate(self.models):
            m = m.copy().setProbabilityCol(f"__prob{c}").setRawPredictionCol(f"__raw{c}") \
                .setPredictionCol(f"__pred{c}")
            out = m.transform(out)
            out = out.withColumn(f"__q{c}", vector_to_array(F.col(f"__prob{c}"))[1]) \
                .drop(f"__prob{c}", f"__raw{c}", f"__pred{c}")
            qs.append(F.col(f"__q{c}"))
        tot = sum(qs[1:], qs[0])
        for c in range(len(qs)):
            out = out.withColumn(PROB_COLS[c], qs[c] / tot)
        out = out.withColumn("probability", array_to_vector(F.array(*[F.col(p) for p in PROB_COLS])))
        out = out.withColumn("prediction", argmax3(*PROB_COLS).cast("double"))
        return out.drop(*[f"__q{c}" for c in range(len(qs))])

    def write(self):
        return _OvRWriter(self)

    @classmethod
    def read(cls):
        return _OvRReader(cls)


class _OvRWriter(MLWriter):
    def __init__(self, instance: BoostedOvRModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sc,
                                         extraMetadata={"n_models": len(self.instance.models)})
        for c, m in enumerate(self.instance.models):
            m.write().overwrite().save(f"{path}/class_{c}")


class _OvRReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> BoostedOvRModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sc)
        n = int(meta.get("n_models", meta.get("extraMetadata", {}).get("n_models", 3))) \
            if isinstance(meta, dict) else 3
        models = [GBTClassificationModel.load(f"{path}/class_{c}") for c in range(n)]
        m = BoostedOvRModel(models)
        DefaultParamsReader.getAndSetParams(m, meta)
        return m


# --- forests ------------------------------------------------------------------

#: Rows of the frame that a pooled row stands for, and how often a tree's bootstrap draws them.
TIMES, DRAWN = "__times", "__drawn"
FOREST_TREES = 20
TREES_AT_ONCE = 3


def _poisson_bounds() -> list[int]:
    """The shares of rows drawn at most 0, 1, 2 ... times, as bounds of a signed 64-bit digest."""
    out, share, n = [], 0.0, 0
    while (share := share + math.exp(-1) / math.factorial(n)) < 1 - 2 ** -52:
        out.append(int(share * 2 ** 64) - 2 ** 63)
        n += 1
    return out


def _drawer(kept: list[str], drawn: list[str], bounds: list[int]) -> Callable:
    """For ``mapInArrow``: Poisson numbers of mean 1 from digests, as a bootstrap of as many rows as there are draws a row."""
    def draw(batches):
        import numpy as np
        import pyarrow as pa

        shares = np.array(bounds, dtype=np.int64)
        for b in batches:
            numbers = [pa.array(np.searchsorted(shares, b.column(c).to_numpy(), side="right")) for c in drawn]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *numbers], names=[*kept, *drawn])
    return draw


def pack_columns(rows: DataFrame, columns: list[str], most: int = MOST_VALUES) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``rows`` with those of ``columns`` that have at most ``most`` values in one number, ``PACKED``, and what
    turns it back into them: a shuffle carries eight bytes in place of the values.  Other columns stay; if a number
    can't tell all combinations, so do the last ones.  The driver gets the values of the packed columns (`Packing`)."""
    packing = Packing.of(rows, columns, most)
    return packing.pack(rows), packing.unpack


def pooled_draws(rows: DataFrame, keys: list[str], inputs: list[str], row_id: str, trees: int, seed: int = 42) -> DataFrame:
    """One stored row for every distinct (``keys``, ``inputs``) with ``TIMES``, the number of its rows, and for
    every tree how often its bootstrap draws them.  Every row draws for itself, by a digest of its id and the
    tree, and draws of equal rows add up: the same law as a bootstrap of the rows, whatever their partitions."""
    drawn = [f"{DRAWN}{t}" for t in range(trees)]
    kept = list(dict.fromkeys([*keys, *inputs]))
    digests = [F.xxhash64(F.col(row_id), F.lit(seed), F.lit(t)).alias(c) for t, c in enumerate(drawn)]
    schema = T.StructType([*[T.StructField(c, rows.schema[c].dataType) for c in kept], *[T.StructField(c, T.LongType()) for c in drawn]])
    told = rows.select(*kept, *digests).mapInArrow(_drawer(kept, drawn, _poisson_bounds()), schema).groupBy(*kept).agg(
        F.count(F.lit(1)).cast("double").alias(TIMES), *[F.sum(c).alias(c) for c in drawn])
    return write_once(told, "pooled")


def forest_trees(params: dict | None) -> int:
    return int((params or {}).get("numTrees", FOREST_TREES))


def forest_pools(params: dict | None) -> bool:
    """Whether a forest's trees grow from weighted sums of a bootstrap alone (`pooled_draws`)."""
    p = params or {}
    return p.get("subsamplingRate", 1.0) == 1.0 and p.get("minInstancesPerNode", 1) == 1 and p.get("bootstrap", True)


def fit_forest(design: DataFrame, params: dict | None = None, weight: str | None = None, at_once: int = 1) -> ForestModel:
    """A forest over a stored design of `pooled_draws` (``label``, ``features``, draws): each tree is fitted to what its
    bootstrap draws, ``at_once`` trees at a time.  ``weight`` names the weight of a single row."""
    own = {"numTrees": FOREST_TREES, "featureSubsetStrategy": "auto", "seed": 42, **(params or {})}
    trees, subset, seed = forest_trees(own), own["featureSubsetStrategy"], own["seed"]
    subset = ("sqrt" if trees > 1 else "all") if subset == "auto" else subset   # Spark's rule for the whole forest
    own = {k: v for k, v in own.items() if k not in ("numTrees", "featureSubsetStrategy", "seed", "bootstrap")}
    classes = max(len(PROB_COLS), 1 + int(design.agg(F.max("label")).first()[0]))
    nominal = {"ml_attr": {"type": "nominal", "vals": [str(c) for c in range(classes)]}}   # a bootstrap may miss a class

    def grow(t: int) -> RandomForestClassificationModel:
        drawn = F.col(f"{DRAWN}{t}")
        rows = design.where(drawn > 0).select(F.col("label").cast("double").alias("label", metadata=nominal), "features",
                                              (drawn * F.col(weight) if weight else drawn.cast("double")).alias("__drawn"))
        return RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="__drawn", numTrees=1, bootstrap=False,
                                      featureSubsetStrategy=subset, seed=seed + t, **own).fit(rows)

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        m = ForestModel(list(pool.map(grow, range(trees))))
    m._set(numClasses=classes)
    return m


def fit_coded_forest(coded: Coded, params: dict | None = None, weights: dict[int, float] | None = None) -> ForestModel:
    """`fit_forest` of rows of `pooled_draws` that are not encoded, with the weight of a row of each class."""
    (trees,) = grow(coded, [coded_forest(params, {c: 1.0 for c in range(coded.classes)} | (weights or {}))], DRAWN)
    m = ForestModel(tree_models(coded.rows.sparkSession, coded, trees))
    m._set(numClasses=coded.classes)
    return m


def _weights_of_classes(pooled: DataFrame, weight: str | None) -> dict[int, float] | None:
    """The weight of a row of each class; None if it differs within a class."""
    if weight is None:
        return {}
    told = pooled.groupBy("label").agg(F.min(weight).alias("low"), F.max(weight).alias("top")).collect()
    return None if any(r["low"] is None or r["low"] != r["top"] for r in told) else {r["label"]: float(r["low"]) for r in told}


def coded_forest(params: dict | None, weights: dict[int, float], held_out: int | None = None) -> Forest:
    p = params or {}
    return Forest(held_out, weights, forest_trees(p), int(p.get("maxDepth", 5)), int(p.get("seed", 42)))


class ForestModel(Model, HasFeaturesCol, MLReadable, MLWritable):
    """Trees fitted one by one; the probability of a class is the mean of the trees'."""

    numClasses = Param(Params._dummy(), "numClasses", "number of classes", typeConverter=TypeConverters.toInt)

    def __init__(self, models: list[RandomForestClassificationModel] | None = None):
        super().__init__()
        self._setDefault(featuresCol="features", numClasses=3)
        self.models = models or []

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out, told = dataset, []
        for t, m in enumerate(self.models):
            m = m.copy().setFeaturesCol(self.getFeaturesCol()).setProbabilityCol(f"__prob{t}").setRawPredictionCol("").setPredictionCol("")
            out = m.transform(out).withColumn(f"__q{t}", vector_to_array(F.col(f"__prob{t}"))).drop(f"__prob{t}")
            told.append(F.col(f"__q{t}"))
        means = [sum((q[c] for q in told[1:]), told[0][c]) / len(told) for c in range(self.getOrDefault("numClasses"))]
        out = out.withColumn("__mean", F.array(*means))
        out = out.withColumn("probability", array_to_vector(F.col("__mean"))).withColumn(
            "prediction", (F.array_position("__mean", F.array_max("__mean")) - 1).cast("double"))
        return out.drop("__mean", *[f"__q{t}" for t in range(len(told))])

    def write(self):
        return _ForestWriter(self)

    @classmethod
    def read(cls):
        return _ForestReader(cls)


class _ForestWriter(MLWriter):
    def __init__(self, instance: ForestModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sc, extraMetadata={"trees": len(self.instance.models)})
        for t, m in enumerate(self.instance.models):
            m.write().overwrite().save(f"{path}/tree_{t}")


class _ForestReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> ForestModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sc)
        m = ForestModel([RandomForestClassificationModel.load(f"{path}/tree_{t}") for t in range(meta["trees"])])
        DefaultParamsReader.getAndSetParams(m, meta)
        return m


# --- model factory ------------------------------------------------------------

XGB_TO_SPARK = {"n_estimators": "maxIter", "learning_rate": "stepSize", "max_depth": "maxDepth",
                "subsample": "subsamplingRate", "min_child_weight": "minInstancesPerNode",
                "gamma": "minInfoGain"}
IGNORED = {"reg_alpha", "reg_lambda", "objective", "num_class", "tree_method", "eval_metric",
           "n_jobs", "random_state"}


def spark_params(params: dict) -> dict:
    """Map boosted-tree parameter names to Spark GBT names.

    ``colsample_bytree`` becomes a per-node feature fraction; L1/L2
    regularisation has no Spark equivalent and is ignored with a warning."""
    out = {}
    unused = [k for k in ("reg_alpha", "reg_lambda") if params.get(k)]
    if unused:
        warnings.warn(f"Spark's trees have no {', '.join(unused)}; ignored", stacklevel=2)
    for k, v in params.items():
        if k in XGB_TO_SPARK:
            name = XGB_TO_SPARK[k]
            out[name] = int(round(v)) if name in ("maxIter", "maxDepth", "minInstancesPerNode") else float(v)
        elif k == "colsample_bytree":
            out["featureSubsetStrategy"] = "all" if float(v) >= 1.0 else repr(round(float(v), 4))
        elif k in IGNORED:
            continue
        else:
            out[k] = v
    return out


def make_classifier(kind: str = "boosted", weight_col: str | None = None, **params):
    """``boosted`` (BoostedOvR), ``forest`` (RandomForest) or ``logistic``."""
    if kind == "boosted":
        est = BoostedOvR(**spark_params(params))
        if weight_col:
            est._set(weightCol=weight_col)
        return est
    if kind == "forest":
        rf = RandomForestClassifier(labelCol="label", featuresCol="features", seed=42,
                                    **{k: v for k, v in params.items()})
        if weight_col:
            rf.setWeightCol(weight_col)
        return rf
    if kind == "logistic":
        lr = LogisticRegression(labelCol="label", featuresCol="features", family="multinomial",
                                **params)
        if weight_col:
            lr.setWeightCol(weight_col)
        return lr
    raise ValueError(f"unknown classifier kind {kind!r}")


def make_pipeline(categorical: list[str], numeric: list[str], classifier, pre_stages: list = ()
                  ) -> Pipeline:
    return Pipeline(stages=[*pre_stages, *build_preprocessor(categorical, numeric), classifier])


def with_probs(scored: DataFrame, prob_col: str = "probability") -> DataFrame:
    """Add ``p0..p2`` from a probability vector (any Spark classifier)."""
    if all(p in scored.columns for p in PROB_COLS):
        return scored
    arr = vector_to_array(F.col(prob_col))
    return scored.select("*", *[arr[i].alias(p) for i, p in enumerate(PROB_COLS)])


def fit_multiclass(train: DataFrame, categorical: list[str], numeric: list[str],
                   forbidden: list[str], kind: str = "boosted", weight_col: str | None = None,
                   params: dict | None = None, pre_stages: list = (),
                   required: list[str] | None = None, row_id: str | None = None,
                   drawn: tuple[DataFrame, Packing] | None = None) -> PipelineModel:
    """Leakage guard, then fit preprocessing + classifier on ``train``.

    ``required`` names the raw inputs when ``pre_stages`` derive some model
    inputs (e.g. time features from date/time strings).  The encoded rows are stored: a fit goes over them
    several times and would repeat ``train``'s plan each time.  Boosted trees that pool rows get them pooled
    by the columns to encode, so ``train`` is read once and only distinct rows are encoded; so do forests if
    ``row_id`` names the rows, whose bootstrap is drawn by it, or if ``train`` has such rows already (``drawn``: they, packed, and their packing)."""
    validate_model_inputs([c for c in train.columns if c not in ("label", weight_col)],
                          forbidden, required if required is not None else categorical + numeric)
    clf = make_classifier(kind, weight_col, **(params or {}))
    if kind == "boosted" and clf.pools():
        before = Pipeline(stages=list(pre_stages)).fit(train)
        pooled, times = pooled_rows(before.transform(train), [*categorical, *numeric], ["label"], weight_col)
        encoder = Pipeline(stages=build_preprocessor(categorical, numeric)).fit(pooled)
        clf._set(weightCol=times, pooled=True)
        return PipelineModel([*before.stages, *encoder.stages, clf.fit(encoder.transform(pooled))])
    if kind == "forest" and (row_id is not None or drawn is not None) and forest_pools(params):
        before, kept = Pipeline(stages=list(pre_stages)).fit(train), ["label", *([weight_col] if weight_col else [])]
        pooled = train if drawn is not None else pooled_draws(before.transform(train), kept, [*categorical, *numeric], row_id, forest_trees(params))
        draws = [c for c in pooled.columns if c.startswith(DRAWN)]
        weights = _weights_of_classes(pooled, weight_col) if growable(params) else None
        coded = None if weights is None else code_rows(*(drawn or (pooled, None)), categorical, numeric, draws, TIMES)
        if coded is not None:
            encoder = Pipeline(stages=build_preprocessor(categorical, numeric)).fit(coded.categories())
            return PipelineModel([*before.stages, *encoder.stages, fit_coded_forest(coded, params, weights)])
        encoder = Pipeline(stages=build_preprocessor(categorical, numeric)).fit(pooled)
        design = write_once(encoder.transform(pooled).select(*kept, *draws, "features"), "design")
        at_once = fits_at_once(train.sparkSession, TREES_AT_ONCE, design.count())
        return PipelineModel([*before.stages, *encoder.stages, fit_forest(design, params, weight_col, at_once)])
    encoder = Pipeline(stages=[*pre_stages, *build_preprocessor(categorical, numeric)]).fit(train)
    design = encoder.transform(train).select("label", "features", *([weight_col] if weight_col else []))
    return PipelineModel([*encoder.stages, clf.fit(design if kind == "boosted" else write_once(design, "design"))])


# --- E9 ---------------------------------------------------------------------

def pair_pools(params: dict | None) -> bool:
    """`BoostedOvR.pools` for the parameters of `fit_binary_pair`."""
    p = spark_params(params or {})
    return p.get("subsamplingRate", 1.0) == 1.0 and p.get("minInstancesPerNode", 1) == 1


def fit_binary_pair(design: DataFrame, params: dict | None = None, times: str | None = None) -> tuple[Model, Model]:
    """Two balanced binary boosters on an encoded design (``label``, ``features``): P(y <= 1) and P(y = 0).
    ``times`` names the number of rows that each row of a stored, pooled design stands for."""
    from .sampling import balanced_weights

    p = spark_params(params or {})
    if times:
        rows = design
    elif pair_pools(params):
        rows, times = pooled_rows(design, "features", ["label"])
    else:
        rows = write_once(design.select("label", "features"), "pair")
    models = []
    for cond in (F.col("label").isin(0, 1), F.col("label") == 0):
        t = rows.withColumn("__t", cond.cast("int"))
        counts = {r["__t"]: int(r["n"]) for r in t.groupBy("__t").agg((F.sum(times) if times else F.count(F.lit(1))).alias("n")).collect()}
        t = balanced_weights(t, "__t", "__w", counts).withColumn("__t", F.col("__t").cast("double"))
        t = t.withColumn("__w", F.col("__w") * F.col(times)) if times else t
        gbt = GBTClassifier(labelCol="__t", featuresCol="features", weightCol="__w", seed=42)
        for k, v in p.items():
            if gbt.hasParam(k):
                gbt._set(**{k: v})
        models.append(gbt.fit(t))
    return models[0], models[1]


def fit_ordinal_pair(train: DataFrame, categorical: list[str], numeric: list[str],
                     params: dict | None = None, forbidden: list[str] = ()
                     ) -> tuple[PipelineModel, PipelineModel]:
    """Two balanced binary boosters: P(y <= 1) and P(y = 0)."""
    validate_model_inputs([c for c in train.columns if c != "label"], forbidden,
                          categorical + numeric)
    rows, times = pooled_rows(train, [*categorical, *numeric], ["label"]) if pair_pools(params) else (train, None)
    encoder = Pipeline(stages=build_preprocessor(categorical, numeric)).fit(rows)   # once for both targets
    design = encoder.transform(rows)
    if times:
        design = write_once(design.select("label", "features", times), "pair")
    serious, rare = fit_binary_pair(design, params, times)
    return PipelineModel([*encoder.stages, serious]), PipelineModel([*encoder.stages, rare])


def ordinal_scores(serious: PipelineModel, rare: PipelineModel, df: DataFrame,
                   keep: list[str]) -> DataFrame:
    """Both binary models over one frame, composed into (p0, p1, p2) beside the columns ``keep``: no join."""
    from .decide import ordinal_compose

    out = df
    for model, name in ((serious, "s_worse"), (rare, "s_rare")):
        scored = model.transform(out).withColumn(name, vector_to_array("probability")[1])
        out = scored.select(*out.columns, name)
    return ordinal_compose(out.select(*keep, "s_worse", "s_rare"))
