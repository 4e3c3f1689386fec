"""Distribution overlap between classes and attribution summaries.

Overlaps: per-level (or per-bin) class counts in one aggregate, then the
pairwise ``sum(min(share_a, share_b))`` over a table bounded by the number of
levels / bins.  Attribution of a linear model: its summaries need no row of the design, they
follow from how often each column has each value (`level_counts`, one pass and one shuffle,
from which overlaps are taken, too).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..presets import CLASS_NAMES, CLASS_PAIRS, HOUR_SOURCE
from ..session import write_once
from .describe import bin_index, equal_edges, histogram_edges
from .sampling import running_totals

R9 = 9
MISSING = "<missing>"


def _pair_overlaps(per_level: DataFrame, classes=(0, 1, 2), names=CLASS_NAMES) -> DataFrame:
    """From per-(feature, level) class counts ``__c{k}`` -> 3 pair-overlap
    rows per feature.  Class totals come from a second aggregate, one row a
    feature, so a feature of many levels stays spread over tasks."""
    totals = per_level.groupBy(F.col("feature").alias("__f")).agg(*[F.sum(f"__c{k}").alias(f"__t{k}") for k in range(len(classes))])
    sh = per_level.join(F.broadcast(totals), F.col("feature") == F.col("__f")).select("feature", *[
        F.when(F.col(f"__t{k}") > 0, F.col(f"__c{k}") / F.col(f"__t{k}")).otherwise(F.lit(0.0)).alias(f"__s{k}")
        for k in range(len(classes))])
    agg = sh.groupBy("feature").agg(
        *[F.sum(F.least(F.col(f"__s{a}"), F.col(f"__s{b}"))).alias(f"__o{a}{b}")
          for a, b in CLASS_PAIRS])
    return agg.select(F.inline(F.array(*[
        F.struct(F.col("feature"), F.lit(names[a]).alias("class_a"),
                 F.lit(names[b]).alias("class_b"),
                 F.round(F.coalesce(F.col(f"__o{a}{b}"), F.lit(0.0)), R9).alias("overlap"))
        for a, b in CLASS_PAIRS])))


def overlaps_long(df: DataFrame, levels: dict[str, Column], label: str = "label",
                  classes=(0, 1, 2)) -> DataFrame:
    """Overlaps for many features in one pass: unpivot the per-feature level
    keys (a category, or a bin index) and aggregate once."""
    names = list(levels)
    c = F.col(label)
    long = df.select(c, *[levels[n].cast("string").alias(f"__f{i}") for i, n in enumerate(names)]) \
        .unpivot([label], [f"__f{i}" for i in range(len(names))], "__k", "level") \
        .where(F.col("level").isNotNull())
    key = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(f"__f{i}"), F.lit(n))])
    g = long.groupBy(F.element_at(key, F.col("__k")).alias("feature"), "level").agg(
        *[F.count_if(c == k).alias(f"__c{i}") for i, k in enumerate(classes)])
    return _pair_overlaps(g, classes)


# --- G1 ---------------------------------------------------------------------

def overlap_categorical(df: DataFrame, feature: str, label: str = "label",
                        classes=(0, 1, 2)) -> DataFrame:
    """Probability-mass intersection of level distributions per class pair;
    null is its own level ``<missing>``; a class without rows has zero mass."""
    lvl = F.coalesce(F.col(feature).cast("string"), F.lit(MISSING))
    return overlaps_long(df, {feature: lvl}, label, classes)


# --- G2 ---------------------------------------------------------------------

def overlap_numeric(df: DataFrame, feature: str, label: str = "label", classes=(0, 1, 2),
                    bins: int = 20) -> DataFrame:
    """Same intersection over ``bins`` common equal-width bins of the finite
    values (edges compared exactly, last bin closed; constant -> 1 bin)."""
    edges = histogram_edges(df, feature, bins)
    return overlaps_long(df, {feature: bin_index(feature, edges)}, label, classes)


# --- one pass over the rows ----------------------------------------------------

def level_counts(df: DataFrame, columns: dict[str, Column], label: str = "label", classes=(0, 1, 2)) -> DataFrame:
    """``source, v, x, n, __c0, __c1, ...`` for every column and every value it has: the value as a
    string (null kept) and, of numeric columns, as a number; rows, and rows of each class.

    Stored: level lists, kinds, bin ranges, attribution and overlaps are all read from it."""
    names = list(columns)
    types = df.select(*(c.alias(n) for n, c in columns.items())).schema
    c = F.col(label)
    cells = [F.struct(e.cast("string").alias("v"), (e if isinstance(types[n].dataType, T.NumericType) else F.lit(None)).cast("double").alias("x")).alias(f"__f{i}")
             for i, (n, e) in enumerate(columns.items())]
    long = df.select(c.alias("__label"), *cells).unpivot(["__label"], [f"__f{i}" for i in range(len(names))], "__k", "__cell")
    key = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(f"__f{i}"), F.lit(n))])
    counted = (long.groupBy("__k", F.col("__cell.v").alias("v"), F.col("__cell.x").alias("x"))
               .agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("__label") == k).alias(f"__c{i}") for i, k in enumerate(classes)]))
    return write_once(counted.select(F.element_at(key, F.col("__k")).alias("source"), "v", "x", "n", *[f"__c{i}" for i in range(len(classes))]), "levels")


# --- G3 ---------------------------------------------------------------------

def _numeric(df: DataFrame, names) -> set[str]:
    return {f.name for f in df.schema.fields if f.name in set(names) and isinstance(f.dataType, T.NumericType)}


def profiles(counts: DataFrame, numeric: set[str], features: list[str]) -> dict[str, dict]:
    """Per feature: distinct non-null levels and min/max of the finite values (one row a
    feature is collected); a feature that is null throughout has none."""
    finite = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != F.lit(math.inf))
    rows = counts.where(F.col("source").isin(*features)).groupBy("source").agg(
        F.count("v").alias("levels"), F.min(F.when(finite, F.col("x"))).alias("lo"), F.max(F.when(finite, F.col("x"))).alias("hi")).collect()
    out = {c: {"levels": 0, "lo": None, "hi": None, "numeric": c in numeric} for c in features}
    for r in rows:
        out[r["source"]].update(levels=r["levels"], lo=r["lo"], hi=r["hi"])
    return out


def _kind(p: dict, name: str, labelled, max_levels: int) -> str:
    if name in labelled or not p["numeric"] or p["levels"] <= max_levels:
        return "categorical"
    return "numeric"


def dist_kind(df: DataFrame, features: list[str], labelled: set[str] | frozenset = frozenset(),
              max_levels: int = 12) -> DataFrame:
    """categorical if the feature has a label map, is not numeric, or has
    <= ``max_levels`` distinct non-null values; numeric otherwise."""
    types = {f.name: f.dataType for f in df.schema.fields}
    long = df.select(*[F.col(c).cast("string").alias(c) for c in features]).unpivot(
        [], features, "feature", "v").where(F.col("v").isNotNull())
    d = (long.groupBy("feature", "v").agg(F.lit(1).alias("__one"))
         .groupBy("feature").agg(F.count(F.lit(1)).alias("levels")))
    every = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, features))).alias("feature"))
    d = every.join(d, "feature", "left").fillna(0, ["levels"])   # a feature that is null throughout, too
    numeric = [c for c in features if isinstance(types[c], T.NumericType)]
    is_num = F.col("feature").isin(*numeric) if numeric else F.lit(False)
    is_lab = F.col("feature").isin(*labelled) if labelled else F.lit(False)
    kind = F.when(is_lab | ~is_num | (F.col("levels") <= max_levels), "categorical") \
        .otherwise("numeric")
    return d.select("feature", F.col("levels").cast("bigint").alias("levels"), kind.alias("kind"))


def _edges(lo: float, hi: float, bins: int) -> list[float]:
    if lo == hi:
        return [lo - 0.5, hi + 0.5]
    step = (hi - lo) / bins
    e = [i * step + lo for i in range(bins + 1)]
    e[-1] = hi
    return e


def overlaps_by_kind(df: DataFrame, features: list[str], label: str = "label",
                     labelled: frozenset = frozenset(), bins: int = 20,
                     max_levels: int = 12) -> DataFrame:
    """G1 or G2 per feature according to G3, all features in one pass over the rows."""
    counts = level_counts(df, {f: F.col(f"`{f}`") for f in features}, label)
    return overlaps_of_counts(counts, features, _numeric(df, features), labelled, bins, max_levels)


def overlaps_of_counts(counts: DataFrame, features: list[str], numeric: set[str], labelled: frozenset = frozenset(),
                       bins: int = 20, max_levels: int = 12, classes=(0, 1, 2)) -> DataFrame:
    """`overlaps_by_kind` from `level_counts`: labelled, non-numeric and few-valued features by level,
    the others by bins of their values' counts."""
    prof = profiles(counts, numeric, features)
    kinds = {f: _kind(prof[f], f, labelled, max_levels) for f in features}
    level = F.coalesce(F.col("v"), F.lit(MISSING))
    for f in features:
        if kinds[f] == "numeric":
            at = bin_index(F.col("x"), equal_edges(prof[f]["lo"], prof[f]["hi"], bins))
            level = F.when(F.col("source") == f, at.cast("string")).otherwise(level)
    per_level = (counts.where(F.col("source").isin(*features)).select(F.col("source").alias("feature"), level.alias("level"), *[f"__c{i}" for i in range(len(classes))])
                 .where(F.col("level").isNotNull()).groupBy("feature", "level")
                 .agg(*[F.sum(f"__c{i}").alias(f"__c{i}") for i in range(len(classes))]))
    kind = F.create_map(*[x for f in features for x in (F.lit(f), F.lit(kinds[f]))])
    return _pair_overlaps(per_level, classes).withColumn("kind", F.element_at(kind, F.col("feature")))


# --- G4 (linear models) -----------------------------------------------------

def one_hot_long(df: DataFrame, row_id: str, categorical: list[str], numeric: list[str],
                 features: DataFrame) -> DataFrame:
    """Design matrix in long form ``(row_id, position, x)`` for a feature
    table ``(feature, source, level, position)`` (levels null for numerics).

    Every row gets every feature of every source (the dense design): an
    equi-join on ``source`` between the row's unpivoted values and the
    feature table - rows x features, the size of the attribution itself.
    """
    vals = df.select(row_id, *[F.col(c).cast("string").alias(c) for c in categorical],
                     *[F.col(c).cast("double").alias(f"__n_{c}") for c in numeric])
    cat = vals.select(row_id, *categorical).unpivot([row_id], categorical, "source", "v") \
        if categorical else None
    num = vals.select(row_id, *[f"__n_{c}" for c in numeric]).unpivot(
        [row_id], [f"__n_{c}" for c in numeric], "source", "x") if numeric else None
    feats = F.broadcast(features)
    parts = []
    if cat is not None:
        jc = cat.join(feats.where(F.col("level").isNotNull()), "source")
        parts.append(jc.select(row_id, "position",
                               (F.col("v") == F.col("level")).cast("double").alias("x")))
    if num is not None:
        num = num.withColumn("source", F.regexp_replace("source", "^__n_", ""))
        jn = num.join(feats.where(F.col("level").isNull()), "source")
        parts.append(jn.select(row_id, "position", F.col("x")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def linear_attribution(design: DataFrame, row_id: str, coef: list[list[float]],
                       means: DataFrame | None = None) -> DataFrame:
    """Exact attribution of a linear (margin) model with independent inputs:
    ``value = coef[class][j] * (x_j - mean_j)``, long form.

    ``coef`` is the small (classes x features) coefficient matrix (driver
    side, e.g. a fitted ``LogisticRegressionModel.coefficientMatrix``); the
    feature means come from ``means`` ``(position, mean)`` or from the design.
    """
    if means is None:
        means = design.groupBy("position").agg(F.avg("x").alias("mean"))
    arr = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in coef])
    j = design.join(F.broadcast(means), "position")
    per = j.select(row_id, "position", (F.col("x") - F.col("mean")).alias("__d"))
    ks = list(range(len(coef)))
    return per.select(row_id, "position", F.inline(F.array(*[
        F.struct(F.lit(k).alias("class"),
                 (F.element_at(F.element_at(arr, F.lit(k + 1)), F.col("position") + 1)
                  * F.col("__d")).alias("value")) for k in ks])))


def deviations(counts: DataFrame, features: DataFrame, nulls_as_zero: bool = False) -> DataFrame:
    """``position, n, mean, deviation, lo, hi`` of every design column from `level_counts`: rows, mean, mean
    absolute deviation from it, and the values' range.  A one-hot column that is 1 in n1 of n rows deviates
    by ``2 n1 (n - n1) / n**2``; a numeric one by the sum over its values.  Rows without a value
    have no design column, with ``nulls_as_zero`` (a fitted encoder's way) a 0 in every one-hot column."""
    known = F.col("v").isNotNull()
    totals = counts.groupBy("source").agg(F.sum("n").alias("__all"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("__known"),
                                          F.sum(F.when(known, F.col("x") * F.col("n"))).alias("__sum"))
    totals = F.broadcast(totals)   # one row a column
    n, ones = F.col("__all") if nulls_as_zero else F.col("__known"), F.coalesce(F.col("__n1"), F.lit(0))
    hot = (features.where(F.col("level").isNotNull()).join(totals, "source")
           .join(counts.where(known).select("source", F.col("v").alias("level"), F.col("n").alias("__n1")), ["source", "level"], "left")
           .select("position", n.alias("n"), (ones / n).alias("mean"), (2 * (ones / n) * ((n - ones) / n)).alias("deviation"),
                   F.when(ones == n, 1.0).otherwise(0.0).alias("lo"), F.when(ones > 0, 1.0).otherwise(0.0).alias("hi")))
    mean = F.col("__sum") / F.col("__known")
    plain = (counts.where(known).join(totals, "source").groupBy("source")
             .agg(F.first("__known").alias("n"), F.first(mean).alias("mean"),
                  (F.sum(F.abs(F.col("x") - mean) * F.col("n")) / F.first("__known")).alias("deviation"), F.min("x").alias("lo"), F.max("x").alias("hi")))
    plain = features.where(F.col("level").isNull()).join(plain, "source").select("position", "n", "mean", "deviation", "lo", "hi")
    return hot.unionByName(plain)


def linear_means(stats: DataFrame, coefficient: Callable[[Column, int], Column], classes: int = 3) -> DataFrame:
    """``position, class, m, largest, smallest, n``: mean absolute attribution ``coef * (x - mean)`` of a linear
    model and its range, from `deviations`."""
    rows = []
    for k in range(classes):
        c = coefficient(F.col("position"), k)
        ends = c * (F.col("lo") - F.col("mean")), c * (F.col("hi") - F.col("mean"))
        rows.append(F.struct(F.lit(k).alias("class"), (F.abs(c) * F.col("deviation")).alias("m"),
                             F.greatest(*ends).alias("largest"), F.least(*ends).alias("smallest")))
    return stats.select("position", "n", F.inline(F.array(*rows)))


def mean_abs(attr: DataFrame) -> DataFrame:
    """``position, class, m`` of a long attribution."""
    return attr.groupBy("position", "class").agg(F.avg(F.abs("value")).alias("m"))


# --- G5 ---------------------------------------------------------------------

def attribution_by_source(attr: DataFrame, features: DataFrame, cls: int = 0) -> DataFrame:
    """Mean |value| per transformed feature for one class, summed to its
    source column (``hour_sin``/``hour_cos`` -> ``Hour_of_Day``), with the
    components in vector order; ranked descending.  ``attr`` is long or already has means ``m``."""
    means = attr if "m" in attr.columns else mean_abs(attr)
    j = means.where(F.col("class") == cls).join(features, "position")
    src = F.when(F.col("source").isin("hour_sin", "hour_cos"), F.lit(HOUR_SOURCE)) \
        .otherwise(F.col("source"))
    g = j.groupBy(src.alias("source_feature")).agg(
        F.sum("m").alias("__v"),
        F.array_sort(F.collect_list(F.struct("position", "feature"))).alias("__c"))
    r = Window.orderBy(F.desc("__v"), "source_feature")
    return g.select(F.row_number().over(r).alias("rank"), "source_feature",
                    F.round("__v", R9).alias("mean_abs_shap"),
                    F.transform("__c", lambda s: s["feature"]).alias("components"))


# --- G6 ---------------------------------------------------------------------

def global_importance(attr: DataFrame, features: DataFrame, top: int = 15) -> DataFrame:
    """Mean |value| per (feature, class); features ranked by the mean over
    classes; the top ``top`` kept (a top-k report).  ``attr`` as in `attribution_by_source`."""
    g = attr if "m" in attr.columns else mean_abs(attr)
    wide = g.groupBy("position").agg(F.avg("m").alias("__o"),
                                     *[F.max(F.when(F.col("class") == k, F.col("m"))).alias(f"m{k}")
                                       for k in range(3)])
    best = wide.orderBy(F.desc("__o"), "position").limit(top)
    ranked = best.join(features.select("position", "feature"), "position") \
        .withColumn("rank", F.row_number().over(Window.orderBy(F.desc("__o"), "position")))
    return ranked.select("rank", "feature", F.inline(F.array(*[
        F.struct(F.lit(k).alias("class"), F.round(F.col(f"m{k}"), R9).alias("mean_abs_shap"))
        for k in range(3)])))


# --- G7 ---------------------------------------------------------------------

def top_feature_overlap(by_source: DataFrame, counts: DataFrame, numeric: set[str],
                        top: int = 5, labelled: frozenset = frozenset()) -> DataFrame:
    """Top ``top`` sources of G5, each with its kind and 3 pair overlaps from the
    `level_counts` of the data, which must have the sources (``Hour_of_Day`` too)."""
    ranks = {r["source_feature"]: r["rank"] for r in
             by_source.where(F.col("rank") <= top).select("source_feature", "rank").collect()}
    names = sorted(ranks, key=ranks.get)
    ov = overlaps_of_counts(counts, names, numeric, labelled)
    rank = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(int(ranks[n])))])
    return ov.withColumn("rank", F.element_at(rank, F.col("feature")).cast("int"))


# --- feature table (category discovery) -------------------------------------

def design_columns(counts: DataFrame, categorical: list[str], numeric: list[str]) -> DataFrame:
    """``feature, source, level, position`` in design-vector order: one-hot columns (levels by
    number where the column is numeric, else by value), then numerics; positions by distributed running
    totals, whatever the number of levels."""
    at = F.create_map(*[x for i, c in enumerate(categorical) for x in (F.lit(c), F.lit(i))]) if categorical else None
    parts = []
    if categorical:
        parts.append(counts.where(F.col("source").isin(*categorical) & F.col("v").isNotNull())
                     .select(F.element_at(at, F.col("source")).alias("o"), "x", "v", "source"))
    if numeric:
        rows = [F.struct(F.lit(len(categorical) + i).alias("o"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("string").alias("v"), F.lit(c).alias("source"))
                for i, c in enumerate(numeric)]
        parts.append(counts.sparkSession.range(1).select(F.inline(F.array(*rows))))
    every = reduce(DataFrame.unionByName, parts)
    placed = running_totals(every.select(F.struct("o", "x", "v").alias("__at"), "source", F.lit(1).alias("one")), "__at", ["one"])
    return placed.select(F.concat_ws("_", "source", "__at.v").alias("feature"), "source", F.col("__at.v").alias("level"),
                         (F.col("cum_one") - 1).cast("int").alias("position"))


def fixed_coefficient(position: Column, k: int) -> Column:
    """`fixed_coefficients` as an expression."""
    return (((position * 37 + k * 11) % 17) - 8) / F.lit(10.0)


def fixed_coefficients(n_features: int, classes: int = 3) -> list[list[float]]:
    """Deterministic coefficient rule for the model-free attribution check:
    ``((37 j + 11 k) mod 17 - 8) / 10``."""
    return [[(((j * 37 + k * 11) % 17) - 8) / 10 for j in range(n_features)]
            for k in range(classes)]


# --- G4 for fitted pipelines --------------------------------------------------

def feature_table_from_model(model, categorical: list[str], numeric: list[str]) -> DataFrame:
    """Feature table of a fitted preprocessing pipeline (vector order)."""
    from pyspark.ml.feature import StringIndexerModel

    sim = next(s for s in model.stages if isinstance(s, StringIndexerModel))
    rows = []
    for c, labels in zip(categorical, sim.labelsArray):
        rows += [(f"{c}_{v}", c, v) for v in labels]
    rows += [(c, c, None) for c in numeric]
    data = [(f, s, lv, i) for i, (f, s, lv) in enumerate(rows)]
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().createDataFrame(data, "feature string, source string, level string, position int")


def permutation_importance(model, df: DataFrame, sources: list[str], row_id: str,
                           label: str = "label", groups: dict[str, list[str]] | None = None,
                           seed: int = 42) -> DataFrame:
    """Macro-F1 drop per source column when its values are replaced by a
    deterministic derangement (row of rank r takes the values of rank r+1,
    ranks from the md5 order key - partition independent).

    One shuffle join to pair each row with its partner, stored, then all variants
    (base + one per source / group) are scored by a single ``transform``
    and evaluated by one grouped metrics job."""
    from ..functions.expressions import argmax3
    from .evaluate import class_metrics
    from .learn import PROB_COLS, with_probs
    from .sampling import exact_rank

    groups = dict(groups or {})
    variants = {s: [s] for s in sources}
    variants.update(groups)
    cols = sorted({c for cs in variants.values() for c in cs})
    ranked = write_once(exact_rank(df, row_id, None, seed, "__r"), "ranked")
    n = ranked.count()
    partner = ranked.select(F.pmod(F.col("__r"), F.lit(n)).alias("__pr"),
                            *[F.col(c).alias(f"__p_{c}") for c in cols])
    paired = write_once(ranked.join(partner, F.col("__r") - 1 == F.col("__pr")).drop("__r", "__pr"), "paired")
    base_cols = [c for c in paired.columns if not c.startswith("__p_")]
    parts = [paired.select(F.lit("<none>").alias("__variant"), *base_cols)]
    for name, cs in variants.items():
        parts.append(paired.select(F.lit(name).alias("__variant"), *[
            (F.col(f"__p_{c}").alias(c) if c in cs else F.col(c)) for c in base_cols]))
    allv = parts[0]
    for p in parts[1:]:
        allv = allv.unionByName(p)
    scored = with_probs(model.transform(allv)).withColumn("__pred", argmax3(*PROB_COLS))
    m = class_metrics(scored, label, "__pred", ["__variant"]).select("__variant", "macro_f1")
    # one row per variant: the baseline is read off the same small table
    whole = Window.partitionBy()
    base = F.max(F.when(F.col("__variant") == "<none>", F.col("macro_f1"))).over(whole)
    out = m.select("*", base.alias("__base")).where(F.col("__variant") != "<none>")
    r = Window.orderBy(F.desc("drop"), "feature")
    return out.select(F.col("__variant").alias("feature"), F.round("macro_f1", R9).alias("macro_f1"),
                      F.round(F.col("__base") - F.col("macro_f1"), R9).alias("drop")) \
        .withColumn("rank", F.row_number().over(r))
