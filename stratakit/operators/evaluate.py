"""Evaluation: confusion, class metrics, threshold sweep, curves, cohorts.

Everything works on a long prediction frame ``(group..., y, pred)`` so one
job evaluates many models / folds / thresholds at once (the group key goes
into the aggregate).  The aggregate output is 9 counts per group; all metric
arithmetic happens on that tiny result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import threshold_decision
from ..presets import CLASS_NAMES, DEFAULT_THRESHOLD_GRID

LABELS = (0, 1, 2)
R9 = 9


def _cnt(cond: Column, count_col: str | None) -> Column:
    if count_col is None:
        return F.count_if(cond)
    return F.sum(F.when(cond, F.col(count_col)).otherwise(F.lit(0)))


def confusion_wide(df: DataFrame, y: str = "y", pred: str = "pred", group_cols: list[str] = (),
                   count_col: str | None = None, labels: tuple = LABELS) -> DataFrame:
    """One row per group with ``c{i}{j}`` = rows with true i predicted j."""
    aggs = [_cnt((F.col(y) == i) & (F.col(pred) == j), count_col).cast("bigint").alias(f"c{i}{j}")
            for i in labels for j in labels]
    g = df.groupBy(*group_cols) if group_cols else df.groupBy()
    return g.agg(*aggs)


# --- F1 ---------------------------------------------------------------------

def confusion(df: DataFrame, y: str = "y", pred: str = "pred", group_cols: list[str] = (),
              count_col: str | None = None, labels: tuple = LABELS) -> DataFrame:
    """Dense 3x3 confusion counts per group, rows = true label."""
    w = confusion_wide(df, y, pred, list(group_cols), count_col, labels)
    return w.select(*group_cols, F.inline(F.array(*[
        F.struct(F.lit(i).alias("true_label"), F.lit(j).alias("pred_label"),
                 F.col(f"c{i}{j}").alias("count")) for i in labels for j in labels])))


# --- F9 ---------------------------------------------------------------------

def confusion_normalized(conf: DataFrame, group_cols: list[str] = ()) -> DataFrame:
    """Row-normalised confusion (row / row total, 0 for an empty row)."""
    tot = F.sum("count").over(Window.partitionBy(*group_cols, "true_label"))
    return conf.select("*", tot.alias("__t")).select(
        *group_cols, "true_label", "pred_label", "count",
        F.when(F.col("__t") > 0, F.col("count") / F.col("__t")).otherwise(F.lit(0.0)).alias("share"))


# --- F2 ---------------------------------------------------------------------

def metrics_from_wide(w: DataFrame, group_cols: list[str] = (), labels: tuple = LABELS,
                      names: tuple = CLASS_NAMES) -> DataFrame:
    """Accuracy, macro-F1 and per-class precision/recall/F1 from 9 counts.

    Zero division gives 0.  Macro-F1 averages over the labels present in y
    *or* in the predictions (no fixed label list), per-class metrics use all
    three labels.
    """
    c = lambda i, j: F.col(f"c{i}{j}")
    n = sum((c(i, j) for i in labels for j in labels), F.lit(0))
    diag = sum((c(i, i) for i in labels), F.lit(0))
    cols = [F.col(g) for g in group_cols]
    cols += [n.cast("bigint").alias("n"),
             F.when(n > 0, diag / n).otherwise(F.lit(0.0)).alias("accuracy")]
    f1s, present = [], []
    for i, name in zip(labels, names):
        tp = c(i, i)
        support = sum((c(i, j) for j in labels), F.lit(0))
        predicted = sum((c(j, i) for j in labels), F.lit(0))
        p = F.when(predicted > 0, tp / predicted).otherwise(F.lit(0.0))
        r = F.when(support > 0, tp / support).otherwise(F.lit(0.0))
        f1 = F.when(2 * tp + (predicted - tp) + (support - tp) > 0,
                    2 * tp / (2 * tp + (predicted - tp) + (support - tp))).otherwise(F.lit(0.0))
        cols += [p.alias(f"{name.lower()}_precision"), r.alias(f"{name.lower()}_recall"),
                 f1.alias(f"{name.lower()}_f1")]
        f1s.append(f1)
        present.append(((support + predicted) > 0).cast("int"))
    k = sum(present, F.lit(0))
    total = F.lit(0.0)
    for f1, pr in zip(f1s, present):
        total = total + F.when(pr == 1, f1).otherwise(F.lit(0.0))
    cols.insert(len(group_cols) + 2, F.when(k > 0, total / k).otherwise(F.lit(0.0)).alias("macro_f1"))
    return w.select(*cols)


def class_metrics(df: DataFrame, y: str = "y", pred: str = "pred", group_cols: list[str] = (),
                  count_col: str | None = None) -> DataFrame:
    return metrics_from_wide(confusion_wide(df, y, pred, list(group_cols), count_col),
                             list(group_cols))


# --- F3 / F4 ----------------------------------------------------------------

def apply_threshold(df: DataFrame, threshold: float, probs: tuple[str, str, str] = ("p0", "p1", "p2"),
                    out: str = "pred") -> DataFrame:
    if len(probs) != 3:
        raise ValueError("probabilities must have shape (rows, 3)")
    return df.withColumn(out, threshold_decision(*probs, threshold))


def _threshold_row(m: DataFrame, thr: Column, group_cols: list[str]) -> DataFrame:
    pred0 = F.col("c00") + F.col("c10") + F.col("c20")
    n = F.col("n")
    return m.select(*group_cols, thr.alias("threshold"), "macro_f1",
                    F.col("fatal_precision"), F.col("fatal_recall"), F.col("fatal_f1"),
                    F.when(n > 0, pred0 / n).otherwise(F.lit(0.0)).alias("predicted_fatal_proportion"))


def threshold_metrics(df: DataFrame, threshold: float, y: str = "y",
                      probs: tuple[str, str, str] = ("p0", "p1", "p2")) -> DataFrame:
    """threshold, macro-F1, rare precision/recall/F1, share predicted rare."""
    w = confusion_wide(apply_threshold(df, threshold, probs, "__pred"), y, "__pred")
    return _threshold_row(metrics_from_wide_keep(w), F.lit(float(threshold)), [])


def metrics_from_wide_keep(w: DataFrame, group_cols: list[str] = ()) -> DataFrame:
    """``metrics_from_wide`` that also keeps the nine counts."""
    keep = [f"c{i}{j}" for i in LABELS for j in LABELS]
    return metrics_from_wide(w, list(group_cols) + keep)


# --- F5 / F6 ----------------------------------------------------------------

def threshold_grid(size: int = DEFAULT_THRESHOLD_GRID) -> list[float]:
    """``linspace(0, 1, size)`` with the same doubles (i * step, last = 1.0)."""
    step = 1.0 / (size - 1)
    grid = [i * step for i in range(size)]
    grid[-1] = 1.0
    return grid


def _threshold_col(i: Column, size: int) -> Column:
    step = 1.0 / (size - 1)
    return F.when(i == size - 1, F.lit(1.0)).otherwise(i.cast("double") * F.lit(step))


def threshold_sweep(df: DataFrame, y: str = "y", probs: tuple[str, str, str] = ("p0", "p1", "p2"),
                    size: int = DEFAULT_THRESHOLD_GRID, group_cols: list[str] = ()) -> DataFrame:
    """Threshold metrics at every grid point, in one pass over the rows.

    Per row only (y, alt, b) matter: ``alt`` = 1 if p1 >= p2 else 2, and
    ``b`` = number of grid thresholds <= p0 (the row is predicted rare for
    the first ``b`` thresholds).  ``b`` comes from ``floor(p0 * (size-1))``
    corrected against the exact grid doubles.  The grouped table has at most
    3 x 2 x (size+1) rows per group; the 201 confusion matrices are built
    from it by expanding that small table, never the rows.
    """
    p0, p1, p2 = (F.col(p) for p in probs)
    k = F.least(F.greatest(F.floor(p0 * (size - 1)).cast("int"), F.lit(0)), F.lit(size - 1))
    t = lambda e: _threshold_col(e, size)
    b = (F.when(p0.isNull() | F.isnan(p0) | (p0 < 0), F.lit(0))
         .otherwise(F.when(t(k) <= p0, k + 1).otherwise(k)))
    b = F.when((b <= size - 1) & (t(b) <= p0), b + 1).otherwise(b)
    compact = df.select(*group_cols, F.col(y).alias("__y"),
                        F.when(p1 >= p2, 1).otherwise(2).alias("__alt"), b.alias("__b")) \
        .groupBy(*group_cols, "__y", "__alt", "__b").agg(F.count(F.lit(1)).alias("__n"))
    per_t = compact.select(*group_cols, "__y", "__alt", "__b", "__n",
                           F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("__i"))
    per_t = per_t.withColumn("__pred", F.when(F.col("__b") > F.col("__i"), 0)
                             .otherwise(F.col("__alt")))
    gcols = list(group_cols) + ["__i"]
    w = confusion_wide(per_t, "__y", "__pred", gcols, "__n")
    m = metrics_from_wide_keep(w, gcols)
    return _threshold_row(m, _threshold_col(F.col("__i"), size), list(group_cols))


def select_threshold(sweep: DataFrame, group_cols: list[str] = ()) -> DataFrame:
    """Lexicographic max of (macro-F1, rare F1, threshold) per group."""
    key = F.struct("macro_f1", "fatal_f1", "threshold")
    rest = [c for c in sweep.columns if c not in group_cols]
    best = F.max_by(F.struct(*rest), key).alias("__best")
    g = sweep.groupBy(*group_cols) if group_cols else sweep.groupBy()
    return g.agg(best).select(*group_cols, "__best.*")


# --- F7 / F8 / F16 ----------------------------------------------------------

FOLD_METRICS = ("macro_f1", "accuracy",
                "fatal_precision", "fatal_recall", "fatal_f1",
                "serious_precision", "serious_recall", "serious_f1",
                "slight_precision", "slight_recall", "slight_f1")


def fold_rows(df: DataFrame, y: str = "y", pred: str = "pred", slug: str = "slug",
              fold: str = "fold", model: str = "model", count_col: str | None = None) -> DataFrame:
    """One flat row per (model, slug, fold): the 11 metrics + identifiers."""
    m = class_metrics(df, y, pred, [model, slug, fold], count_col)
    return m.select(model, slug, F.col(fold).cast("int").alias("fold"),
                    *[F.col(c) for c in FOLD_METRICS])


def fold_summary(rows: DataFrame, group_cols: list[str] = ("slug",)) -> DataFrame:
    """Mean and sample std of each fold metric, long form."""
    long = rows.select(*group_cols, *FOLD_METRICS).unpivot(
        list(group_cols), list(FOLD_METRICS), "metric", "value")
    return long.groupBy(*group_cols, "metric").agg(
        F.round(F.avg("value"), R9).alias("mean"), F.round(F.stddev_samp("value"), R9).alias("std"))


def candidate_summary(rows: DataFrame, candidate_cols: list[str]) -> DataFrame:
    """Flatten fold metrics per candidate (macro-F1 mean/std, class means)."""
    return rows.groupBy(*candidate_cols).agg(
        F.round(F.avg("macro_f1"), R9).alias("macro_f1_mean"),
        F.round(F.stddev_samp("macro_f1"), R9).alias("macro_f1_std"),
        F.round(F.avg("fatal_precision"), R9).alias("fatal_precision_mean"),
        F.round(F.avg("fatal_recall"), R9).alias("fatal_recall_mean"),
        F.round(F.avg("fatal_f1"), R9).alias("fatal_f1_mean"),
        F.round(F.avg("serious_f1"), R9).alias("serious_f1_mean"),
        F.round(F.avg("slight_f1"), R9).alias("slight_f1_mean"))


def select_candidate(summary: DataFrame, rule: str = "alpha", order_col: str | None = None
                     ) -> DataFrame:
    """Winner row: max mean macro-F1, then the tie rule.

    ``alpha``: lower ``alpha`` wins a tie; ``joint``: lower ``candidate``;
    ``first``: lowest ``order_col`` (sample order).
    """
    tie = {"alpha": "alpha", "joint": "candidate", "first": order_col}[rule]
    if tie is None or tie not in summary.columns:
        raise ValueError(f"rule {rule!r} needs column {tie!r}")
    key = F.struct(F.col("macro_f1_mean"), (-F.col(tie)).alias("__tie"))
    return summary.agg(F.max_by(F.struct(*summary.columns), key).alias("w")).select("w.*")


# --- F10 / F11 / F12 --------------------------------------------------------

def pr_curve(df: DataFrame, y: str, score: str, positive: int = 0) -> DataFrame:
    """Precision/recall of ``score`` for class ``positive`` at every distinct
    score (descending thresholds), plus the end point (precision 1, recall 0).

    Cumulative sums run over *distinct scores*, never rows (a score shared by
    many rows is one entry), with the ranged running totals of
    ``sampling.running_totals`` - no task holds more than one range.
    """
    from .sampling import running_totals

    s = F.col(score).cast("double")
    pos = F.col(y) == positive
    g = (df.where(s.isNotNull() & ~F.isnan(s))
           .groupBy(s.alias("threshold"))
           .agg(F.count_if(pos).alias("pos"), F.count_if(~pos).alias("neg")))
    j = running_totals(g, "threshold", ["pos", "neg"], descending=True, total_suffix="_total")
    tp, fp, total = F.col("cum_pos"), F.col("cum_neg"), F.col("pos_total")
    pts = j.select(
        "threshold", tp.cast("bigint").alias("tp"), fp.cast("bigint").alias("fp"),
        F.col("pos").cast("bigint").alias("pos"),
        F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0)).alias("precision"),
        F.when(total > 0, tp / total).otherwise(F.lit(1.0)).alias("recall"))
    end = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0).cast("bigint").alias("tp"),
        F.lit(0).cast("bigint").alias("fp"), F.lit(0).cast("bigint").alias("pos"),
        F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def average_precision(curve: DataFrame) -> DataFrame:
    """AP = sum over distinct scores of (recall step) x precision; tied
    scores form one step."""
    tot = F.sum("pos")
    return curve.where(F.col("threshold").isNotNull()).agg(
        F.round(F.when(tot > 0, F.sum(F.col("pos") * F.col("precision")) / tot)
                .otherwise(F.lit(0.0)), R9).alias("average_precision"))


def operating_point(df: DataFrame, y: str, score: str, threshold: float, positive: int = 0
                    ) -> DataFrame:
    """Precision and recall at a frozen threshold (0 when undefined)."""
    sel = (F.col(score) >= F.lit(float(threshold))) & ~F.isnan(score)
    pos = F.col(y) == positive
    a = df.agg(F.count_if(sel & pos).alias("tp"), F.count_if(sel).alias("sel"),
               F.count_if(pos).alias("pos"))
    return a.select(F.lit(float(threshold)).alias("threshold"),
                    F.when(F.col("sel") > 0, F.col("tp") / F.col("sel")).otherwise(F.lit(0.0))
                     .alias("precision"),
                    F.when(F.col("pos") > 0, F.col("tp") / F.col("pos")).otherwise(F.lit(0.0))
                     .alias("recall"))


# --- F13 --------------------------------------------------------------------

def error_cohorts(df: DataFrame, y: str = "y", pred: str = "pred",
                  names: tuple = CLASS_NAMES) -> DataFrame:
    """Per row: true/predicted names, correct flag, ``"True → Predicted"``."""
    nm = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(i), F.lit(n))])
    t = F.element_at(nm, F.col(y))
    p = F.element_at(nm, F.col(pred))
    ok = F.col(y) == F.col(pred)
    return df.select("*", t.alias("true_label"), p.alias("predicted_label"),
                     ok.alias("is_correct"),
                     F.when(ok, F.lit("Correct")).otherwise(F.concat(t, F.lit(" → "), p))
                     .alias("error_type"))


def cohort_counts(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    e = error_cohorts(df.select(y, pred), y, pred)
    return e.groupBy("error_type", "true_label", "predicted_label", "is_correct").agg(
        F.count(F.lit(1)).cast("bigint").alias("count"))


# --- F14 / F15 --------------------------------------------------------------

def model_comparison(long: DataFrame, order: list[str], model: str = "model", y: str = "y",
                     pred: str = "pred") -> DataFrame:
    """One row per model in fixed order: accuracy, macro-F1, rare P/R/F1 and
    the other two F1s (one grouped aggregate for all models)."""
    m = class_metrics(long, y, pred, [model])
    pos = F.create_map(*[x for i, n in enumerate(order) for x in (F.lit(n), F.lit(i))])
    return m.select(F.element_at(pos, F.col(model)).alias("position"), model, "accuracy",
                    "macro_f1", "fatal_precision", "fatal_recall", "fatal_f1", "serious_f1",
                    "slight_f1")


def metric_melt(wide: DataFrame, id_col: str = "model",
                metrics: tuple[str, ...] = ("macro_f1", "fatal_f1")) -> DataFrame:
    return wide.select(id_col, *metrics).unpivot([id_col], list(metrics), "metric", "score")


# --- A6 ---------------------------------------------------------------------

def upsert_by_key(current: DataFrame, new: DataFrame, key: str | list[str] = "slug") -> DataFrame:
    """Replace every ``key`` present in ``new``; keep the other rows.

    Left-anti join against the distinct keys of ``new``, without a hint and
    without a counting job (which would run ``new``'s whole plan twice): AQE
    broadcasts the key side when its measured size is small, so a key held
    by a third of ``current`` costs nothing, and splits skewed partitions of
    a shuffle anti join on the ``current`` side otherwise."""
    key = [key] if isinstance(key, str) else key
    keys = new.select(*key).distinct()
    return current.join(keys, key, "left_anti").unionByName(new, allowMissingColumns=True)
