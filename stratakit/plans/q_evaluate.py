"""Queries for decisions and evaluation.

Inputs are the fixtures' deterministic surrogate scores over ``clean`` (so
every metric has a value oracle without a model) and the D2 folds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import argmax3, ordinal_probabilities, threshold_decision
from ..operators import decide as Dc
from ..operators import evaluate as E
from . import inputs as I
from .oracle_base import with_ctes
from .registry import register

T_STAR = 0.215          # threshold chosen by the sweep on the surrogate scores
ALPHAS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5)
MODELS = ("argmax", "threshold", "ordinal")
NAMES = ("fatal", "serious", "slight")


# --- SQL helpers --------------------------------------------------------------

def wide_sql(src: str, y: str, pred: str, group: list[str], count: str | None = None) -> str:
    agg = (lambda c: f"CAST(count(*) FILTER (WHERE {c}) AS BIGINT)") if count is None else \
        (lambda c: f"CAST(sum(CASE WHEN {c} THEN {count} ELSE 0 END) AS BIGINT)")
    cols = ", ".join(f"{agg(f'{y} = {i} AND {pred} = {j}')} AS c{i}{j}" for i in range(3) for j in range(3))
    g = ", ".join(group)
    return (f"SELECT {g + ', ' if g else ''}{cols} FROM {src}" + (f" GROUP BY {g}" if g else ""))


def metrics_sql(src: str, group: list[str], keep_counts: bool = False) -> str:
    parts = list(group)
    n = " + ".join(f"c{i}{j}" for i in range(3) for j in range(3))
    diag = " + ".join(f"c{i}{i}" for i in range(3))
    parts += [f"CAST(({n}) AS BIGINT) AS n",
              f"CASE WHEN ({n}) > 0 THEN CAST(({diag}) AS DOUBLE) / ({n}) ELSE 0.0 END AS accuracy"]
    f1s, pres = [], []
    for i, name in enumerate(NAMES):
        sup = "(" + " + ".join(f"c{i}{j}" for j in range(3)) + ")"
        prd = "(" + " + ".join(f"c{j}{i}" for j in range(3)) + ")"
        tp = f"c{i}{i}"
        den = f"(2 * {tp} + ({prd} - {tp}) + ({sup} - {tp}))"
        f1 = f"CASE WHEN {den} > 0 THEN CAST(2 * {tp} AS DOUBLE) / {den} ELSE 0.0 END"
        parts += [f"CASE WHEN {prd} > 0 THEN CAST({tp} AS DOUBLE) / {prd} ELSE 0.0 END AS {name}_precision",
                  f"CASE WHEN {sup} > 0 THEN CAST({tp} AS DOUBLE) / {sup} ELSE 0.0 END AS {name}_recall",
                  f"{f1} AS {name}_f1"]
        f1s.append(f1)
        pres.append(f"({sup} + {prd} > 0)")
    k = " + ".join(f"CAST({p} AS INTEGER)" for p in pres)
    tot = "0.0" + "".join(f" + CASE WHEN {p} THEN {f} ELSE 0.0 END" for p, f in zip(pres, f1s))
    parts.insert(len(group) + 2, f"CASE WHEN ({k}) > 0 THEN ({tot}) / ({k}) ELSE 0.0 END AS macro_f1")
    if keep_counts:
        parts += [f"c{i}{j}" for i in range(3) for j in range(3)]
    return f"SELECT {', '.join(parts)} FROM {src}"


THRESHOLD_PRED = ("CAST(CASE WHEN p0 >= {t} THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS INTEGER)")


def _thr(t) -> str:
    return THRESHOLD_PRED.format(t=t)


FOLDS_SQL = """
  SELECT row_index, CAST((off + row_number() OVER (PARTITION BY label ORDER BY
             md5(concat('42:', CAST(row_index AS VARCHAR))), row_index) - 1) % {k} AS INTEGER) AS fold
  FROM (SELECT m.row_index, m.label, o.off FROM model_frame m JOIN
          (SELECT label, coalesce(sum(count(*)) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING
                                                      AND 1 PRECEDING), 0) AS off
           FROM model_frame GROUP BY label) o USING (label)) t"""

ORDINAL_SQL = """
  SELECT row_index, y,
         CASE WHEN s_rare > s_worse THEN (s_worse + s_rare) / 2 ELSE s_rare END AS p0,
         CASE WHEN s_rare > s_worse THEN (s_worse + s_rare) / 2 ELSE s_worse END
           - CASE WHEN s_rare > s_worse THEN (s_worse + s_rare) / 2 ELSE s_rare END AS p1,
         1 - CASE WHEN s_rare > s_worse THEN (s_worse + s_rare) / 2 ELSE s_worse END AS p2
  FROM scores"""

LONG_SQL = f"""
  SELECT 'argmax' AS model, row_index, y, pred FROM scored
  UNION ALL SELECT 'threshold', row_index, y, {_thr(T_STAR)} FROM scores
  UNION ALL SELECT 'ordinal', row_index, y,
     CAST(CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS INTEGER) FROM ordinal"""


# --- Spark helpers ------------------------------------------------------------

def _long(spark, d):
    s = I.scores(spark, d)
    arg = s.select(F.lit("argmax").alias("model"), "row_index", "y",
                   argmax3("p0", "p1", "p2").alias("pred"))
    thr = s.select(F.lit("threshold").alias("model"), "row_index", "y",
                   threshold_decision("p0", "p1", "p2", T_STAR).alias("pred"))
    o0, o1, o2 = ordinal_probabilities("s_worse", "s_rare")
    orde = s.select(F.lit("ordinal").alias("model"), "row_index", "y",
                    argmax3(o0, o1, o2).alias("pred"))
    return arg.unionByName(thr).unionByName(orde)


def _argmax_counts(spark, d, folds):
    """`inputs.fold_counts` of the argmax."""
    return I.fold_counts(I.labelled(spark, d), folds, {"pred": argmax3("p0", "p1", "p2")})


def _fold_rows(counts, fold="fold", slug="surrogate_argmax", model="Surrogate argmax"):
    """Metrics a ``fold`` of `_argmax_counts`."""
    told = counts.withColumn("fold", F.col(fold)).withColumn("slug", F.lit(slug)).withColumn("model", F.lit(model))
    return E.fold_rows(told, "y", "pred", count_col="n")


def _fold_rows_sql(k: int, slug: str, model: str) -> str:
    w = wide_sql(f"(SELECT s.*, f.fold FROM scored s JOIN folds{k} f USING (row_index)) x",
                 "y", "pred", ["fold"])
    m = metrics_sql(f"({w}) w", ["fold"])
    return (f"SELECT '{model}' AS model, '{slug}' AS slug, CAST(fold AS INTEGER) AS fold, "
            + ", ".join(E.FOLD_METRICS) + f" FROM ({m}) mm")


# --- registered queries -------------------------------------------------------

@register("confusion", with_ctes(["scored"], f"""
  SELECT t.i AS true_label, p.j AS pred_label,
         CAST(count(s.row_index) AS BIGINT) AS count
  FROM (VALUES (0), (1), (2)) t(i) CROSS JOIN (VALUES (0), (1), (2)) p(j)
  LEFT JOIN scored s ON s.y = t.i AND s.pred = p.j GROUP BY t.i, p.j"""))
def q_confusion(spark, d):
    return E.confusion(I.scored(spark, d), "y", "pred")


@register("confusion_normalized", with_ctes(["scored"], """
  SELECT true_label, pred_label, count,
         CASE WHEN sum(count) OVER (PARTITION BY true_label) > 0
              THEN CAST(count AS DOUBLE) / sum(count) OVER (PARTITION BY true_label) ELSE 0.0 END AS share
  FROM (SELECT t.i AS true_label, p.j AS pred_label, CAST(count(s.row_index) AS BIGINT) AS count
        FROM (VALUES (0), (1), (2)) t(i) CROSS JOIN (VALUES (0), (1), (2)) p(j)
        LEFT JOIN scored s ON s.y = t.i AND s.pred = p.j GROUP BY t.i, p.j) c"""))
def q_confusion_norm(spark, d):
    return E.confusion_normalized(E.confusion(I.scored(spark, d), "y", "pred"))


@register("class_metrics", with_ctes(["scored"], metrics_sql(
    f"({wide_sql('scored', 'y', 'pred', [])}) w", [])))
def q_class_metrics(spark, d):
    return E.class_metrics(I.scored(spark, d), "y", "pred")


@register("apply_threshold", with_ctes(["scores"], f"""
  SELECT row_index, {_thr(T_STAR)} AS pred FROM scores"""))
def q_apply_threshold(spark, d):
    return E.apply_threshold(I.scores(spark, d), T_STAR).select("row_index", "pred")


def _thr_metrics_sql(src_pred: str, thr_expr: str, group: list[str]) -> str:
    w = wide_sql(src_pred, "y", "pred", group)
    m = metrics_sql(f"({w}) w", group, keep_counts=True)
    g = ", ".join(group)
    return (f"SELECT {g + ', ' if g else ''}{thr_expr} AS threshold, macro_f1, fatal_precision, "
            "fatal_recall, fatal_f1, CASE WHEN n > 0 THEN CAST(c00 + c10 + c20 AS DOUBLE) / n "
            f"ELSE 0.0 END AS predicted_fatal_proportion FROM ({m}) mm")


@register("threshold_metrics", with_ctes(["scores"], _thr_metrics_sql(
    f"(SELECT y, {_thr(T_STAR)} AS pred FROM scores) x", f"CAST({T_STAR} AS DOUBLE)", [])))
def q_threshold_metrics(spark, d):
    return E.threshold_metrics(I.scores(spark, d), T_STAR)


_GRID = ("(SELECT i, CASE WHEN i = 200 THEN CAST(1.0 AS DOUBLE) "
         "ELSE CAST(i AS DOUBLE) * (CAST(1.0 AS DOUBLE) / 200) END AS t FROM range(201) r(i)) g")
_SWEEP = _thr_metrics_sql(
    f"(SELECT g.i, s.y, CAST(CASE WHEN s.p0 >= g.t THEN 0 WHEN s.p1 >= s.p2 THEN 1 ELSE 2 END AS INTEGER) AS pred "
    f"FROM scores s CROSS JOIN {_GRID}) x",
    "CASE WHEN i = 200 THEN CAST(1.0 AS DOUBLE) ELSE CAST(i AS DOUBLE) * (CAST(1.0 AS DOUBLE) / 200) END",
    ["i"])


@register("threshold_sweep", with_ctes(["scores"], f"""
  SELECT threshold, macro_f1, fatal_precision, fatal_recall, fatal_f1, predicted_fatal_proportion
  FROM ({_SWEEP}) sw"""))
def q_sweep(spark, d):
    return E.threshold_sweep(I.scores(spark, d))


@register("select_threshold", with_ctes(["scores"], f"""
  SELECT threshold, macro_f1, fatal_precision, fatal_recall, fatal_f1, predicted_fatal_proportion
  FROM ({_SWEEP}) sw ORDER BY macro_f1 DESC, fatal_f1 DESC, threshold DESC LIMIT 1"""))
def q_select_threshold(spark, d):
    return E.select_threshold(E.threshold_sweep(I.scores(spark, d)))


@register("fold_rows", with_ctes(["scored", "model_frame"], _fold_rows_sql(
    5, "surrogate_argmax", "Surrogate argmax"), extra=[("folds5", FOLDS_SQL.format(k=5))]))
def q_fold_rows(spark, d):
    return _fold_rows(_argmax_counts(spark, d, {"fold": 5}))


_MELT_FOLD = " UNION ALL ".join(f"SELECT slug, '{m}' AS metric, {m} AS value FROM fr"
                                for m in E.FOLD_METRICS)


@register("fold_summary", with_ctes(["scored", "model_frame"], f"""
  SELECT slug, metric, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS std
  FROM ({_MELT_FOLD}) u GROUP BY slug, metric""",
    extra=[("folds5", FOLDS_SQL.format(k=5)), ("fr", _fold_rows_sql(5, "surrogate_argmax",
                                                                      "Surrogate argmax"))]))
def q_fold_summary(spark, d):
    return E.fold_summary(_fold_rows(_argmax_counts(spark, d, {"fold": 5})))


_CAND_SRC = " UNION ALL ".join(
    f"SELECT CAST({a} AS DOUBLE) AS alpha, s.y, f.fold, {_thr(a)} AS pred "
    f"FROM scores s JOIN folds5 f USING (row_index)" for a in ALPHAS)
_CAND_W = wide_sql(f"({_CAND_SRC}) x", "y", "pred", ["alpha", "fold"])
_CAND_SUMMARY = f"""
  SELECT alpha, round(avg(macro_f1), 9) AS macro_f1_mean, round(stddev_samp(macro_f1), 9) AS macro_f1_std,
         round(avg(fatal_precision), 9) AS fatal_precision_mean, round(avg(fatal_recall), 9) AS fatal_recall_mean,
         round(avg(fatal_f1), 9) AS fatal_f1_mean, round(avg(serious_f1), 9) AS serious_f1_mean,
         round(avg(slight_f1), 9) AS slight_f1_mean
  FROM ({metrics_sql(f"({_CAND_W}) w", ["alpha", "fold"])}) m GROUP BY alpha"""


def _candidate_rows(spark, d):
    counts = I.fold_counts(I.labelled(spark, d), {"fold": 5},
                           {f"pred{i}": threshold_decision("p0", "p1", "p2", a) for i, a in enumerate(ALPHAS)})
    told = [F.struct(F.lit(float(a)).alias("alpha"), F.col(f"pred{i}").alias("pred")) for i, a in enumerate(ALPHAS)]
    long = counts.select("y", "fold", "n", F.inline(F.array(*told)))
    return E.class_metrics(long, "y", "pred", ["alpha", "fold"], "n")


@register("candidate_summary", with_ctes(["scores", "model_frame"], _CAND_SUMMARY,
                                         extra=[("folds5", FOLDS_SQL.format(k=5))]))
def q_candidate_summary(spark, d):
    return E.candidate_summary(_candidate_rows(spark, d), ["alpha"])


@register("select_candidate", with_ctes(["scores", "model_frame"], f"""
  SELECT * FROM ({_CAND_SUMMARY}) c ORDER BY macro_f1_mean DESC, alpha ASC LIMIT 1""",
    extra=[("folds5", FOLDS_SQL.format(k=5))]))
def q_select_candidate(spark, d):
    return E.select_candidate(E.candidate_summary(_candidate_rows(spark, d), ["alpha"]), "alpha")


PR_SQL = """
  SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(pos AS BIGINT) AS pos,
         CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS precision,
         CASE WHEN total_pos > 0 THEN CAST(tp AS DOUBLE) / total_pos ELSE 1.0 END AS recall
  FROM (SELECT threshold, pos, sum(pos) OVER () AS total_pos,
               sum(pos) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
               sum(neg) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp
        FROM (SELECT p0 AS threshold, count(*) FILTER (WHERE y = 0) AS pos,
                     count(*) FILTER (WHERE y <> 0) AS neg
              FROM scores GROUP BY p0) g) c"""


@register("pr_curve", with_ctes(["scores"], PR_SQL + """
  UNION ALL SELECT CAST(NULL AS DOUBLE), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), 1.0, 0.0"""))
def q_pr_curve(spark, d):
    return E.pr_curve(I.scores(spark, d), "y", "p0")


@register("average_precision", with_ctes(["scores"], f"""
  SELECT round(CASE WHEN sum(pos) > 0 THEN sum(pos * precision) / sum(pos) ELSE 0.0 END, 9) AS average_precision
  FROM ({PR_SQL}) c"""))
def q_average_precision(spark, d):
    return E.average_precision(E.pr_curve(I.scores(spark, d), "y", "p0"))


@register("operating_point", with_ctes(["scores"], f"""
  SELECT CAST({T_STAR} AS DOUBLE) AS threshold,
         CASE WHEN sel > 0 THEN CAST(tp AS DOUBLE) / sel ELSE 0.0 END AS precision,
         CASE WHEN pos > 0 THEN CAST(tp AS DOUBLE) / pos ELSE 0.0 END AS recall
  FROM (SELECT count(*) FILTER (WHERE p0 >= {T_STAR} AND y = 0) AS tp,
               count(*) FILTER (WHERE p0 >= {T_STAR}) AS sel, count(*) FILTER (WHERE y = 0) AS pos
        FROM scores) a"""))
def q_operating_point(spark, d):
    return E.operating_point(I.scores(spark, d), "y", "p0", T_STAR)


_NAME = "CASE {c} WHEN 0 THEN 'Fatal' WHEN 1 THEN 'Serious' WHEN 2 THEN 'Slight' END"


@register("error_cohorts", with_ctes(["scored"], f"""
  SELECT CASE WHEN y = pred THEN 'Correct' ELSE concat({_NAME.format(c='y')}, ' → ', {_NAME.format(c='pred')}) END AS error_type,
         {_NAME.format(c='y')} AS true_label, {_NAME.format(c='pred')} AS predicted_label,
         y = pred AS is_correct, CAST(count(*) AS BIGINT) AS count
  FROM scored GROUP BY 1, 2, 3, 4"""))
def q_error_cohorts(spark, d):
    return E.cohort_counts(I.scored(spark, d), "y", "pred")


_CMP = f"""
  SELECT CASE model WHEN 'argmax' THEN 0 WHEN 'threshold' THEN 1 WHEN 'ordinal' THEN 2 END AS position,
         model, accuracy, macro_f1, fatal_precision, fatal_recall, fatal_f1, serious_f1, slight_f1
  FROM ({metrics_sql(f"({wide_sql('long', 'y', 'pred', ['model'])}) w", ['model'])}) m"""


@register("model_comparison", with_ctes(["scored"], _CMP,
                                        extra=[("ordinal", ORDINAL_SQL), ("long", LONG_SQL)]))
def q_model_comparison(spark, d):
    return E.model_comparison(_long(spark, d), list(MODELS))


@register("metric_melt", with_ctes(["scored"], f"""
  SELECT model, 'macro_f1' AS metric, macro_f1 AS score FROM ({_CMP}) c
  UNION ALL SELECT model, 'fatal_f1', fatal_f1 FROM ({_CMP}) c""",
    extra=[("ordinal", ORDINAL_SQL), ("long", LONG_SQL)]))
def q_metric_melt(spark, d):
    return E.metric_melt(E.model_comparison(_long(spark, d), list(MODELS)))


@register("upsert_by_key", with_ctes(["scored", "model_frame"], f"""
  SELECT * FROM cur WHERE slug NOT IN (SELECT slug FROM new) UNION ALL SELECT * FROM new""",
    extra=[("folds5", FOLDS_SQL.format(k=5)), ("folds3", FOLDS_SQL.format(k=3)),
           ("cur", _fold_rows_sql(5, "surrogate_argmax", "Surrogate argmax") + " UNION ALL "
            + _fold_rows_sql(5, "surrogate_copy", "Surrogate copy")),
           ("new", _fold_rows_sql(3, "surrogate_argmax", "Surrogate argmax"))]))
def q_upsert(spark, d):
    counts = _argmax_counts(spark, d, {"fold5": 5, "fold3": 3})
    cur = _fold_rows(counts, "fold5").unionByName(_fold_rows(counts, "fold5", slug="surrogate_copy", model="Surrogate copy"))
    new = _fold_rows(counts, "fold3")
    return E.upsert_by_key(cur, new, "slug")


REGISTRY = [("threshold", "ready", T_STAR), ("ordinal", "pending", 0.3), ("argmax", "ready", None)]
_REG_SQL = "(VALUES " + ", ".join(
    f"('{m}', '{s}', {'NULL' if t is None else f'CAST({t} AS DOUBLE)'})" for m, s, t in REGISTRY) + \
    ") r(model_artifact, status, threshold)"


def _registry(spark):
    return spark.createDataFrame(REGISTRY, "model_artifact string, status string, threshold double")


@register("threshold_match", with_ctes(["scored"], f"""
  SELECT m.model_artifact, CASE WHEN r.status = 'ready' AND r.threshold IS NOT NULL THEN r.threshold END AS threshold
  FROM (SELECT DISTINCT model AS model_artifact FROM long) m
  LEFT JOIN {_REG_SQL} ON m.model_artifact = r.model_artifact""",
    extra=[("ordinal", ORDINAL_SQL), ("long", LONG_SQL)]))
def q_threshold_match(spark, d):
    models = _long(spark, d).select(F.col("model").alias("model_artifact")).distinct()
    return Dc.threshold_match(models, _registry(spark))


@register("score_decisions", with_ctes(["scores"], f"""
  SELECT model, decision, CAST(count(*) AS BIGINT) AS count FROM (
    SELECT p.model, CAST(CASE WHEN t.threshold IS NOT NULL THEN
             CASE WHEN p.p0 >= t.threshold THEN 0 WHEN p.p1 >= p.p2 THEN 1 ELSE 2 END
           ELSE CASE WHEN p.p0 >= p.p1 AND p.p0 >= p.p2 THEN 0 WHEN p.p1 >= p.p2 THEN 1 ELSE 2 END END AS INTEGER) AS decision
    FROM probs p LEFT JOIN (SELECT model_artifact,
                                   CASE WHEN status = 'ready' AND threshold IS NOT NULL THEN threshold END AS threshold
                            FROM {_REG_SQL}) t ON p.model = t.model_artifact) x
  GROUP BY model, decision""",
    extra=[("ordinal", ORDINAL_SQL), ("probs", """
      SELECT 'argmax' AS model, row_index, p0, p1, p2 FROM scores
      UNION ALL SELECT 'threshold', row_index, p0, p1, p2 FROM scores
      UNION ALL SELECT 'ordinal', row_index, p0, p1, p2 FROM ordinal""")]))
def q_score_decisions(spark, d):
    s = I.scores(spark, d)
    o0, o1, o2 = ordinal_probabilities("s_worse", "s_rare")
    probs = (s.select(F.lit("argmax").alias("model"), "row_index", "p0", "p1", "p2")
             .unionByName(s.select(F.lit("threshold").alias("model"), "row_index", "p0", "p1", "p2"))
             .unionByName(s.select(F.lit("ordinal").alias("model"), "row_index", o0.alias("p0"),
                                   o1.alias("p1"), o2.alias("p2"))))
    matched = Dc.threshold_match(probs.withColumnRenamed("model", "model_artifact"),
                                 _registry(spark))
    dec = Dc.decide(matched)
    return dec.groupBy(F.col("model_artifact").alias("model"), "decision").agg(
        F.count(F.lit(1)).cast("bigint").alias("count"))


@register("cumulative_targets", with_ctes(["model_frame"], """
  SELECT row_index, label, CAST(label IN (0, 1) AS INTEGER) AS serious_or_worse,
         CAST(label = 0 AS INTEGER) AS rare FROM model_frame"""))
def q_cumulative(spark, d):
    return Dc.cumulative_targets(I.model_frame(spark, d).select("row_index", "label"))


@register("ordinal_compose", with_ctes(["scores"], "SELECT row_index, p0, p1, p2 FROM ordinal",
                                       extra=[("ordinal", ORDINAL_SQL)]))
def q_ordinal(spark, d):
    return Dc.ordinal_compose(I.scores(spark, d).select("row_index", "s_worse", "s_rare")) \
        .select("row_index", "p0", "p1", "p2")


@register("argmax_predict", with_ctes(["scored"], "SELECT row_index, pred FROM scored"))
def q_argmax(spark, d):
    return Dc.argmax_predict(I.scores(spark, d)).select("row_index", "pred")
