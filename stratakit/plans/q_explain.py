"""Queries for overlap and attribution.

The attribution check uses linear-model attribution (exact for a linear
margin model) on the whole modelling frame with a fixed coefficient rule, so the
chain - category discovery, attribution, source aggregation, top-k, overlaps - has a value oracle
without a fitted model.  The SQL builds every row's design; Spark works from value counts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import explain as G

from ..functions.expressions import hour_from_cyclical
from ..presets import HOUR_SOURCE
from . import inputs as I
from .oracle_base import with_ctes
from .registry import register

L = I.L
CAT_IN = L.categorical_inputs          # road_type, light, first/second road class, crossing, dow, area, Season
NUM_IN = L.numeric_inputs              # speed_limit, hour_sin, hour_cos, rush_hour
LABELLED = frozenset(L.label_maps())
SOURCES = [c for c in CAT_IN] + ["speed_limit", "rush_hour"]
NAMES = ("Fatal", "Serious", "Slight")


def _counts(spark, d):
    """How often each column of the modelling frame has each value, by class; the hour is rebuilt."""
    hour = hour_from_cyclical("hour_sin", "hour_cos")
    columns = {c: F.col(c) for c in CAT_IN + NUM_IN} | {HOUR_SOURCE: hour}
    return G.level_counts(I.model_frame(spark, d), columns)


def _attr(spark, d):
    """Mean absolute attributions over the whole frame, its design columns and counts."""
    counts = _counts(spark, d)
    feats = G.design_columns(counts, CAT_IN, NUM_IN)
    return G.linear_means(G.deviations(counts, feats), G.fixed_coefficient), feats, counts


# --- SQL pieces -----------------------------------------------------------------

_SAMPLE = "SELECT * FROM model_frame"
_CAT_U = " UNION ALL ".join(
    f"SELECT row_index, '{c}' AS source, {i} AS ord, CAST(\"{c}\" AS VARCHAR) AS v FROM sample"
    for i, c in enumerate(CAT_IN))
_NUM_U = " UNION ALL ".join(
    f"SELECT row_index, '{c}' AS source, CAST(\"{c}\" AS DOUBLE) AS x FROM sample" for c in NUM_IN)
_LV = f"SELECT DISTINCT source, ord, v AS level FROM ({_CAT_U}) u WHERE v IS NOT NULL"
_FEATURES = f"""
  SELECT concat(source, '_', level) AS feature, source, level,
         CAST(row_number() OVER (ORDER BY ord, level) - 1 AS INTEGER) AS position FROM lv
  UNION ALL
  SELECT name, name, NULL, CAST((SELECT count(*) FROM lv) + i AS INTEGER)
  FROM (VALUES {", ".join(f"('{c}', {i})" for i, c in enumerate(NUM_IN))}) n(name, i)"""
_DESIGN = f"""
  SELECT u.row_index, f.position, CAST(u.v = f.level AS DOUBLE) AS x
  FROM ({_CAT_U}) u JOIN features f ON f.source = u.source AND f.level IS NOT NULL
  UNION ALL
  SELECT u.row_index, f.position, u.x
  FROM ({_NUM_U}) u JOIN features f ON f.source = u.source AND f.level IS NULL"""
_ATTR = """
  SELECT d.row_index, d.position, k.class,
         (CAST(((d.position * 37 + k.class * 11) % 17) - 8 AS DOUBLE) / 10) * (d.x - m.mean) AS value
  FROM design d JOIN (SELECT position, avg(x) AS mean FROM design GROUP BY position) m USING (position)
  CROSS JOIN (VALUES (0), (1), (2)) k(class)"""
ATTR_CTES = [("sample", _SAMPLE), ("lv", _LV), ("features", _FEATURES), ("design", _DESIGN),
             ("attr", _ATTR)]

_BY_SOURCE = """
  SELECT CAST(row_number() OVER (ORDER BY v DESC, source_feature) AS INTEGER) AS rank, source_feature,
         round(v, 9) AS mean_abs_shap, components
  FROM (SELECT CASE WHEN f.source IN ('hour_sin', 'hour_cos') THEN 'Hour_of_Day' ELSE f.source END AS source_feature,
               sum(p.m) AS v, list(f.feature ORDER BY f.position) AS components
        FROM (SELECT position, avg(abs(value)) AS m FROM attr WHERE class = 0 GROUP BY position) p
        JOIN features f USING (position) GROUP BY 1) g"""


def _pairs_sql(src: str, feature_expr: str) -> str:
    """Overlap rows from a per-(feature, level) class-count table ``src``."""
    sh = (f"SELECT {feature_expr} AS feature, " + ", ".join(
        f"CASE WHEN sum(c{k}) OVER (PARTITION BY {feature_expr}) > 0 THEN CAST(c{k} AS DOUBLE) / "
        f"sum(c{k}) OVER (PARTITION BY {feature_expr}) ELSE 0.0 END AS s{k}" for k in range(3))
        + f" FROM {src}")
    return " UNION ALL ".join(
        f"SELECT feature, '{NAMES[a]}' AS class_a, '{NAMES[b]}' AS class_b, "
        f"round(coalesce(sum(least(s{a}, s{b})), 0.0), 9) AS overlap FROM ({sh}) s GROUP BY feature"
        for a, b in ((0, 1), (0, 2), (1, 2)))


def _cat_counts(features: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, coalesce(CAST(\"{c}\" AS VARCHAR), '<missing>') AS level, "
        + ", ".join(f"count(*) FILTER (WHERE label = {k}) AS c{k}" for k in range(3))
        + " FROM model_frame GROUP BY 2" for c in features)


def _num_counts(feature: str, value_sql: str) -> str:
    return f"""
  SELECT '{feature}' AS feature, b AS level, """ + ", ".join(
        f"count(*) FILTER (WHERE label = {k}) AS c{k}" for k in range(3)) + f"""
  FROM (SELECT label, CASE WHEN x = hi THEN 19
                          ELSE (SELECT count(*) FROM range(21) r(j)
                                WHERE x >= CASE WHEN j = 20 THEN hi ELSE CAST(j AS DOUBLE) * ((hi - lo) / 20) + lo END) - 1 END AS b
        FROM (SELECT label, {value_sql} AS x FROM model_frame) v,
             (SELECT min({value_sql}) AS lo, max({value_sql}) AS hi FROM model_frame) mm) z
  GROUP BY b"""


_HOUR = ("CAST((CAST(round_even(((atan2(hour_sin, hour_cos) % (2 * pi())) + (2 * pi())) % (2 * pi()) "
         "* 24 / (2 * pi()), 0) AS INTEGER) % 24 + 24) % 24 AS DOUBLE)")


# --- registered queries -----------------------------------------------------------

@register("overlap_categorical", with_ctes(["model_frame"], _pairs_sql(
    f"({_cat_counts(['light'])}) c", "feature")))
def q_overlap_cat(spark, d):
    return G.overlap_categorical(I.model_frame(spark, d), "light")


@register("overlap_numeric", with_ctes(["model_frame"], _pairs_sql(
    f"({_num_counts('speed_limit', 'CAST(speed_limit AS DOUBLE)')}) c", "feature")))
def q_overlap_num(spark, d):
    return G.overlap_numeric(I.model_frame(spark, d), "speed_limit")


_KIND_FEATS = CAT_IN + ["speed_limit", "rush_hour", "hour_sin"]
_NUMERIC_TYPED = {"first_road_class", "second_road_class", "day_of_week", "area", "speed_limit",
                  "rush_hour", "hour_sin"}


@register("dist_kind", with_ctes(["model_frame"], " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST(count(DISTINCT CAST(\"{c}\" AS VARCHAR)) AS BIGINT) AS levels, "
    f"CASE WHEN {'true' if (c in LABELLED or c not in _NUMERIC_TYPED) else 'false'} "
    f"OR count(DISTINCT CAST(\"{c}\" AS VARCHAR)) <= 12 THEN 'categorical' ELSE 'numeric' END AS kind "
    f"FROM model_frame" for c in _KIND_FEATS)))
def q_dist_kind(spark, d):
    return G.dist_kind(I.model_frame(spark, d), _KIND_FEATS, LABELLED)


@register("linear_attribution", with_ctes(["model_frame"], """
  SELECT position, class, count(*) AS n, round(avg(abs(value)), 9) AS mean_abs, round(max(value), 9) + 0.0 AS largest,
         round(min(value), 9) + 0.0 AS smallest
  FROM attr GROUP BY 1, 2""", extra=ATTR_CTES))
def q_linear_attr(spark, d):
    """G4 over every row, summarised by design column and class."""
    a, _, _ = _attr(spark, d)
    return a.select("position", "class", F.col("n").cast("bigint").alias("n"), F.round("m", 9).alias("mean_abs"),
                    (F.round("largest", 9) + 0.0).alias("largest"), (F.round("smallest", 9) + 0.0).alias("smallest"))


@register("attribution_by_source", with_ctes(["model_frame"], _BY_SOURCE, extra=ATTR_CTES))
def q_by_source(spark, d):
    a, feats, _ = _attr(spark, d)
    return G.attribution_by_source(a, feats)


@register("global_importance", with_ctes(["model_frame"], """
  SELECT rank, feature, class, round(m, 9) AS mean_abs_shap FROM (
    SELECT p.position, p.class, p.m, f.feature,
           CAST(dense_rank() OVER (ORDER BY o.o DESC, p.position) AS INTEGER) AS rank
    FROM (SELECT position, class, avg(abs(value)) AS m FROM attr GROUP BY position, class) p
    JOIN (SELECT position, avg(m) AS o FROM (SELECT position, class, avg(abs(value)) AS m FROM attr
                                            GROUP BY position, class) q GROUP BY position) o USING (position)
    JOIN features f USING (position)) r
  WHERE rank <= 15""", extra=ATTR_CTES))
def q_global_importance(spark, d):
    a, feats, _ = _attr(spark, d)
    return G.global_importance(a, feats, 15)


_ALL_OVERLAPS = (_pairs_sql(f"({_cat_counts(SOURCES)}) c", "feature") + " UNION ALL "
                 + _pairs_sql(f"({_num_counts('Hour_of_Day', _HOUR)}) c", "feature"))


@register("top_feature_overlap", with_ctes(["model_frame"], f"""
  SELECT o.feature, o.class_a, o.class_b, o.overlap,
         CASE WHEN o.feature = 'Hour_of_Day' THEN 'numeric' ELSE 'categorical' END AS kind, t.rank
  FROM ({_ALL_OVERLAPS}) o JOIN (SELECT rank, source_feature FROM ({_BY_SOURCE}) b WHERE rank <= 5) t
    ON t.source_feature = o.feature""", extra=ATTR_CTES))
def q_top_feature_overlap(spark, d):
    a, feats, counts = _attr(spark, d)
    return G.top_feature_overlap(G.attribution_by_source(a, feats), counts, _NUMERIC_TYPED | {"hour_cos", HOUR_SOURCE}, 5, LABELLED)
