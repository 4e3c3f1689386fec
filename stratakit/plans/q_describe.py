"""Queries for the descriptive operators."""

from __future__ import annotations

from itertools import combinations

from ..operators import describe as D
from . import inputs as I
from .oracle_base import with_ctes
from .registry import register

# analytical features of the surrogate (no weather / road surface)
CATS = ["severity", "day_of_week", "month", "season", "rush_hour", "speed_limit",
        "first_road_class", "second_road_class", "road_type", "urban_rural",
        "crossing_facilities", "light_conditions"]
NUMS = ["severity_score", "speed_limit", "month_number", "hour", "rush_hour_flag"]
SPEARMAN_COLS = ["severity_score", "speed_limit", "hour_sin", "hour_cos", "rush_hour_flag"]


@register("class_summary", with_ctes(["analytical"], """
  SELECT d.position, d.severity, CAST(coalesce(c.n, 0) AS BIGINT) AS count,
         CAST(coalesce(c.n, 0) AS DOUBLE) / t.total * 100 AS percent
  FROM (VALUES (0, 'Fatal'), (1, 'Serious'), (2, 'Slight')) d(position, severity)
  LEFT JOIN (SELECT severity, count(*) AS n FROM analytical GROUP BY severity) c USING (severity)
  CROSS JOIN (SELECT count(*) AS total FROM analytical) t"""))
def q_class_summary(spark, d):
    return D.class_summary(I.analytical(spark, d))


_NUM_UNION = " UNION ALL ".join(
    f"SELECT '{c}' AS col, CAST({c} AS DOUBLE) AS v FROM analytical" for c in NUMS)


@register("numeric_summary", with_ctes(["analytical"], f"""
  SELECT col AS "column", CAST(count(v) AS BIGINT) AS count, round(avg(v), 9) AS mean,
         round(stddev_samp(v), 9) AS std, min(v) AS min,
         quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50,
         quantile_cont(v, 0.75) AS p75, max(v) AS max
  FROM ({_NUM_UNION}) t GROUP BY col"""))
def q_numeric_summary(spark, d):
    return D.numeric_summary(I.analytical(spark, d), NUMS)


_CAT_UNION = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS level, severity FROM analytical"
    for c in CATS[1:])


@register("category_by_class", with_ctes(["analytical"], f"""
  SELECT feature, level, CAST(cnt AS BIGINT) AS count,
         CAST(cnt AS DOUBLE) / total * 100 AS percent_of_cleaned_rows,
         CAST(f AS BIGINT) AS fatal_count, CAST(f AS DOUBLE) / cnt * 100 AS fatal_share_percent,
         CAST(s AS BIGINT) AS serious_count, CAST(s AS DOUBLE) / cnt * 100 AS serious_share_percent,
         CAST(l AS BIGINT) AS slight_count, CAST(l AS DOUBLE) / cnt * 100 AS slight_share_percent
  FROM (SELECT feature, level,
               count(*) FILTER (WHERE severity = 'Fatal') AS f,
               count(*) FILTER (WHERE severity = 'Serious') AS s,
               count(*) FILTER (WHERE severity = 'Slight') AS l,
               count(*) FILTER (WHERE severity IN ('Fatal', 'Serious', 'Slight')) AS cnt
        FROM ({_CAT_UNION}) u WHERE level IS NOT NULL GROUP BY feature, level) g
  CROSS JOIN (SELECT count(*) AS total FROM analytical) t
  WHERE cnt > 0"""))
def q_category_by_class(spark, d):
    return D.category_by_class(I.analytical(spark, d), CATS[1:])


@register("composition", with_ctes(["analytical"], """
  SELECT 'speed_limit' AS feature, o.position, o.level, CAST(coalesce(g.n, 0) AS BIGINT) AS n,
         CASE WHEN g.n > 0 THEN CAST(g.f AS DOUBLE) / g.n * 100 END AS fatal_percent,
         CASE WHEN g.n > 0 THEN CAST(g.s AS DOUBLE) / g.n * 100 END AS serious_percent,
         CASE WHEN g.n > 0 THEN CAST(g.l AS DOUBLE) / g.n * 100 END AS slight_percent
  FROM (VALUES (0, '20'), (1, '30'), (2, '40'), (3, '50'), (4, '60'), (5, '70'), (6, '80')) o(position, level)
  LEFT JOIN (SELECT CAST(speed_limit AS VARCHAR) AS level,
                    count(*) FILTER (WHERE severity = 'Fatal') AS f,
                    count(*) FILTER (WHERE severity = 'Serious') AS s,
                    count(*) FILTER (WHERE severity = 'Slight') AS l, count(*) AS n
             FROM analytical GROUP BY 1) g USING (level)"""))
def q_composition(spark, d):
    return D.composition(I.analytical(spark, d), "speed_limit", [20, 30, 40, 50, 60, 70, 80])


_DAYS = "(VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'), " \
        "(4, 'Friday'), (5, 'Saturday'), (6, 'Sunday')) o(position, day_of_week)"


@register("weekday_hour_pivot", with_ctes(["analytical"], f"""
  SELECT o.position, o.day_of_week, """ + ", ".join(
    f"CAST(coalesce(g.h{k}, 0) AS BIGINT) AS h{k}" for k in range(24)) + f"""
  FROM {_DAYS} LEFT JOIN (SELECT day_of_week, """ + ", ".join(
    f"count(*) FILTER (WHERE hour = {k}) AS h{k}" for k in range(24)) + """
    FROM analytical GROUP BY day_of_week) g USING (day_of_week)"""))
def q_weekday_hour(spark, d):
    return D.weekday_hour_pivot(I.analytical(spark, d))


_TEMPORAL_DOM = " UNION ALL ".join(
    [f"SELECT 'month' AS dimension, {i} AS position, '{m}' AS level"
     for i, m in enumerate(["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct",
                            "Nov", "Dec"])]
    + [f"SELECT 'season', {i}, '{s}'" for i, s in enumerate(["Winter", "Spring", "Summer", "Fall"])]
    + [f"SELECT 'weekday', {i}, '{s}'" for i, s in enumerate(
        ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"])]
    + [f"SELECT 'hour', {h}, '{h}'" for h in range(24)])


@register("temporal_counts", with_ctes(["analytical"], f"""
  SELECT dom.dimension, dom.position, dom.level, CAST(coalesce(g.n, 0) AS BIGINT) AS count
  FROM ({_TEMPORAL_DOM}) dom
  LEFT JOIN (
    SELECT CASE WHEN GROUPING(month) = 0 THEN 'month' WHEN GROUPING(season) = 0 THEN 'season'
                WHEN GROUPING(day_of_week) = 0 THEN 'weekday' ELSE 'hour' END AS dimension,
           coalesce(month, season, day_of_week, CAST(hour AS VARCHAR)) AS level, count(*) AS n
    FROM analytical
    GROUP BY GROUPING SETS ((month), (season), (day_of_week), (hour))) g
  ON dom.dimension = g.dimension AND dom.level = g.level"""))
def q_temporal(spark, d):
    return D.temporal_counts(I.analytical(spark, d))


def _cramers_sql(cells_sql: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    kx = ", ".join(keys + ["x"])
    ky = ", ".join(keys + ["y"])
    return f"""
  SELECT {k}, round(CASE WHEN n = 0 OR r < 2 OR c < 2 THEN 0.0
                   WHEN least(cc - 1, rc - 1) > 0 THEN sqrt(phi2c / least(cc - 1, rc - 1))
                   ELSE 0.0 END, 9) AS cramers_v
  FROM (SELECT *, greatest(0.0, (n * (s - 1)) / n - ((c - 1) * (r - 1)) / (n - 1)) AS phi2c,
               r - ((r - 1) * (r - 1)) / (n - 1) AS rc, c - ((c - 1) * (c - 1)) / (n - 1) AS cc
        FROM (SELECT {k}, sum(CAST(nij AS DOUBLE) * nij / (CAST(ai AS DOUBLE) * bj)) AS s,
                     CAST(sum(nij) AS DOUBLE) AS n,
                     CAST(count(DISTINCT x) AS DOUBLE) AS r, CAST(count(DISTINCT y) AS DOUBLE) AS c
              FROM (SELECT *, sum(nij) OVER (PARTITION BY {kx}) AS ai,
                              sum(nij) OVER (PARTITION BY {ky}) AS bj
                    FROM ({cells_sql}) cells) w
              GROUP BY {k}) a) b"""


@register("cramers_v", with_ctes(["analytical"], "SELECT 'severity' AS feature_a, "
                                 "'speed_limit' AS feature_b, cramers_v FROM (" + _cramers_sql(
    """SELECT 0 AS k0, severity AS x, CAST(speed_limit AS VARCHAR) AS y, count(*) AS nij
       FROM analytical WHERE severity IS NOT NULL AND speed_limit IS NOT NULL GROUP BY 1, 2, 3""",
    ["k0"]) + ") v"))
def q_cramers(spark, d):
    return D.cramers_v(I.analytical(spark, d), "severity", "speed_limit")


_PAIRS = list(combinations(CATS, 2))
_PAIR_CELLS = " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, CAST({a} AS VARCHAR) AS x, "
    f"CAST({b} AS VARCHAR) AS y, count(*) AS nij FROM analytical "
    f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2, 3, 4" for a, b in _PAIRS)


@register("association_matrix", with_ctes(["analytical"], f"""
  SELECT feature_a, feature_b, cramers_v FROM ({_cramers_sql(_PAIR_CELLS, ["feature_a", "feature_b"])}) v
  UNION ALL
  SELECT feature_b, feature_a, cramers_v FROM ({_cramers_sql(_PAIR_CELLS, ["feature_a", "feature_b"])}) v
  UNION ALL
  SELECT f, f, 1.0 FROM (VALUES {", ".join(f"('{c}')" for c in CATS)}) t(f)"""))
def q_association(spark, d):
    return D.association_matrix(I.analytical(spark, d), CATS)


def _rank_cte(cols: list[str]) -> str:
    sel = ", ".join(
        f"(rank() OVER (ORDER BY {c}) + count(*) OVER (PARTITION BY {c}) - 1 + rank() OVER (ORDER BY {c})) / 2.0 AS r_{c}"
        for c in cols)
    return f"SELECT {sel} FROM (SELECT " + ", ".join(
        f"CAST({c} AS DOUBLE) AS {c}" for c in cols) + f" FROM analytical) b"


def _corr_long(cols: list[str], src: str, name: str, prefix: str) -> str:
    parts = []
    for a, b in combinations(cols, 2):
        parts.append(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({prefix}{a}, {prefix}{b}), 9) AS {name} FROM ({src}) s")
        parts.append(f"SELECT '{b}', '{a}', round(corr({prefix}{a}, {prefix}{b}), 9) FROM ({src}) s")
    parts += [f"SELECT '{c}', '{c}', 1.0" for c in cols]
    return " UNION ALL ".join(parts)


@register("spearman", with_ctes(["analytical"], _corr_long(SPEARMAN_COLS, _rank_cte(SPEARMAN_COLS),
                                                          "spearman", "r_")))
def q_spearman(spark, d):
    return D.spearman(I.analytical(spark, d), SPEARMAN_COLS)


_PEARSON_SRC = "SELECT " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUMS) + " FROM analytical"


@register("pearson", with_ctes(["analytical"], _corr_long(NUMS, _PEARSON_SRC, "pearson", "")))
def q_pearson(spark, d):
    return D.pearson(I.analytical(spark, d), NUMS)


@register("within_class_dist", with_ctes(["model_frame"], """
  SELECT 'light' AS feature, CAST(k AS INTEGER) AS class, level, CAST(cnt AS BIGINT) AS count,
         CASE WHEN tot > 0 THEN CAST(cnt AS DOUBLE) / tot ELSE 0.0 END AS proportion
  FROM (SELECT k, level, count(m.label) FILTER (WHERE m.label = k) AS cnt
        FROM (SELECT DISTINCT CAST(light AS VARCHAR) AS level FROM model_frame
              WHERE light IS NOT NULL AND label IN (0, 1, 2)) lv
        CROSS JOIN (VALUES (0), (1), (2)) c(k)
        LEFT JOIN model_frame m ON CAST(m.light AS VARCHAR) = lv.level AND m.label = k
        GROUP BY k, level) g
  JOIN (SELECT label AS k, count(*) AS tot FROM model_frame
        WHERE light IS NOT NULL GROUP BY label
        UNION ALL SELECT k, 0 FROM (VALUES (0), (1), (2)) c(k)
        WHERE k NOT IN (SELECT label FROM model_frame WHERE light IS NOT NULL)) t USING (k)"""))
def q_within_class(spark, d):
    return D.within_class_dist(I.model_frame(spark, d), "light")


@register("within_class_hist", with_ctes(["model_frame"], """
  SELECT 'speed_limit' AS feature, CAST(c.k AS INTEGER) AS class, CAST(e.i AS INTEGER) AS bin, e.lft AS "left",
         e.rgt AS "right", CAST(coalesce(h.n, 0) AS BIGINT) AS count,
         round(CASE WHEN coalesce(t.tot, 0) > 0 THEN coalesce(h.n, 0) / (t.tot * (e.rgt - e.lft)) ELSE 0.0 END, 9) AS density
  FROM (SELECT i, CAST(i AS DOUBLE) * ((hi - lo) / 20) + lo AS lft,
               CASE WHEN i + 1 = 20 THEN hi ELSE CAST(i + 1 AS DOUBLE) * ((hi - lo) / 20) + lo END AS rgt
        FROM range(20) r(i),
             (SELECT min(CAST(speed_limit AS DOUBLE)) AS lo, max(CAST(speed_limit AS DOUBLE)) AS hi
              FROM model_frame) mm) e
  CROSS JOIN (VALUES (0), (1), (2)) c(k)
  LEFT JOIN (SELECT label AS k, b AS i, count(*) AS n
             FROM (SELECT label, CASE WHEN x = hi THEN 19
                                      ELSE (SELECT count(*) FROM range(21) r(j)
                                            WHERE x >= CAST(j AS DOUBLE) * ((hi - lo) / 20) + lo) - 1 END AS b
                   FROM (SELECT label, CAST(speed_limit AS DOUBLE) AS x FROM model_frame) m,
                        (SELECT min(CAST(speed_limit AS DOUBLE)) AS lo,
                                max(CAST(speed_limit AS DOUBLE)) AS hi FROM model_frame) mm) z
             GROUP BY 1, 2) h ON h.k = c.k AND h.i = e.i
  LEFT JOIN (SELECT label AS k, count(*) AS tot FROM model_frame GROUP BY 1) t ON t.k = c.k"""))
def q_within_hist(spark, d):
    return D.within_class_hist(I.model_frame(spark, d), "speed_limit")
