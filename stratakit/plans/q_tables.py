"""The same operators on other driver tables (column names as arguments)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import describe as D
from ..operators import sampling as S
from ..operators.clean import dedup_substantive
from ..presets import DAY_MAP
from . import inputs as I
from .registry import register


@register("dedup_documents", """
  SELECT min(doc_id) AS doc_id, text, lang, source, n_chars
  FROM documents GROUP BY text, lang, source, n_chars""")
def q_dedup_documents(spark, d):
    """B1 on whole texts: ``doc_id`` is the non-substantive column."""
    return dedup_substantive(I.table(spark, d, "documents"), ["doc_id"], keep_min="doc_id")


_DOW = "CASE dayofweek(ts) " + " ".join(
    f"WHEN {k - 1} THEN '{v}'" for k, v in DAY_MAP.items()) + " END"


@register("events_weekday_hour", f"""
  SELECT o.position, o.day_of_week, """ + ", ".join(
    f"CAST(coalesce(g.h{k}, 0) AS BIGINT) AS h{k}" for k in range(24)) + f"""
  FROM (VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'), (4, 'Friday'),
               (5, 'Saturday'), (6, 'Sunday')) o(position, day_of_week)
  LEFT JOIN (SELECT {_DOW} AS day_of_week, """ + ", ".join(
    f"count(*) FILTER (WHERE hour(ts) = {k}) AS h{k}" for k in range(24)) + """
    FROM events GROUP BY 1) g USING (day_of_week)""")
def q_events_weekday_hour(spark, d):
    """C8 on the event stream table: weekday (1 = Sunday) x hour of ``ts``."""
    from ..functions.expressions import lookup
    ev = I.table(spark, d, "events").select(
        lookup(F.dayofweek("ts"), DAY_MAP).alias("day_of_week"), F.hour("ts").alias("hour"))
    return D.weekday_hour_pivot(ev)


@register("labels_cramers_v", """
  SELECT 'quality' AS feature_a, 'toxic' AS feature_b,
         round(CASE WHEN r < 2 OR c < 2 OR least(cc - 1, rc - 1) <= 0 THEN 0.0
                    ELSE sqrt(greatest(0.0, (n * (s - 1)) / n - ((c - 1) * (r - 1)) / (n - 1)) / least(cc - 1, rc - 1)) END, 9) AS cramers_v
  FROM (SELECT *, r - ((r - 1) * (r - 1)) / (n - 1) AS rc, c - ((c - 1) * (c - 1)) / (n - 1) AS cc
        FROM (SELECT sum(CAST(nij AS DOUBLE) * nij / (CAST(ai AS DOUBLE) * bj)) AS s,
                     CAST(sum(nij) AS DOUBLE) AS n, CAST(count(DISTINCT x) AS DOUBLE) AS r,
                     CAST(count(DISTINCT y) AS DOUBLE) AS c
              FROM (SELECT *, sum(nij) OVER (PARTITION BY x) AS ai, sum(nij) OVER (PARTITION BY y) AS bj
                    FROM (SELECT CAST(quality AS VARCHAR) AS x, CAST(toxic AS VARCHAR) AS y, count(*) AS nij
                          FROM labels GROUP BY 1, 2) cells) w) a) b""")
def q_labels_cramers(spark, d):
    """C10 on a natural binary pair (quality x toxic)."""
    return D.cramers_v(I.table(spark, d, "labels"), "quality", "toxic")


@register("labels_balanced_weights", """
  SELECT l.doc_id, l.toxic, CAST(c.n AS DOUBLE) / (c.k * c.n_c) AS weight
  FROM labels l JOIN (SELECT toxic, count(*) AS n_c, sum(count(*)) OVER () AS n, count(*) OVER () AS k
                      FROM labels GROUP BY toxic) c USING (toxic)""")
def q_labels_weights(spark, d):
    """D4 on a natural binary imbalance (toxic)."""
    return S.balanced_weights(I.table(spark, d, "labels").select("doc_id", "toxic"), "toxic")


@register("events_fixed_sample", """
  SELECT event_id, event_type FROM (
    SELECT event_id, event_type,
           row_number() OVER (ORDER BY md5(concat('42:', CAST(event_id AS VARCHAR))), event_id) AS rk
    FROM events) t WHERE rk <= 2000""")
def q_events_sample(spark, d):
    """D8 keyed by ``event_id``."""
    return S.fixed_sample(I.table(spark, d, "events").select("event_id", "event_type"), "event_id", 2000)


@register("events_split", """
  WITH c AS (SELECT event_type, count(*) AS n_c, sum(count(*)) OVER () AS n,
                    CAST(ceil(CAST(0.2 AS DOUBLE) * sum(count(*)) OVER ()) AS BIGINT) AS total
             FROM events GROUP BY event_type),
  q AS (SELECT event_type, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, event_type) <= total - sum(fl) OVER ()
                                     THEN 1 ELSE 0 END AS quota
        FROM (SELECT event_type, (total * n_c) // n AS fl, (total * n_c) % n AS rem, total FROM c) x)
  SELECT e.event_id, e.event_type,
         row_number() OVER (PARTITION BY e.event_type ORDER BY md5(concat('42:', CAST(e.event_id AS VARCHAR))), e.event_id) <= q.quota AS is_test
  FROM events e JOIN q USING (event_type)""")
def q_events_split(spark, d):
    """D1 stratified by a string column (five event types)."""
    return S.stratified_split(I.table(spark, d, "events").select("event_id", "event_type"),
                              "event_type", "event_id")
