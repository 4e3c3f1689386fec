"""Queries for audits and the dataset contract."""

from __future__ import annotations

from ..operators import audit as A
from ..operators.sampling import split_quotas
from ..presets import (
    AUDIT_METRICS,
    CHECK_AREA,
    CHECK_BLANK,
    CHECK_DATE,
    CHECK_FIRST_ROAD,
    CHECK_SECOND_ROAD,
    CHECK_SEVERITY,
    CHECK_SPEED,
    CHECK_TIME,
    CHECK_WEEKDAY,
    REASON_GEOGRAPHY,
    REASON_IDENTIFIER,
    REASON_OTHER,
    REASON_POST_COLLISION,
    REASON_RETAINED,
)
from . import inputs as I
from .oracle_base import RAW_COLS, with_ctes
from .registry import register

L = I.L

_BLANK = " OR ".join(f"coalesce(regexp_replace({c}, '^\\s+|\\s+$', '', 'g') = '', false)"
                     for c in ("date_str", "time_str", "road_type", "crossing", "light"))
_CHECKS = [
    (CHECK_SEVERITY, "coalesce(severity_code NOT IN (1, 2, 3), true)"),
    (CHECK_WEEKDAY, "coalesce(day_of_week NOT IN (1, 2, 3, 4, 5, 6, 7), true)"),
    (CHECK_FIRST_ROAD, "coalesce(first_road_class NOT IN (1, 2, 3, 4, 5, 6), true)"),
    (CHECK_SECOND_ROAD, "coalesce(second_road_class NOT IN (-1, 1, 2, 3, 4, 5, 6), true)"),
    (CHECK_SPEED, "coalesce(speed_limit <= 0, false)"),
    (CHECK_AREA, "coalesce(area NOT IN (1, 2, 3), true)"),
    (CHECK_DATE, "try_strptime(date_str, '%d/%m/%Y') IS NULL"),
    (CHECK_TIME, "try_strptime(time_str, '%H:%M') IS NULL AND time_str IS NOT NULL"),
    (CHECK_BLANK, _BLANK),
]


@register("domain_checks", with_ctes(["collisions_raw"], " UNION ALL ".join(
    f"SELECT {i} AS position, '{name}' AS \"check\", "
    f"CAST(count(*) FILTER (WHERE {pred}) AS BIGINT) AS invalid_rows FROM collisions_raw"
    for i, (name, pred) in enumerate(_CHECKS))))
def q_domain_checks(spark, d):
    return A.domain_checks(I.raw(spark, d), L)


_RAW_TYPES = [("row_index", "bigint"), ("accident_index", "string"), ("severity_code", "int"),
              ("date_str", "string"), ("time_str", "string"), ("day_of_week", "int"),
              ("first_road_class", "int"), ("second_road_class", "int"), ("road_type", "string"),
              ("speed_limit", "int"), ("crossing", "string"), ("light", "string"), ("area", "int"),
              ("location_e6", "bigint"), ("number_of_vehicles", "int"), ("src_year", "int")]
_REASONS = {"row_index": REASON_IDENTIFIER, "accident_index": REASON_IDENTIFIER,
            "location_e6": REASON_GEOGRAPHY, "number_of_vehicles": REASON_POST_COLLISION,
            "src_year": REASON_OTHER}


def _audit_row(i: int, c: str, t: str) -> str:
    removed = c in _REASONS
    return (f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS dtype, "
            f"CAST(count(*) - count({c}) AS BIGINT) AS missing_count, "
            f"CAST(count(*) - count({c}) AS DOUBLE) / count(*) * 100 AS missing_percent, "
            f"CAST(count(DISTINCT CAST({c} AS VARCHAR)) AS BIGINT) AS unique_nonmissing, "
            f"'{'Removed' if removed else 'Retained'}' AS status, "
            f"'{_REASONS[c] if removed else REASON_RETAINED}' AS reason FROM collisions_raw")


@register("column_audit", with_ctes(["collisions_raw"], " UNION ALL ".join(
    _audit_row(i, c, t) for i, (c, t) in enumerate(_RAW_TYPES))))
def q_column_audit(spark, d):
    return A.column_audit(I.raw(spark, d), L)


_RETAINED_NULL = " OR ".join(f"{c} IS NULL" for c in (
    "severity_code", "date_str", "time_str", "day_of_week", "first_road_class",
    "second_road_class", "road_type", "speed_limit", "crossing", "light", "area"))
_RAW_NULL = " OR ".join(f"{c} IS NULL" for c in RAW_COLS.split(", "))
_DERIVED = 18  # analytical columns of the surrogate besides the row key


@register("audit_summary", with_ctes(["dedup"], f"""
  SELECT position, metric, CAST(value AS BIGINT) AS value FROM (
    SELECT 0 AS position, '{AUDIT_METRICS[0]}' AS metric, r.n AS value FROM r
    UNION ALL SELECT 1, '{AUDIT_METRICS[1]}', 16
    UNION ALL SELECT 2, '{AUDIT_METRICS[2]}', r.n - dd.n FROM r, dd
    UNION ALL SELECT 3, '{AUDIT_METRICS[3]}', dd.n FROM dd
    UNION ALL SELECT 4, '{AUDIT_METRICS[4]}', r.nulls FROM r
    UNION ALL SELECT 5, '{AUDIT_METRICS[5]}', dd.nulls FROM dd
    UNION ALL SELECT 6, '{AUDIT_METRICS[6]}', dd.nulls FROM dd
    UNION ALL SELECT 7, '{AUDIT_METRICS[7]}', dd.n - dd.nulls FROM dd
    UNION ALL SELECT 8, '{AUDIT_METRICS[8]}', 11
    UNION ALL SELECT 9, '{AUDIT_METRICS[9]}', {_DERIVED}
    UNION ALL SELECT 10, '{AUDIT_METRICS[10]}', r.n - r.ids FROM r
    UNION ALL SELECT 11, '{AUDIT_METRICS[11]}', r.sci FROM r) t""", extra=[
    ("r", f"""SELECT count(*) AS n, count(*) FILTER (WHERE {_RAW_NULL}) AS nulls,
                     count(DISTINCT accident_index) + max(CASE WHEN accident_index IS NULL THEN 1 ELSE 0 END) AS ids,
                     count(*) FILTER (WHERE coalesce(regexp_matches(accident_index, '(?i)e\\+'), false)) AS sci
              FROM collisions_raw"""),
    ("dd", f"SELECT count(*) AS n, count(*) FILTER (WHERE {_RETAINED_NULL}) AS nulls FROM dedup")]))
def q_audit_summary(spark, d):
    derived = len(I.analytical(spark, d).columns) - 1
    return A.audit_summary(I.raw(spark, d), L, derived)


@register("repeated_ids", with_ctes(["collisions_raw"], """
  SELECT CAST(count(*) - count(DISTINCT accident_index)
              - max(CASE WHEN accident_index IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS repeated_rows
  FROM collisions_raw"""))
def q_repeated_ids(spark, d):
    return A.repeated_ids(I.raw(spark, d), "accident_index")


# Surrogate contract at sf0.01 (FIXTURES numbers; years from the ship dates).
_COUNTS = {1: 983, 2: 9654, 3: 49255}
_QUOTAS = split_quotas(_COUNTS, 0.2)
SF001_CONTRACT = A.Contract(
    columns=tuple(c for c, _ in _RAW_TYPES), raw_rows=61450, duplicate_rows=1450,
    cleaned_rows=59892, years=(1995, 1996, 1997, 1998, 1999, 2000, 2001), class_counts=_COUNTS,
    train_rows=sum(_COUNTS.values()) - sum(_QUOTAS.values()), test_rows=sum(_QUOTAS.values()),
    test_class_counts=_QUOTAS)


def _fmt(d):
    return ",".join(f"{k}:{v}" for k, v in sorted(d.items()))


_C = SF001_CONTRACT


@register("contract_check", with_ctes(["retained"], f"""
  SELECT seq, "check", expected, actual, coalesce(expected = actual, false) AS ok FROM (
    SELECT 3 AS seq, 'source columns' AS "check", '{",".join(_C.columns)}' AS expected,
           '{",".join(c for c, _ in _RAW_TYPES)}' AS actual
    UNION ALL SELECT 4, 'raw rows', '{_C.raw_rows}', CAST((SELECT count(*) FROM collisions_raw) AS VARCHAR)
    UNION ALL SELECT 5, 'duplicate substantive rows', '{_C.duplicate_rows}',
           CAST((SELECT count(*) FROM collisions_raw) - (SELECT count(*) FROM dedup) AS VARCHAR)
    UNION ALL SELECT 6, 'cleaned rows', '{_C.cleaned_rows}', CAST((SELECT count(*) FROM retained) AS VARCHAR)
    UNION ALL SELECT 7, 'represented years', '{",".join(map(str, _C.years))}',
           (SELECT string_agg(y, ',' ORDER BY y) FROM (SELECT DISTINCT CAST(src_year AS VARCHAR) AS y FROM collisions_raw) t)
    UNION ALL SELECT 8, 'severity class counts', '{_fmt(_C.class_counts)}',
           (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT concat(CAST(severity_code AS VARCHAR), ':', CAST(count(*) AS VARCHAR)) AS s
                                                       FROM retained GROUP BY severity_code) t)
    UNION ALL SELECT 9, 'training rows', '{_C.train_rows}', CAST(n - ceil(CAST(0.2 AS DOUBLE) * n) AS BIGINT)::VARCHAR
           FROM (SELECT count(*) AS n FROM retained) t
    UNION ALL SELECT 10, 'test rows', '{_C.test_rows}', CAST(ceil(CAST(0.2 AS DOUBLE) * n) AS BIGINT)::VARCHAR
           FROM (SELECT count(*) AS n FROM retained) t
    UNION ALL SELECT 11, 'test severity class counts', '{_fmt(_C.test_class_counts)}',
           (SELECT string_agg(concat(CAST(k AS VARCHAR), ':', CAST(q AS VARCHAR)), ',' ORDER BY k) FROM quotas)
  ) t""", extra=[("quotas", """
    SELECT k, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, k) <= total - sum(fl) OVER () THEN 1 ELSE 0 END AS q
    FROM (SELECT k, (total * n_c) // n AS fl, (total * n_c) % n AS rem, total
          FROM (SELECT severity_code AS k, count(*) AS n_c, sum(count(*)) OVER () AS n,
                       CAST(ceil(CAST(0.2 AS DOUBLE) * sum(count(*)) OVER ()) AS BIGINT) AS total
                FROM retained GROUP BY severity_code) a) b""")]))
def q_contract(spark, d):
    return A.contract_table(I.raw(spark, d), L, SF001_CONTRACT)


_FP_TEXT = "concat(" + ", ".join(
    f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), 'N')" for c in RAW_COLS.split(", ")) + ")"


@register("table_fingerprint", with_ctes(["collisions_raw"], f"""
  SELECT CAST(count(*) AS BIGINT) AS rows,
         CAST(coalesce(sum(CAST('0x' || substr(md5({_FP_TEXT}), 1, 16) AS UBIGINT)), 0) AS VARCHAR) AS checksum
  FROM collisions_raw"""))
def q_fingerprint(spark, d):
    return A.table_fingerprint(I.raw(spark, d))
