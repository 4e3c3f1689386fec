"""Queries for sources/cleaning/scalar functions."""

from __future__ import annotations


from ..functions import expressions as X
from ..operators.clean import target_encode
from ..presets import CATEGORY_LABELS, DAY_MAP, FIRST_ROAD_CLASS_MAP, SECOND_ROAD_CLASS_MAP, \
    URBAN_RURAL_MAP
from ..sources.csv import normalise_null_tokens
from . import inputs as I
from .oracle_base import with_ctes
from .registry import register

L = I.L


@register("dedup_substantive", with_ctes(["dedup"], "SELECT * FROM dedup"))
def q_dedup(spark, d):
    return I.dedup(spark, d)


@register("contract_project", with_ctes(["dedup"], """
  SELECT row_index, severity_code, date_str, time_str, day_of_week, first_road_class,
         second_road_class, road_type, speed_limit, crossing, light, area FROM dedup"""))
def q_contract(spark, d):
    from ..operators.clean import contract_project
    return contract_project(I.dedup(spark, d), L.drop_columns, keep=(L.row_id,))


@register("complete_cases", with_ctes(["retained"], "SELECT * FROM retained"))
def q_complete(spark, d):
    return I.retained(spark, d)


@register("prepare_analytical", with_ctes(["analytical"], "SELECT * FROM analytical"))
def q_analytical(spark, d):
    return I.analytical(spark, d)


_NULL_SQL = ", ".join(f"CASE WHEN CAST({c} AS VARCHAR) IN ('', '#N/A', '#N/A N/A', '#NA', "
                      "'-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', "
                      "'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null') THEN NULL "
                      f"ELSE CAST({c} AS VARCHAR) END AS {c}"
                      for c in ("event_type", "props"))


@register("null_tokens", f"SELECT event_id, {_NULL_SQL} FROM events")
def q_null_tokens(spark, d):
    ev = I.table(spark, d, "events").select("event_id", "event_type", "props")
    return normalise_null_tokens(ev, ["event_type", "props"])


@register("target_encode", with_ctes(["clean"], """
  SELECT row_index, severity_code,
         CAST(CASE severity_code WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 END AS INTEGER) AS label
  FROM clean"""))
def q_target(spark, d):
    return target_encode(I.clean(spark, d).select("row_index", "severity_code"), "severity_code")


def _case(col: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in mapping.items())
    return f"CASE {col} {whens} END"


@register("decode_codes", with_ctes(["collisions_raw"], f"""
  SELECT row_index,
    {_case('day_of_week', DAY_MAP)} AS day_label,
    {_case('first_road_class', FIRST_ROAD_CLASS_MAP)} AS first_road_label,
    {_case('second_road_class', SECOND_ROAD_CLASS_MAP)} AS second_road_label,
    {_case('area', URBAN_RURAL_MAP)} AS area_label
  FROM collisions_raw"""))
def q_decode(spark, d):
    r = I.raw(spark, d)
    return r.select("row_index",
                    X.lookup("day_of_week", DAY_MAP).alias("day_label"),
                    X.lookup("first_road_class", FIRST_ROAD_CLASS_MAP).alias("first_road_label"),
                    X.lookup("second_road_class", SECOND_ROAD_CLASS_MAP).alias("second_road_label"),
                    X.lookup("area", URBAN_RURAL_MAP).alias("area_label"))


def _label_sql(col: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN CAST({col} AS VARCHAR) = '{k}' THEN concat(CAST({col} AS VARCHAR), ' — ', '{v}')"
                     for k, v in mapping.items())
    return f"CASE {whens} ELSE CAST({col} AS VARCHAR) END"


_LABEL_COLS = [("day_of_week", "Day_of_Week"), ("first_road_class", "1st_Road_Class"),
               ("second_road_class", "2nd_Road_Class"), ("area", "Urban_or_Rural_Area"),
               ("road_type", "Road_Type")]


@register("category_label", with_ctes(["collisions_raw"], "SELECT row_index, " + ", ".join(
    f"{_label_sql(c, CATEGORY_LABELS[k])} AS {c}_option" for c, k in _LABEL_COLS)
    + " FROM collisions_raw"))
def q_category_label(spark, d):
    r = I.raw(spark, d)
    return r.select("row_index", *[X.category_label(c, CATEGORY_LABELS[k]).alias(f"{c}_option")
                                   for c, k in _LABEL_COLS])


@register("season", with_ctes(["collisions_raw"], """
  SELECT row_index, m AS month,
         CASE WHEN m IN (12, 1, 2) THEN 'Winter' WHEN m IN (3, 4, 5) THEN 'Spring'
              WHEN m IN (6, 7, 8) THEN 'Summer' WHEN m IN (9, 10, 11) THEN 'Fall' END AS season
  FROM (SELECT row_index, CAST(month(try_strptime(date_str, '%d/%m/%Y')) AS INTEGER) AS m
        FROM collisions_raw) t"""))
def q_season(spark, d):
    r = I.raw(spark, d)
    m = X.month_of("date_str").cast("int")
    return r.select("row_index", m.alias("month"), X.season(m).alias("season"))


@register("cyclical_hour", """
  SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour,
         sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos
  FROM events""")
def q_cyclical(spark, d):
    e = I.events_hours(spark, d)
    return e.select("event_id", "hour", X.hour_sin("hour").alias("hour_sin"),
                    X.hour_cos("hour").alias("hour_cos"))


@register("rush_hour", """
  SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour,
         CAST(hour(ts) IN (7, 8, 9, 16, 17, 18) AS INTEGER) AS rush_hour
  FROM events""")
def q_rush(spark, d):
    e = I.events_hours(spark, d)
    return e.select("event_id", "hour", X.rush_hour("hour").alias("rush_hour"))


@register("time_features", with_ctes(["model_frame"], """
  SELECT row_index, "Month", "Season", hour_sin, hour_cos, rush_hour FROM model_frame"""))
def q_time_features(spark, d):
    return I.model_frame(spark, d).select("row_index", "Month", "Season", "hour_sin",
                                          "hour_cos", "rush_hour")


@register("hour_from_cyclical", """
  SELECT event_id, hour,
    CAST((CAST(round_even(((atan2(s, c) % (2 * pi())) + (2 * pi())) % (2 * pi()) * 24 / (2 * pi()), 0) AS INTEGER) % 24 + 24) % 24 AS INTEGER) AS hour_rebuilt
  FROM (SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour,
               sin(2 * pi() * hour(ts) / 24) AS s, cos(2 * pi() * hour(ts) / 24) AS c
        FROM events) t""")
def q_hour_rebuild(spark, d):
    e = I.events_hours(spark, d)
    e = e.select("event_id", "hour", X.hour_sin("hour").alias("s"), X.hour_cos("hour").alias("c"))
    return e.select("event_id", "hour", X.hour_from_cyclical("s", "c").alias("hour_rebuilt"))


@register("sci_notation", with_ctes(["collisions_raw"], """
  SELECT row_index, accident_index,
         coalesce(regexp_matches(accident_index, '(?i)e\\+'), false) AS scientific
  FROM collisions_raw"""))
def q_sci(spark, d):
    return I.raw(spark, d).select("row_index", "accident_index",
                                  X.sci_notation("accident_index").alias("scientific"))


@register("blank_strings", """
  SELECT conv_id, turn,
         coalesce(regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '', false)
           OR coalesce(regexp_replace(role, '^\\s+|\\s+$', '', 'g') = '', false) AS blank
  FROM conversations""")
def q_blank(spark, d):
    c = I.table(spark, d, "conversations")
    return c.select("conv_id", "turn", X.any_blank(["text", "role"]).alias("blank"))


_RAW_SCHEMA = ("row_index bigint, accident_index string, severity_code int, date_str string, "
               "time_str string, day_of_week int, first_road_class int, second_road_class int, "
               "road_type string, speed_limit int, crossing string, light string, area int, "
               "location_e6 bigint, number_of_vehicles int, src_year int")


@register("scan_csv", with_ctes(["collisions_raw"], "SELECT * FROM collisions_raw"))
def q_scan_csv(spark, d):
    """A1 + A2: the raw view written as headered CSV to the shared folder and
    scanned back with an explicit schema and the full null-token set."""
    from pyspark.sql import types as T

    from ..sources.csv import read_raw
    from ..sources.sinks import scratch_path, write_table

    path = write_table(I.raw(spark, d), scratch_path(spark, "csv"), "csv")
    schema = T.StructType.fromDDL(_RAW_SCHEMA)
    return read_raw(spark, path, schema)
