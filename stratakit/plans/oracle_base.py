"""DuckDB SQL building blocks for the correctness oracle.

These mirror the fixtures' surrogate views (``collisions_raw``, ``clean``,
``scores``) plus the derived ``analytical`` frame, written as plain ANSI SQL
over the pre-registered driver tables.  ``with_ctes(...)`` prefixes a query
with exactly the CTEs it needs.
"""

from __future__ import annotations

CTES: dict[str, str] = {}
DEPS: dict[str, list[str]] = {}


def _cte(name: str, sql: str, deps: list[str]) -> None:
    CTES[name] = sql.strip()
    DEPS[name] = deps


_cte("base", """
  SELECT CAST('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT),
           year(l_shipdate), month(l_shipdate), day(l_shipdate), l_returnflag, l_linestatus)), 1, 15) AS BIGINT) AS row_index,
         (l_orderkey * 7919 + l_partkey * 104729 + l_suppkey * 1299709 + l_linenumber * 15485863) AS mix,
         l_orderkey, l_partkey, l_suppkey, l_linenumber,
         CAST(l_quantity AS BIGINT) AS qty, l_shipdate, l_returnflag, l_linestatus
  FROM lineitem""", [])

_cte("shaped", """
  SELECT row_index, mix, l_orderkey, l_returnflag, l_linestatus, l_shipdate, l_linenumber, l_suppkey, l_partkey,
         CASE WHEN qty <= 2 THEN 20 WHEN qty <= 30 THEN 30 WHEN qty <= 36 THEN 40
              WHEN qty <= 39 THEN 50 WHEN qty <= 46 THEN 60 ELSE 70 END AS speed_limit,
         CAST(mix % 10007 AS BIGINT) AS u
  FROM base""", ["base"])

_cte("one", """
  SELECT row_index,
    CASE WHEN mix % 3 = 0 THEN concat('2.01E+', CAST(10 + l_orderkey % 4 AS VARCHAR))
         ELSE concat('A', CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) END AS accident_index,
    CAST(CASE WHEN u < CASE WHEN speed_limit >= 60 THEN 400 ELSE 100 END THEN 1
              WHEN u < CASE WHEN l_linestatus = 'O' THEN 2100 ELSE 1500 END THEN 2 ELSE 3 END AS INTEGER) AS severity_code,
    concat(lpad(CAST(day(l_shipdate) AS VARCHAR), 2, '0'), '/', lpad(CAST(month(l_shipdate) AS VARCHAR), 2, '0'), '/', CAST(year(l_shipdate) AS VARCHAR)) AS date_str,
    CASE WHEN mix % 997 = 0 THEN NULL ELSE
      concat(lpad(CAST(mix % 24 AS VARCHAR), 2, '0'), ':', lpad(CAST(mix % 60 AS VARCHAR), 2, '0')) END AS time_str,
    CAST(1 + mix % 7 AS INTEGER) AS day_of_week,
    CAST(1 + l_partkey % 6 AS INTEGER) AS first_road_class,
    CAST(CASE WHEN l_suppkey % 7 = 0 THEN -1 ELSE l_suppkey % 7 END AS INTEGER) AS second_road_class,
    CASE WHEN l_returnflag = 'A' THEN 'Single carriageway' WHEN l_returnflag = 'N' THEN 'Dual carriageway' ELSE 'Roundabout' END AS road_type,
    CAST(speed_limit AS INTEGER) AS speed_limit,
    CASE WHEN mix % 1499 = 0 THEN NULL WHEN mix % 11 < 9 THEN 'No physical crossing' ELSE 'Zebra crossing' END AS crossing,
    CASE WHEN mix % 24 >= 7 AND mix % 24 <= 18 THEN 'Daylight' ELSE 'Dark' END AS light,
    CAST(CASE WHEN l_linestatus = 'O' THEN 2 ELSE 1 END AS INTEGER) AS area,
    CAST(mix % 1000003 AS BIGINT) AS location_e6,
    CAST(1 + mix % 5 AS INTEGER) AS number_of_vehicles,
    CAST(year(l_shipdate) AS INTEGER) AS src_year,
    mix
  FROM shaped""", ["shaped"])

RAW_COLS = ("row_index, accident_index, severity_code, date_str, time_str, day_of_week, "
            "first_road_class, second_road_class, road_type, speed_limit, crossing, light, area, "
            "location_e6, number_of_vehicles, src_year")
SUBSTANTIVE = RAW_COLS.replace("row_index, ", "")
RETAINED = ("row_index, severity_code, date_str, time_str, day_of_week, first_road_class, "
            "second_road_class, road_type, speed_limit, crossing, light, area")

_cte("collisions_raw", f"""
  SELECT {RAW_COLS} FROM one
  UNION ALL
  SELECT row_index + 100000000000000000 AS row_index, {SUBSTANTIVE} FROM one WHERE mix % 43 = 0""",
     ["one"])

# B1: one row per substantive record, smallest row_index kept, column order kept
_cte("dedup", f"""
  SELECT min(row_index) AS row_index, {SUBSTANTIVE}
  FROM collisions_raw GROUP BY {SUBSTANTIVE}""", ["collisions_raw"])

# B1 + B2 + B3
_cte("retained", f"""
  SELECT {RETAINED} FROM dedup WHERE time_str IS NOT NULL AND crossing IS NOT NULL""", ["dedup"])

# fixtures' ``clean`` (all 16 columns)
_cte("clean", f"""
  SELECT {RAW_COLS} FROM dedup WHERE time_str IS NOT NULL AND crossing IS NOT NULL""", ["dedup"])

_cte("parsed", """
  SELECT *, CAST(month(strptime(date_str, '%d/%m/%Y')) AS INTEGER) AS m_,
            CAST(hour(strptime(time_str, '%H:%M')) AS INTEGER) AS h_
  FROM retained""", ["retained"])

_cte("analytical", """
  SELECT row_index,
    CAST(severity_code AS INTEGER) AS severity_score,
    CASE severity_code WHEN 1 THEN 'Fatal' WHEN 2 THEN 'Serious' WHEN 3 THEN 'Slight' END AS severity,
    CASE day_of_week WHEN 1 THEN 'Sunday' WHEN 2 THEN 'Monday' WHEN 3 THEN 'Tuesday'
         WHEN 4 THEN 'Wednesday' WHEN 5 THEN 'Thursday' WHEN 6 THEN 'Friday' WHEN 7 THEN 'Saturday' END AS day_of_week,
    m_ AS month_number,
    CASE m_ WHEN 1 THEN 'Jan' WHEN 2 THEN 'Feb' WHEN 3 THEN 'Mar' WHEN 4 THEN 'Apr' WHEN 5 THEN 'May'
         WHEN 6 THEN 'Jun' WHEN 7 THEN 'Jul' WHEN 8 THEN 'Aug' WHEN 9 THEN 'Sep' WHEN 10 THEN 'Oct'
         WHEN 11 THEN 'Nov' WHEN 12 THEN 'Dec' END AS month,
    CASE WHEN m_ IN (12, 1, 2) THEN 'Winter' WHEN m_ IN (3, 4, 5) THEN 'Spring'
         WHEN m_ IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS season,
    h_ AS hour,
    sin(2 * pi() * h_ / 24) AS hour_sin,
    cos(2 * pi() * h_ / 24) AS hour_cos,
    CASE WHEN h_ IN (7, 8, 9, 16, 17, 18) THEN 'Yes' ELSE 'No' END AS rush_hour,
    CAST(h_ IN (7, 8, 9, 16, 17, 18) AS INTEGER) AS rush_hour_flag,
    CAST(speed_limit AS INTEGER) AS speed_limit,
    CASE first_road_class WHEN 1 THEN 'Motorway' WHEN 2 THEN 'A(M)' WHEN 3 THEN 'A' WHEN 4 THEN 'B'
         WHEN 5 THEN 'C' WHEN 6 THEN 'Unclassified' END AS first_road_class,
    CASE second_road_class WHEN -1 THEN 'No second road' WHEN 1 THEN 'Motorway' WHEN 2 THEN 'A(M)'
         WHEN 3 THEN 'A' WHEN 4 THEN 'B' WHEN 5 THEN 'C' WHEN 6 THEN 'Unclassified' END AS second_road_class,
    road_type,
    CASE area WHEN 1 THEN 'Urban' WHEN 2 THEN 'Rural' WHEN 3 THEN 'Unallocated' END AS urban_rural,
    crossing AS crossing_facilities,
    light AS light_conditions
  FROM parsed""", ["parsed"])

# modelling frame: retained columns + time features + label
_cte("model_frame", """
  SELECT row_index, road_type, light, first_road_class, second_road_class, crossing, day_of_week, area,
         speed_limit, m_ AS "Month",
         CASE WHEN m_ IN (12, 1, 2) THEN 'Winter' WHEN m_ IN (3, 4, 5) THEN 'Spring'
              WHEN m_ IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS "Season",
         sin(2 * pi() * h_ / 24) AS hour_sin, cos(2 * pi() * h_ / 24) AS hour_cos,
         CAST(h_ IN (7, 8, 9, 16, 17, 18) AS INTEGER) AS rush_hour,
         CAST(severity_code - 1 AS INTEGER) AS label
  FROM parsed""", ["parsed"])

_cte("scores", """
  SELECT row_index, CAST(severity_code - 1 AS INTEGER) AS y,
    CAST(a AS DOUBLE) / CAST(a + b + d AS DOUBLE) AS p0,
    CAST(b AS DOUBLE) / CAST(a + b + d AS DOUBLE) AS p1,
    CAST(d AS DOUBLE) / CAST(a + b + d AS DOUBLE) AS p2,
    CAST(e AS DOUBLE) / 1000 AS s_worse, CAST(f AS DOUBLE) / 1000 AS s_rare
  FROM (SELECT row_index, severity_code,
          1 + CASE severity_code WHEN 1 THEN 70 WHEN 2 THEN 12 ELSE 0 END + mod(row_index, 61) AS a,
          60 + CASE severity_code WHEN 2 THEN 120 ELSE 0 END + mod(row_index, 97) AS b,
          130 + mod(row_index, 211) AS d,
          mod(row_index, 997) AS e, mod(row_index, 499) AS f
        FROM clean) t""", ["clean"])

# argmax prediction over the surrogate scores
_cte("scored", """
  SELECT row_index, y, p0, p1, p2,
         CAST(CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS INTEGER) AS pred
  FROM scores""", ["scores"])


def _order(names: list[str]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        for d in DEPS[n]:
            visit(d)
        if n not in seen:
            seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_ctes(needs: list[str], body: str, extra: list[tuple[str, str]] = ()) -> str:
    """``WITH`` clause holding ``needs`` (and their dependencies) + extras."""
    names = _order(needs)
    parts = [f"{n} AS (\n{CTES[n]}\n)" for n in names]
    parts += [f"{n} AS (\n{sql.strip()}\n)" for n, sql in extra]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
