"""Column expressions (JVM-side, codegen-friendly).

Each helper returns a ``Column`` so it composes into one projection and stays
inside whole-stage codegen; none of them needs a UDF.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..presets import (
    LABEL_SEPARATOR,
    MONTH_ABBR,
    RUSH_HOURS,
    SEASON_MAP,
    TARGET_MAP,
)

DATE_FORMAT = "d/M/yyyy"    # accepts 1/2/2014 like the strptime %d/%m/%Y
TIME_FORMAT = "H:m"         # accepts 8:05 like %H:%M; rejects 25:99, 24:00


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def map_literal(mapping: dict) -> Column:
    """``create_map`` literal for a small fixed lookup table."""
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))


def lookup(c: str | Column, mapping: dict) -> Column:
    """Map a value through a small literal table; unmapped -> null (row kept)."""
    return F.try_element_at(map_literal(mapping), col(c))


# --- B6 target encoding ----------------------------------------------------

def target_label(severity: str | Column) -> Column:
    """Source severity code {1,2,3} -> label {0,1,2}; anything else -> null."""
    return lookup(severity, TARGET_MAP).cast("int")


# --- B9 - B12 time features ------------------------------------------------

def parse_date(c: str | Column, strict: bool = False) -> Column:
    return (F.to_date(col(c), DATE_FORMAT) if strict
            else F.try_to_timestamp(col(c), F.lit(DATE_FORMAT)).cast("date"))


def parse_time(c: str | Column, strict: bool = False) -> Column:
    return (F.to_timestamp(col(c), TIME_FORMAT) if strict
            else F.try_to_timestamp(col(c), F.lit(TIME_FORMAT)))


def month_of(date_str: str | Column, strict: bool = False) -> Column:
    return F.month(parse_date(date_str, strict))


def hour_of(time_str: str | Column, strict: bool = False) -> Column:
    return F.hour(parse_time(time_str, strict))


def season(month: str | Column) -> Column:
    """Month number -> Winter / Spring / Summer / Fall."""
    return lookup(month, SEASON_MAP)


def month_abbr(month: str | Column) -> Column:
    return lookup(month, {i + 1: m for i, m in enumerate(MONTH_ABBR)})


def hour_sin(hour: str | Column) -> Column:
    return F.sin(F.lit(2 * math.pi) * col(hour) / 24)


def hour_cos(hour: str | Column) -> Column:
    return F.cos(F.lit(2 * math.pi) * col(hour) / 24)


def rush_hour(hour: str | Column) -> Column:
    """1 if the hour is a rush hour, else 0 (null hour -> 0, like ``isin``)."""
    return F.coalesce(col(hour).isin(*RUSH_HOURS), F.lit(False)).cast("int")


# --- B15 hour reconstruction -----------------------------------------------

def hour_from_cyclical(s: str | Column, c: str | Column) -> Column:
    """Hour from (sin, cos): rint(mod(atan2, 2pi) * 24 / 2pi) mod 24 (half-even)."""
    two_pi = F.lit(2 * math.pi)
    angle = F.pmod(F.atan2(col(s), col(c)), two_pi)
    return F.pmod(F.rint(angle * 24 / two_pi).cast("int"), F.lit(24))


# --- B8 display label ------------------------------------------------------

def category_label(c: str | Column, mapping: dict) -> Column:
    """``"{code} — {label}"`` when the code has a label, else the bare value."""
    text = col(c).cast("string")
    label = lookup(text, {str(k): v for k, v in mapping.items()})
    return F.when(label.isNotNull(), F.concat(text, F.lit(LABEL_SEPARATOR), label)).otherwise(text)


# --- B17 / B18 string predicates -------------------------------------------

def sci_notation(c: str | Column) -> Column:
    """Case-insensitive ``E+`` anywhere; null -> false."""
    return F.coalesce(col(c).cast("string").rlike("(?i)e\\+"), F.lit(False))


def is_blank(c: str | Column) -> Column:
    """Whitespace-only (any Unicode-agnostic \\s run); null is not blank."""
    return F.coalesce(F.regexp_replace(col(c), r"^\s+|\s+$", "") == "", F.lit(False))


def any_blank(columns: list[str]) -> Column:
    if not columns:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [is_blank(c) for c in columns])


# --- E8 / E10 / E11 / F3 decision expressions ------------------------------

def serious_or_worse(y: str | Column) -> Column:
    return col(y).isin(0, 1).cast("int")


def rare_target(y: str | Column) -> Column:
    return (col(y) == 0).cast("int")


def ordinal_probabilities(s: str | Column, f: str | Column) -> tuple[Column, Column, Column]:
    """(P0, P1, P2) from s = P(y <= 1) and f = P(y = 0); crossings meet midway."""
    s_, f_ = col(s), col(f)
    mid = (s_ + f_) / 2
    crossed = f_ > s_
    s2 = F.when(crossed, mid).otherwise(s_)
    f2 = F.when(crossed, mid).otherwise(f_)
    return f2, s2 - f2, 1 - s2


def argmax3(p0: str | Column, p1: str | Column, p2: str | Column) -> Column:
    """Index of the largest of three scores; lowest index wins a tie."""
    a, b, c = col(p0), col(p1), col(p2)
    return (F.when((a >= b) & (a >= c), 0).when(b >= c, 1).otherwise(2)).cast("int")


def threshold_decision(p0: str | Column, p1: str | Column, p2: str | Column,
                       threshold: float | Column) -> Column:
    """Rare class when p0 >= t, otherwise the larger of p1, p2 (p1 on a tie).
    A NaN score reaches no threshold."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (F.when((col(p0) >= t) & ~F.isnan(col(p0)), 0).when(col(p1) >= col(p2), 1).otherwise(2)).cast("int")
