"""Descriptive tables: class summary, crosstabs, pivots, association, ranks.

Shape of every plan here: one scan, one partial+final hash aggregate (or an
unpivot ``Expand`` feeding a partial aggregate, so the multiplied rows are
never shuffled), then arithmetic over a result that is bounded by the number
of (feature, level, class) cells - never by the row count.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..presets import CLASS_NAMES, DAY_ORDER, MONTH_ABBR, SEASON_ORDER
from ..session import write_once

R9 = 9  # decimals kept for floats whose summation order differs between engines
QUARTILES = (0.25, 0.5, 0.75)


def _lit_table(spark, rows: list[tuple], names: list[str]) -> DataFrame:
    """Tiny literal table (domains, orders) built from an inline array."""
    structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def unpivot_str(df: DataFrame, columns: list[str], name: str = "feature",
                value: str = "level", keep: list[str] = ()) -> DataFrame:
    """Long (feature, level-as-string) form: one ``Expand``, no shuffle."""
    return df.select(*keep, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        list(keep), columns, name, value)


# --- C4 ---------------------------------------------------------------------

def class_summary(df: DataFrame, class_col: str = "severity",
                  order: tuple[str, ...] = CLASS_NAMES) -> DataFrame:
    """Count and % of *all* rows per class in fixed order; absent class -> 0.

    One global aggregate of conditional counts (partial per task, a single
    final merge), then ``stack`` - no join, no shuffle of rows.
    """
    c = F.col(class_col)
    agg = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count_if(c == v).alias(f"__c{i}") for i, v in enumerate(order)])
    stacked = agg.select("__n", F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(v).alias(class_col),
                 F.col(f"__c{i}").alias("count")) for i, v in enumerate(order)])))
    return stacked.select(
        "position", class_col, F.col("count").cast("bigint").alias("count"),
        F.when(F.col("__n") > 0, F.col("count") / F.col("__n") * 100).otherwise(F.lit(0.0))
         .alias("percent"))


# --- C5 ---------------------------------------------------------------------

def numeric_summary(df: DataFrame, columns: list[str], approx: bool = False,
                    accuracy: int = 10_000) -> DataFrame:
    """count, mean, sample std, min, 25/50/75 % (linear), max per column; a column without
    values has count 0 and nulls.

    Exact, also for continuous columns: the rows of every distinct (column, value) are counted,
    ranged running totals say which positions a value holds, and each percentile takes the
    values at its two positions, so no task holds more than a range of a column's values.
    ``approx=True`` takes ``percentile_approx`` in one pass instead."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], columns, "column", "value").where(F.col("value").isNotNull())
    v = F.col("value")
    if approx:
        found = long.groupBy("column").agg(
            F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
            F.percentile_approx(v, list(QUARTILES), accuracy).alias("__q"), F.max(v).alias("max"))
    else:
        found = _exact_summary(long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    every = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, columns))).alias("column"))
    out = every.join(found, "column", "left")   # one row a column
    return out.select(
        "column", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"), F.round("mean", R9).alias("mean"),
        F.round("std", R9).alias("std"), "min", *[F.col("__q")[i].alias(f"p{round(100 * q)}") for i, q in enumerate(QUARTILES)], "max")


def _exact_summary(counted: DataFrame) -> DataFrame:
    """Moments and quartiles of a table of ``column, value, n``, one row a distinct value."""
    from .sampling import running_totals

    v, n = F.col("value"), F.col("n")
    placed = running_totals(counted.withColumn("s", v * n), "value", ["n", "s"], by=["column"], total_suffix="_all")
    mean, last = F.col("s_all") / F.col("n_all"), F.col("n_all") - 1
    at = []
    for i, q in enumerate(QUARTILES):   # positions count from 0; a value holds cum_n - n .. cum_n - 1
        place = F.lit(q) * last
        at += [F.max(F.when((F.col("cum_n") - n <= end) & (end < F.col("cum_n")), v)).alias(f"__{side}{i}")
               for side, end in (("lo", F.floor(place)), ("hi", F.ceil(place)))]
    g = placed.groupBy("column").agg(
        F.max("n_all").alias("count"), F.max(mean).alias("mean"), F.sum(n * (v - mean) * (v - mean)).alias("__sq"),
        F.min(v).alias("min"), F.max(v).alias("max"), *at)
    quartiles = []
    for i, q in enumerate(QUARTILES):
        lo, hi, place = F.col(f"__lo{i}"), F.col(f"__hi{i}"), F.lit(q) * (F.col("count") - 1)
        # equal ends are taken as they are: a value times its weights need not add up to it
        quartiles.append(F.when(lo == hi, lo).otherwise(lo * (F.ceil(place) - place) + hi * (place - F.floor(place))))
    return g.select("column", "count", "mean", F.when(F.col("count") > 1, F.sqrt(F.col("__sq") / (F.col("count") - 1))).alias("std"),
                    "min", F.array(*quartiles).alias("__q"), "max")


# --- C6 ---------------------------------------------------------------------

def category_by_class(df: DataFrame, features: list[str], class_col: str = "severity",
                      classes: tuple[str, ...] = CLASS_NAMES) -> DataFrame:
    """Per (feature, level): count, % of all rows, per-class count and share.

    Single pass for all features: unpivot -> one group-by with conditional
    counts, stored.  Null levels and null classes drop out of the crosstab but stay in
    the denominator (all rows): a second aggregate of the stored cells, one row a
    feature, so the cells of a feature of many levels stay spread over tasks.
    """
    long = unpivot_str(df, features, keep=[class_col])
    c = F.col(class_col)
    cells = write_once(long.groupBy("feature", "level").agg(
        F.count(F.lit(1)).alias("__all"),
        *[F.count_if(c == v).alias(f"{v.lower()}_count") for v in classes]), "cells")
    totals = cells.groupBy("feature").agg(F.sum("__all").alias("__n"))
    cnt = sum((F.col(f"{v.lower()}_count") for v in classes), F.lit(0))
    g = cells.join(F.broadcast(totals), "feature").withColumn("count", cnt).where(
        F.col("level").isNotNull() & (F.col("count") > 0))
    cols = [F.col("feature"), F.col("level"), F.col("count").cast("bigint").alias("count"),
            (F.col("count") / F.col("__n") * 100).alias("percent_of_cleaned_rows")]
    for v in classes:
        k = f"{v.lower()}_count"
        cols += [F.col(k).cast("bigint").alias(k),
                 F.when(F.col("count") > 0, F.col(k) / F.col("count") * 100)
                  .otherwise(F.lit(0.0)).alias(f"{v.lower()}_share_percent")]
    return g.select(*cols)


# --- C7 ---------------------------------------------------------------------

def composition(df: DataFrame, feature: str, order: list, class_col: str = "severity",
                classes: tuple[str, ...] = CLASS_NAMES) -> DataFrame:
    """Row-normalised class % per level over a requested level order, with n.

    Levels in ``order`` with no rows get n = 0 and null shares.
    """
    c = F.col(class_col)
    lvl = F.col(feature).cast("string")
    wanted = [str(v) for v in order]
    g = (df.where(lvl.isin(*wanted) & c.isin(*classes)).groupBy(lvl.alias("level"))
           .agg(*[F.count_if(c == v).alias(f"__{i}") for i, v in enumerate(classes)]))
    dom = _lit_table(df.sparkSession, [(i, str(v)) for i, v in enumerate(order)],
                     ["position", "level"])
    j = dom.join(F.broadcast(g), "level", "left")
    n = sum((F.coalesce(F.col(f"__{i}"), F.lit(0)) for i in range(len(classes))), F.lit(0))
    j = j.withColumn("n", n.cast("bigint"))
    cols = [F.lit(feature).alias("feature"), "position", "level", "n"]
    for i, v in enumerate(classes):
        cols.append(F.when(F.col("n") > 0, F.coalesce(F.col(f"__{i}"), F.lit(0)) / F.col("n") * 100)
                    .alias(f"{v.lower()}_percent"))
    return j.select(*cols)


# --- C8 ---------------------------------------------------------------------

def weekday_hour_pivot(df: DataFrame, day_col: str = "day_of_week", hour_col: str = "hour",
                       day_order: tuple[str, ...] = DAY_ORDER) -> DataFrame:
    """Weekday x hour counts, dense 7 x 24, zero-filled.

    Pivot with fixed values = 24 conditional counts in one hash aggregate;
    the 7-row weekday domain is a broadcast left join.
    """
    h = F.col(hour_col)
    g = df.where(F.col(day_col).isin(*day_order) & h.between(0, 23)).groupBy(
        F.col(day_col).alias("__day")).agg(*[F.count_if(h == k).alias(f"h{k}") for k in range(24)])
    dom = _lit_table(df.sparkSession, [(i, d) for i, d in enumerate(day_order)],
                     ["position", day_col])
    j = dom.join(F.broadcast(g), dom[day_col] == g["__day"], "left")
    return j.select("position", day_col,
                    *[F.coalesce(F.col(f"h{k}"), F.lit(0)).cast("bigint").alias(f"h{k}")
                      for k in range(24)])


# --- C9 ---------------------------------------------------------------------

def temporal_counts(df: DataFrame, month_col: str = "month", season_col: str = "season",
                    day_col: str = "day_of_week", hour_col: str = "hour") -> DataFrame:
    """Counts by month, season, weekday and hour in fixed order, zero-filled.

    ``GROUPING SETS`` (one Expand feeding a partial aggregate) + a 47-row
    domain table.
    """
    dims = [("month", month_col, list(MONTH_ABBR)), ("season", season_col, list(SEASON_ORDER)),
            ("weekday", day_col, list(DAY_ORDER)), ("hour", hour_col, [str(h) for h in range(24)])]
    long = df.select(*[F.col(c).cast("string").alias(d) for d, c, _ in dims]).unpivot(
        [], [d for d, _, _ in dims], "dimension", "level")
    in_domain = None
    for d, _, vals in dims:
        cond = (F.col("dimension") == d) & F.col("level").isin(*vals)
        in_domain = cond if in_domain is None else (in_domain | cond)
    # only domain levels survive, so the broadcast side has at most 47 rows
    g = long.where(in_domain).groupBy("dimension", "level").agg(F.count(F.lit(1)).alias("__n"))
    dom = _lit_table(df.sparkSession,
                     [(d, i, v) for d, _, vals in dims for i, v in enumerate(vals)],
                     ["dimension", "position", "level"])
    j = dom.join(F.broadcast(g), ["dimension", "level"], "left")
    return j.select("dimension", "position", "level",
                    F.coalesce("__n", F.lit(0)).cast("bigint").alias("count"))


# --- C10 / C11 --------------------------------------------------------------

def _cramers_from_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Bias-corrected Cramer's V per ``keys`` group from (x, y, nij) cells."""
    w_x = Window.partitionBy(*keys, "x")
    w_y = Window.partitionBy(*keys, "y")
    cells = cells.select(*keys, "x", "y", "nij", F.sum("nij").over(w_x).alias("ai"),
                         F.sum("nij").over(w_y).alias("bj"))
    s = cells.groupBy(*keys).agg(
        F.sum(F.col("nij").cast("double") * F.col("nij") / (F.col("ai").cast("double") * F.col("bj")))
         .alias("s"),
        F.sum("nij").cast("double").alias("n"),
        F.count_distinct("x").alias("r"), F.count_distinct("y").alias("c"))
    n, r, c = F.col("n"), F.col("r").cast("double"), F.col("c").cast("double")
    phi2 = (n * (F.col("s") - 1)) / n
    phi2c = F.greatest(F.lit(0.0), phi2 - ((c - 1) * (r - 1)) / (n - 1))
    rc = r - ((r - 1) * (r - 1)) / (n - 1)
    cc = c - ((c - 1) * (c - 1)) / (n - 1)
    den = F.least(cc - 1, rc - 1)
    v = (F.when((n == 0) | (r < 2) | (c < 2), F.lit(0.0))
         .when(den > 0, F.sqrt(phi2c / den)).otherwise(F.lit(0.0)))
    return s.select(*keys, F.round(v, R9).alias("cramers_v"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """One-row frame with the bias-corrected Cramer's V of two columns."""
    cells = (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
               .groupBy(F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y"))
               .agg(F.count(F.lit(1)).alias("nij")))
    out = _cramers_from_cells(cells, [])   # global aggregate: one row even if empty
    return out.select(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                      F.coalesce("cramers_v", F.lit(0.0)).alias("cramers_v"))


def association_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """Cramer's V for every feature pair, long form, symmetric, diagonal 1.

    Rows are first compacted to distinct feature combinations with a
    multiplicity (at scale the combinations saturate while rows keep growing);
    each combination then becomes one line per pair, and one keyed partial
    aggregate gives all contingency tables.
    """
    spark = df.sparkSession
    pairs = list(combinations(features, 2))
    compact = df.groupBy(*[F.col(f).cast("string").alias(f) for f in features]).agg(F.count(F.lit(1)).alias("__w"))
    # few bytes, which AQE would fold into few tasks, become many lines
    compact = compact.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *features)
    number = _lit_table(spark, [(k, a, b) for k, (a, b) in enumerate(pairs)], ["pair", "feature_a", "feature_b"])
    cells = (compact.select("__w", F.inline(F.array(*[
        F.struct(F.lit(k).alias("pair"), F.col(a).alias("x"), F.col(b).alias("y")) for k, (a, b) in enumerate(pairs)])))
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
        .groupBy("pair", "x", "y").agg(F.sum("__w").alias("nij")))
    # one row per pair on both sides
    v = number.join(F.broadcast(_cramers_from_cells(cells, ["pair"])), "pair", "left").drop("pair")
    cv = F.coalesce("cramers_v", F.lit(0.0)).alias("cramers_v")
    # both orientations from the same row: the pair computation runs once
    both = v.select(F.inline(F.array(
        F.struct(F.col("feature_a").alias("feature_a"), F.col("feature_b").alias("feature_b"), cv),
        F.struct(F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), cv))))
    diag = _lit_table(spark, [(f, f, 1.0) for f in features],
                      ["feature_a", "feature_b", "cramers_v"])
    return both.unionByName(diag)


# --- C12 / C13 --------------------------------------------------------------

def weighted_corr(df: DataFrame, pairs: list[tuple[str, str]], weight: str,
                  means: dict[str, float] | None = None) -> DataFrame:
    """Pearson correlation of column pairs over rows with multiplicities,
    centred: the means (one small pass unless the caller knows them), then
    the centred cross products in one aggregate."""
    w = F.col(weight)
    cols = sorted({c for p in pairs for c in p})
    if means is None:
        row = df.agg(F.sum(w).alias("__n"), *[F.sum(w * F.col(c)).alias(f"__s_{c}") for c in cols]).first()
        means = {c: row[f"__s_{c}"] / float(row["__n"]) for c in cols}
    mu = means
    d = {c: F.col(c) - F.lit(mu[c]) for c in cols}
    aggs = []
    for a, b in pairs:
        aggs += [F.sum(w * d[a] * d[b]).alias(f"{a}|{b}|ab"),
                 F.sum(w * d[a] * d[a]).alias(f"{a}|{b}|aa"),
                 F.sum(w * d[b] * d[b]).alias(f"{a}|{b}|bb")]
    row = df.agg(*aggs)
    return row.select(*[
        (F.col(f"`{a}|{b}|ab`") / F.sqrt(F.col(f"`{a}|{b}|aa`") * F.col(f"`{a}|{b}|bb`")))
        .alias(f"{a}|{b}") for a, b in pairs])


def rank_table(df: DataFrame, columns: list[str], weight: str | None = None) -> DataFrame:
    """``(column, value, rank)``: midranks of every column.

    Value counts of all columns come from one unpivot + aggregate, their
    running sums by column from `sampling.running_totals`, whose tasks stay
    bounded for continuous columns too.
    """
    from .sampling import running_totals

    w = F.col(weight) if weight else F.lit(1)
    long = df.select(w.alias("__w"), *columns).unpivot(["__w"], columns, "column", "value") \
        .where(F.col("value").isNotNull())
    vc = long.groupBy("column", "value").agg(F.sum("__w").alias("__n"))
    return running_totals(vc, "value", ["__n"], by=["column"]).select(
        "column", F.col("value").cast("double").alias("value"),
        (F.col("cum___n") - (F.col("__n") - 1) / 2.0).alias("rank"))


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """Spearman (average-rank Pearson) for all column pairs, long form.

    Complete cases over ``columns`` first (equals pandas' pairwise rule when
    there are no nulls).  Plan: compact to distinct value combinations with
    a multiplicity (one aggregate, stored; coded columns shrink millions of rows
    to a few thousand), midranks of all columns from one stored rank table, and a
    weighted, centred correlation.  The stored table's size decides whether
    its joins broadcast; beyond that a value's combinations are a skewed join side
    that AQE splits.
    """
    base = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    pairs = list(combinations(columns, 2))
    compact = write_once(base.groupBy(*columns).agg(F.count(F.lit(1)).alias("__w")), "combinations")
    lut = write_once(rank_table(compact, columns, "__w"), "ranks")
    n = compact.agg(F.sum("__w")).first()[0]
    ranked = compact
    for c in columns:
        ranked = ranked.join(lut.where(F.col("column") == c).select(
            F.col("value").alias(c), F.col("rank").alias(f"__r_{c}")), c, "left")
    rk = ranked.select("__w", *[F.col(f"__r_{c}").alias(c) for c in columns])
    # midranks of N rows always average (N + 1) / 2: the centring pass is free
    means = {c: (n + 1) / 2.0 for c in columns} if n else None
    return _pairs_long(weighted_corr(rk, pairs, "__w", means), columns, "spearman")


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation for all numeric column pairs, in one aggregate."""
    base = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    row = base.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in combinations(columns, 2)])
    return _pairs_long(row, columns, "pearson")


def _pairs_long(row: DataFrame, columns: list[str], name: str) -> DataFrame:
    items = []
    for a, b in combinations(columns, 2):
        v = F.round(F.col(f"`{a}|{b}`"), R9)
        items += [F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), v.alias(name)),
                  F.struct(F.lit(b).alias("column_a"), F.lit(a).alias("column_b"), v.alias(name))]
    items += [F.struct(F.lit(c).alias("column_a"), F.lit(c).alias("column_b"),
                       F.lit(1.0).alias(name)) for c in columns]
    return row.select(F.inline(F.array(*items)))


# --- C14 / C15 --------------------------------------------------------------

def within_class_dist(df: DataFrame, feature: str, class_col: str = "label",
                      classes: tuple = (0, 1, 2)) -> DataFrame:
    """Per class, the share of each level (all classes shown, 0 if absent).

    One aggregate to per-level class counts (dense by construction, no grid
    join); the class totals are one scalar subquery of the same plan (a
    one-row aggregate: no driver round trip, no cross join, and AQE reuses
    the input's exchange for it).
    """
    lvl = F.col(feature).cast("string")
    c = F.col(class_col)
    base = df.where(c.isin(*classes) & lvl.isNotNull())
    tot = base.agg(F.struct(*[F.count_if(c == k).alias(f"t{i}")
                              for i, k in enumerate(classes)])).scalar()
    totals = [tot.getField(f"t{i}") for i in range(len(classes))]
    g = base.groupBy(lvl.alias("level")).agg(
        *[F.count_if(c == k).alias(f"__c{i}") for i, k in enumerate(classes)])
    long = g.select("level", F.inline(F.array(*[
        F.struct(F.lit(k).alias("class"), F.col(f"__c{i}").alias("count"),
                 totals[i].alias("total")) for i, k in enumerate(classes)])))
    return long.select(
        F.lit(feature).alias("feature"), F.col("class").cast("int").alias("class"), "level",
        F.col("count").cast("bigint").alias("count"),
        F.when(F.col("total") > 0, F.col("count") / F.col("total")).otherwise(F.lit(0.0))
         .alias("proportion"))


def number(c: str | Column) -> Column:
    """The value as a double; what is not a number is null."""
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


def histogram_edges(df: DataFrame, column: str, bins: int = 20) -> list[float]:
    """Common equal-width edges over the finite values (numpy rule).

    Collects two scalars.  Constant column -> one bin [v - .5, v + .5];
    no finite value -> error.
    """
    v = number(column)
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(math.inf))
    row = df.where(finite).agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    return equal_edges(row["lo"], row["hi"], bins)


def equal_edges(lo: float | None, hi: float | None, bins: int) -> list[float]:
    if lo is None:
        raise ValueError("bins need a finite value; there is none")
    lo, hi = float(lo), float(hi)
    if lo == hi:
        return [lo - 0.5, hi + 0.5]
    step = (hi - lo) / bins
    return [*(i * step + lo for i in range(bins)), hi]


def bin_index(c: str | Column, edges: list[float]) -> Column:
    """Bin of a value: (#edges <= x) - 1, the maximum in the last bin; null
    outside [edges[0], edges[-1]], for non-finite values and for what is not a number."""
    x = number(c)
    n = len(edges) - 1
    k = sum(((x >= F.lit(e)).cast("int") for e in edges), F.lit(0)) - 1
    k = F.when(x == F.lit(edges[-1]), F.lit(n - 1)).otherwise(k)
    return F.when((x >= F.lit(edges[0])) & (x <= F.lit(edges[-1])) & ~F.isnan(x), k)


def within_class_hist(df: DataFrame, feature: str, class_col: str = "label",
                      classes: tuple = (0, 1, 2), bins: int = 20) -> DataFrame:
    """Per-class density over common equal-width bins (per-class norm)."""
    edges = histogram_edges(df, feature, bins)
    nb = len(edges) - 1
    b = bin_index(feature, edges)
    g = (df.where(F.col(class_col).isin(*classes)).select(F.col(class_col).alias("class"),
                                                          b.alias("bin"))
           .where(F.col("bin").isNotNull()).groupBy("class", "bin")
           .agg(F.count(F.lit(1)).alias("count")))
    dom = _lit_table(df.sparkSession,
                     [(c, i, edges[i], edges[i + 1]) for c in classes for i in range(nb)],
                     ["class", "bin", "left", "right"])
    j = dom.join(F.broadcast(g), ["class", "bin"], "left").withColumn(
        "count", F.coalesce("count", F.lit(0)).cast("bigint"))
    tot = F.sum("count").over(Window.partitionBy("class"))
    j = j.select("*", tot.alias("__t"))
    dens = F.when(F.col("__t") > 0, F.col("count") / (F.col("__t") * (F.col("right") - F.col("left"))))
    return j.select(F.lit(feature).alias("feature"), F.col("class").cast("int").alias("class"),
                    "bin", "left", "right", "count",
                    F.round(F.coalesce(dens, F.lit(0.0)), R9).alias("density"))
