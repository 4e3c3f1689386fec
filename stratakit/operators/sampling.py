"""Deterministic, partition-independent sampling: exact rank R and D1-D9.

Every random choice is replaced by an order key ``md5('<seed>:<row_id>')``
(ties by ``row_id``), so membership depends only on the data, never on how it
is partitioned, and an SQL engine can reproduce it.

**R - skew-free exact rank.**  A plain ``row_number() over (partition by
label ...)`` sends a whole class (85 % of rows here) to one task.  Instead the
first ``k`` hex digits of the key form a bucket (a prefix, so ordering by
bucket then key is ordering by key).  Per (label, bucket) counts give
cumulative offsets over a table of at most ``labels x 16**k`` rows; the row
number is then computed inside (label, bucket) windows, which are uniformly
small because md5 is uniform.

For threshold tags (split, caps, fixed-size sample) only one bucket per
label straddles the cut: rows in buckets wholly below or above it are tagged
from the offsets alone, and only the straddling buckets are ranked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..presets import RANDOM_STATE
from ..session import write_once

DIGITS = 3            # 16**3 = 4,096 order-key buckets per stratum


def order_key(row_id: str, seed: int = RANDOM_STATE) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")))


def group_counts(df: DataFrame, label: str | None) -> dict:
    """Row count per label (one small aggregate collected to the driver)."""
    if label is None:
        return {None: df.count()}
    return {r[0]: r[1] for r in df.groupBy(label).count().collect()}


def _tag(df: DataFrame, row_id: str, seed: int, digits: int) -> DataFrame:
    h = order_key(row_id, seed)
    return df.withColumn("__h", h).withColumn(
        "__b", F.conv(F.substring("__h", 1, digits), 16, 10).cast("bigint"))


def _bucket_table(tagged: DataFrame, parts: list[str], digits: int = DIGITS) -> DataFrame:
    """``(parts, __b, __n, __off, __cls)``: rows per (stratum, bucket), rows in
    earlier buckets of the stratum, and the stratum size.  At most
    ``strata x 16**digits`` rows, whatever the input size.

    With distinct row ids (`clean.with_row_key`) md5 fills the buckets evenly.
    A null id has no order and fails the job here, inside the plan."""
    bt = tagged.groupBy(*parts, "__b").agg(F.count(F.lit(1)).alias("__n"))
    prev = Window.partitionBy(*parts).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parts)
    bt = bt.select(*parts, "__b", "__n", F.coalesce(F.sum("__n").over(prev), F.lit(0)).alias("__off"),
                   F.sum("__n").over(whole).alias("__cls"))
    missing = F.raise_error(F.lit("a row id is null: ranking needs a unique, non-null row id"))
    return bt.withColumn("__off", F.when(F.col("__b").isNull(), missing).otherwise(F.col("__off")))


def _ranked(parts: list[str], row_id: str) -> Column:
    """Row number inside (stratum, bucket) by (key, row id); a tie on the id
    (a repeated id in the stratum) raises instead of ranking arbitrarily."""
    w = Window.partitionBy(*parts, "__b").orderBy("__h", row_id)
    rn = F.row_number().over(w)
    tie = (rn > 1) & F.lag(row_id).over(w).eqNullSafe(F.col(row_id))
    return F.when(tie, F.raise_error(F.concat(
        F.lit(f"row id {row_id} is not unique: "), F.col(row_id).cast("string")))).otherwise(rn)


def _join_buckets(tagged: DataFrame, bt: DataFrame, parts: list[str]) -> DataFrame:
    """Join rows to their bucket row with null-safe keys: no inferred
    ``isnotnull`` filter is pushed into one consumer of the input only, so
    every consumer keeps the same subplan and the input's shuffles are
    reused; rows with a null stratum are kept (their own stratum).  The bucket
    table has a bounded size and is broadcast, so the rows stay where they are."""
    keys = parts + ["__b"]
    right = F.broadcast(bt.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                                  *[c for c in bt.columns if c not in keys]))
    cond = None
    for k in keys:
        e = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = e if cond is None else (cond & e)
    return tagged.join(right, cond).drop(*[f"__r_{k}" for k in keys])


def _strata(bt: DataFrame, parts: list[str]) -> DataFrame:
    """One row per stratum with its size ``n_c`` (from the bucket table)."""
    return bt.select(*parts, F.col("__cls").alias("n_c")).distinct()


def _stratum(df: DataFrame, label: str | None) -> tuple[DataFrame, list[str]]:
    """Unstratified ranking is one constant stratum (keeps every join keyed)."""
    if label:
        return df, [label]
    return df.withColumn("__all", F.lit(0)), ["__all"]


def exact_rank(df: DataFrame, row_id: str, label: str | None = None, seed: int = RANDOM_STATE,
               out: str = "rank", digits: int = DIGITS) -> DataFrame:
    """1-based rank of every row by (md5 key, row_id) within ``label``; the
    window's shuffle is the only one of the rows."""
    df, parts = _stratum(df, label)
    tagged = _tag(df, row_id, seed, digits)
    bt = _bucket_table(tagged, parts, digits)
    joined = _join_buckets(tagged, bt.drop("__n"), parts)
    ranked = joined.withColumn(out, F.col("__off") + _ranked(parts, row_id))
    return ranked.drop("__h", "__b", "__off", "__cls", *([] if label else ["__all"]))


def rank_at_most(df: DataFrame, row_id: str, label: str | None, quota_fn,
                 seed: int = RANDOM_STATE, out: str = "selected", digits: int = DIGITS
                 ) -> DataFrame:
    """Tag ``out`` = (rank within stratum <= quota of the stratum).

    ``quota_fn`` adds ``__q`` to the per-stratum table ``(stratum, n_c)``
    (row-preserving: expressions or windows over that tiny table).  It runs
    inside the plan, from the bucket table - no driver round trip and no
    extra pass.  Buckets wholly below or above the quota are decided from
    their offsets; only the one straddling bucket per stratum is ranked by a
    window.
    """
    df, parts = _stratum(df, label)
    tagged = _tag(df, row_id, seed, digits)
    bt = _bucket_table(tagged, parts, digits)
    quotas = quota_fn(_strata(bt, parts)).select(*parts, "__q")
    qr = quotas.select(*[F.col(k).alias(f"__r_{k}") for k in parts], "__q")
    qcond = None
    for k in parts:
        e = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        qcond = e if qcond is None else (qcond & e)
    bq = bt.join(qr, qcond, "left").drop(*[f"__r_{k}" for k in parts]) \
        .withColumn("__q", F.coalesce(F.col("__q"), F.col("__cls")))
    joined = _join_buckets(tagged, bq.drop("__cls"), parts)
    below = F.col("__off") + F.col("__n") <= F.col("__q")     # bucket wholly selected
    above = F.col("__off") >= F.col("__q")                     # bucket wholly excluded
    decided = joined.where(below | above).withColumn(out, below)
    edge = joined.where(~(below | above))
    ranked = edge.withColumn(out, F.col("__off") + _ranked(parts, row_id) <= F.col("__q"))
    drop = ["__h", "__b", "__off", "__n", "__q"] + ([] if label else ["__all"])
    return decided.drop(*drop).unionByName(ranked.drop(*drop))


# --- D1 ---------------------------------------------------------------------

def split_quotas(counts: dict, test_size: float = 0.2) -> dict:
    """Per-class test counts: total ``ceil(test_size * n)`` (float, as the
    study computes it), shares by largest remainder, ties to the lower class."""
    n = sum(counts.values())
    total = math.ceil(test_size * n)
    labels = sorted(counts)
    floors = {c: (total * counts[c]) // n for c in labels}
    rems = sorted(labels, key=lambda c: (-((total * counts[c]) % n), c))
    extra = total - sum(floors.values())
    for c in rems[:extra]:
        floors[c] += 1
    return floors


def split_quota_table(strata: DataFrame, label: str, test_size: float = 0.2) -> DataFrame:
    """``split_quotas`` as a plan over the (tiny) per-class table: total
    ``ceil(test_size * n)`` in double arithmetic, integer floors, the
    remainder to the largest fractional parts, ties to the lower class."""
    whole = Window.partitionBy()
    t = strata.select(label, "n_c", F.sum("n_c").over(whole).alias("__nt"))
    t = t.withColumn("__t", F.ceil(F.lit(float(test_size)) * F.col("__nt")).cast("bigint"))
    product = "CAST(__t AS DECIMAL(19, 0)) * CAST(n_c AS DECIMAL(19, 0))"  # beyond 64 bits from 10^10 rows on
    t = t.withColumn("__fl", F.expr(f"({product}) div CAST(__nt AS DECIMAL(19, 0))")) \
         .withColumn("__rem", F.expr(f"({product}) % CAST(__nt AS DECIMAL(19, 0))"))
    t = t.withColumn("__extra", F.col("__t") - F.sum("__fl").over(whole)) \
         .withColumn("__r", F.row_number().over(Window.orderBy(F.desc("__rem"), F.asc(label))))
    return t.withColumn("__q", F.col("__fl") + (F.col("__r") <= F.col("__extra")).cast("bigint"))


def stratified_split(df: DataFrame, label: str, row_id: str, test_size: float = 0.2,
                     seed: int = RANDOM_STATE, out: str = "is_test", digits: int = DIGITS
                     ) -> DataFrame:
    """Tag rows with ``is_test``; exact per-class test counts."""
    return rank_at_most(df, row_id, label, lambda st: split_quota_table(st, label, test_size),
                        seed, out, digits)


def split_rule(df: DataFrame, label: str, row_id: str, test_size: float = 0.2,
               seed: int = RANDOM_STATE, digits: int = DIGITS) -> Column:
    """`stratified_split`'s tag as an expression on a row: its order key lies at or below its class's bound.
    The driver gets one bound a class, the key of the class's last test row or, where the cut falls
    between two buckets, the bucket behind it.  Only the buckets that straddle a cut are ranked."""
    tagged = _tag(df, row_id, seed, digits)
    bt = _bucket_table(tagged, [label], digits)
    quotas = split_quota_table(_strata(bt, [label]), label, test_size).select(F.col(label).alias("__r_l"), "__q")
    placed = write_once(bt.join(quotas, F.col(label).eqNullSafe(F.col("__r_l"))).drop("__r_l", "__cls"), "buckets")
    behind = F.min(F.when(F.col("__off") + F.col("__n") > F.col("__q"), F.col("__b"))).alias("behind")
    bounds = {r[label]: "g" if r["behind"] is None else f"{r['behind']:0{digits}x}" for r in placed.groupBy(label).agg(behind).collect()}
    cut = placed.where((F.col("__off") < F.col("__q")) & (F.col("__off") + F.col("__n") > F.col("__q")))
    edge = _join_buckets(tagged.select(label, row_id, "__h", "__b"), cut.drop("__n"), [label])
    last = edge.withColumn("__at", F.col("__off") + _ranked([label], row_id)).where("__at <= __q").groupBy(label).agg(F.max("__h").alias("last"))
    bounds |= {r[label]: r["last"] for r in last.collect()}
    rule = F.lit(False)
    for value, bound in bounds.items():
        rule = F.when(F.col(label).eqNullSafe(F.lit(value)), order_key(row_id, seed) <= bound).otherwise(rule)
    return rule


def train_test(df: DataFrame, label: str, row_id: str, test_size: float = 0.2,
               seed: int = RANDOM_STATE) -> tuple[DataFrame, DataFrame]:
    """The rows are stored once, without their tag: a part is a filter on them (`split_rule`), so whoever reads
    one repeats neither ``df``'s plan nor the ranking."""
    rows = write_once(df, "rows")
    is_test = split_rule(rows, label, row_id, test_size, seed)
    return rows.where(~is_test), rows.where(is_test)


# --- D2 ---------------------------------------------------------------------

def stratified_kfold(df: DataFrame, label: str, row_id: str, k: int = 5,
                     seed: int = RANDOM_STATE, out: str = "fold", digits: int = DIGITS
                     ) -> DataFrame:
    """``fold`` in 0..k-1; per-class and total fold sizes differ by <= 1.

    ``fold = (class offset + rank - 1) mod k`` where the class offset is the
    number of rows in lower classes (from the bucket table, in the plan).
    """
    return stratified_folds(df, label, row_id, {out: k}, seed, digits)


def stratified_folds(df: DataFrame, label: str, row_id: str, folds: dict[str, int],
                     seed: int = RANDOM_STATE, digits: int = DIGITS) -> DataFrame:
    """`stratified_kfold` for several fold columns ``{name: k}`` from one ranking.  The order key is made
    again behind the shuffle, which carries the rows and their bucket alone."""
    if min(folds.values()) < 2:
        raise ValueError("k must be at least 2")
    key = order_key(row_id, seed)
    tagged = df.withColumn("__b", F.substring(key, 1, digits))
    bt = _bucket_table(tagged, [label], digits)
    prev = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    offs = _strata(bt, [label]).select(F.col(label).alias("__r_l"), F.coalesce(F.sum("n_c").over(prev), F.lit(0)).alias("__co"))
    placed = bt.join(F.broadcast(offs), F.col(label).eqNullSafe(F.col("__r_l"))) \
        .select(label, "__b", (F.col("__off") + F.col("__co")).alias("__off"))       # one row per class and bucket
    joined = _join_buckets(tagged, placed, [label]).repartition(label, "__b").withColumn("__h", key)
    at = joined.withColumn("__at", F.col("__off") + _ranked([label], row_id) - 1)
    return at.select(*df.columns, *[F.pmod("__at", F.lit(k)).cast("int").alias(out) for out, k in folds.items()])


# --- D3 ---------------------------------------------------------------------

def undersample_caps(df: DataFrame, label: str, row_id: str, caps: dict,
                     seed: int = RANDOM_STATE, digits: int = DIGITS) -> DataFrame:
    """Keep every row of uncapped classes and ``min(n_c, cap_c)`` of capped
    ones, without replacement (exact counts, unlike ``sampleBy``)."""
    cmap = F.create_map(*[x for c, v in caps.items() for x in (F.lit(c), F.lit(int(v)))]) \
        if caps else None

    def quota(st: DataFrame) -> DataFrame:
        cap = F.try_element_at(cmap, F.col(label)) if cmap is not None else F.lit(None)
        return st.withColumn("__q", F.least(F.col("n_c"), F.coalesce(cap.cast("bigint"), F.col("n_c"))))
    tagged = rank_at_most(df, row_id, label, quota, seed, "__keep", digits)
    return tagged.where("__keep").drop("__keep")


# --- D4 / D5 ----------------------------------------------------------------

def balanced_weight_map(counts: dict) -> dict:
    n = sum(counts.values())
    k = len([c for c, v in counts.items() if v > 0])
    return {c: n / (k * v) for c, v in counts.items() if v > 0}


def balanced_weights(df: DataFrame, label: str, out: str = "weight",
                     counts: dict | None = None) -> DataFrame:
    """``n / (K * n_c)`` per row, from the frame's own class counts (so it is
    fold-local when applied to a fold's training rows)."""
    counts = counts or group_counts(df, label)
    wmap = balanced_weight_map(counts)
    m = F.create_map(*[x for c, v in wmap.items() for x in (F.lit(c), F.lit(float(v)))])
    return df.withColumn(out, F.element_at(m, F.col(label)))


def interp_weight_map(counts: dict, alpha: float) -> dict:
    a = float(alpha)
    if not 0.0 <= a <= 1.0:  # also false for NaN
        raise ValueError(f"alpha {alpha} is not in [0, 1]")
    return {c: 1.0 + a * (v - 1.0) for c, v in balanced_weight_map(counts).items()}


def interp_weights(df: DataFrame, label: str, alpha: float, out: str = "weight",
                   counts: dict | None = None) -> DataFrame:
    """``1 + alpha * (balanced - 1)``; alpha 0 -> ones, 1 -> balanced."""
    wmap = interp_weight_map(counts or group_counts(df, label), alpha)
    m = F.create_map(*[x for c, v in wmap.items() for x in (F.lit(c), F.lit(float(v)))])
    return df.withColumn(out, F.element_at(m, F.col(label)))


# --- D8 ---------------------------------------------------------------------

def fixed_sample(df: DataFrame, row_id: str, n: int = 2000, seed: int = RANDOM_STATE,
                 digits: int = DIGITS) -> DataFrame:
    """``min(n, rows)`` rows chosen by the order key (not ``sample(fraction)``).

    The bucketed rank keeps whole buckets below the cut and sorts only the one
    that straddles it, for any ``n`` and on any number of cores."""
    quota = lambda st: st.withColumn("__q", F.least(F.col("n_c"), F.lit(int(n))))
    tagged = rank_at_most(df, row_id, None, quota, seed, "__keep", digits)
    return tagged.where("__keep").drop("__keep")


# --- D9 ---------------------------------------------------------------------

def oof_assemble(parts: list[DataFrame], row_id: str, prob_cols: list[str],
                 expected_rows: int) -> DataFrame:
    """Union per-fold validation scores; every row exactly once, finite.

    The check is one aggregate over the union (count, distinct ids, bad
    values); it raises before the frame is handed on.
    """
    if not parts:
        raise ValueError("no fold predictions to assemble")
    oof = parts[0]
    for p in parts[1:]:
        oof = oof.unionByName(p)
    bad = None
    for c in prob_cols:
        v = F.col(c)
        cond = v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
        bad = cond if bad is None else (bad | cond)
    row = oof.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(row_id).alias("d"),
                  F.count_if(bad).alias("bad")).first()
    if row["n"] != expected_rows or row["d"] != expected_rows or row["bad"]:
        raise RuntimeError(f"out-of-fold scores: {row['n']} rows, {row['d']} ids, {row['bad']} not finite; expected {expected_rows} of each row")
    return oof


# --- distributed running totals ----------------------------------------------

def running_totals(g: DataFrame, order_col: str, sums: list[str], descending: bool = False,
                   by: list[str] | None = None, total_suffix: str | None = None) -> DataFrame:
    """Add ``cum_<c>`` (inclusive running sum of ``c`` in ``order_col`` order,
    within each ``by`` group if given) for every ``c`` in ``sums``, over a table
    of *distinct* ``(by, order_col)`` values.

    The table is sorted into ranges of even size, as many as the shuffle
    has partitions, and stored with its range number; totals per (group,
    range) give offsets (at most one row per group and range), and running sums are
    taken inside a range.  No task holds more than one range, and a group of
    any size spreads over many.  ``total_suffix`` also adds the grand total
    ``<c><suffix>`` of the group.
    """
    by = by or []
    order = F.desc(order_col) if descending else F.asc(order_col)
    ranged = write_once(g.repartitionByRange(*by, order).withColumn("__b", F.spark_partition_id()), "ranges")
    bt = ranged.groupBy(*by, "__b").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    prev = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.coalesce(F.sum(f"__t_{c}").over(prev), F.lit(0)).alias(f"__o_{c}") for c in sums]
    if total_suffix:
        whole = Window.partitionBy(*by)
        cols += [F.sum(f"__t_{c}").over(whole).alias(f"{c}{total_suffix}") for c in sums]
    run = Window.partitionBy(*by, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.select("*", *[F.sum(c).over(run).alias(f"__r_{c}") for c in sums])
    j = summed.join(bt.select(*by, "__b", *cols), [*by, "__b"])
    return j.select(*g.columns, *[(F.col(f"__o_{c}") + F.col(f"__r_{c}")).alias(f"cum_{c}") for c in sums],
                    *([F.col(f"{c}{total_suffix}") for c in sums] if total_suffix else []))
