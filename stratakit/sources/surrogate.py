"""Collision-shaped tables derived from the driver's ``lineitem`` table.

The study's source CSV is not distributed, so the test and bench inputs are a
deterministic re-shaping of ``lineitem`` that has the same features: a rare
class first, null times and crossings, repeated and scientific-notation
identifiers and full-row copies that differ only in ``row_index``.  All
arithmetic is integer/string so every engine agrees exactly.

Everything here is a narrow projection plus an explode: one scan of the four
key columns, the quantity, the ship date and two flags (column-pruned at the
parquet reader), no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..presets import SURROGATE

COPY_OFFSET = 100_000_000_000_000_000   # row_index shift of the injected copies


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread_small_scan(df: DataFrame) -> DataFrame:
    """Round-robin a scan that has fewer splits than the session has cores.

    A file with one row group is read by one task however it is split, so
    everything up to the first shuffle would run on one core.  Large inputs
    (more splits than cores - always the case at cluster scale) are returned
    untouched: no extra shuffle there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def _s(c: Column) -> Column:
    return c.cast("string")


def _pad2(c: Column) -> Column:
    return F.lpad(_s(c), 2, "0")


def collisions_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw collision-shaped view (16 columns) over ``lineitem``."""
    li = spread_small_scan(read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_shipdate", "l_returnflag", "l_linestatus"))
    ok, pk, sk, ln = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    # 60 bits of a digest of the whole record: no overflow at any scale, and two
    # records that share their four keys differ
    record = F.concat_ws("|", ok, pk, sk, ln, F.col("l_quantity").cast("bigint"), F.year("l_shipdate"),
                         F.month("l_shipdate"), F.dayofmonth("l_shipdate"), "l_returnflag", "l_linestatus")
    row_key = F.conv(F.substring(F.md5(record), 1, 15), 16, 10).cast("bigint")
    base = li.select(
        row_key.alias("row_index"),
        (ok * 7919 + pk * 104729 + sk * 1299709 + ln * 15485863).alias("mix"),
        ok, pk, sk, ln,
        F.col("l_quantity").cast("bigint").alias("qty"),
        "l_shipdate", "l_returnflag", "l_linestatus",
    )
    qty = F.col("qty")
    mix = F.col("mix")
    speed = (F.when(qty <= 2, 20).when(qty <= 30, 30).when(qty <= 36, 40)
             .when(qty <= 39, 50).when(qty <= 46, 60).otherwise(70))
    shaped = base.select("row_index", "mix", ok, "l_returnflag", "l_linestatus", "l_shipdate",
                         ln, sk, pk, speed.alias("speed_limit"),
                         (mix % 10007).cast("bigint").alias("u"))
    u = F.col("u")
    sl = F.col("speed_limit")
    status = F.col("l_linestatus")
    flag = F.col("l_returnflag")
    ship = F.col("l_shipdate")
    one = shaped.select(
        "row_index",
        F.when(mix % 3 == 0, F.concat(F.lit("2.01E+"), _s(10 + ok % 4)))
         .otherwise(F.concat(F.lit("A"), _s(ok), F.lit("-"), _s(ln))).alias("accident_index"),
        F.when(u < F.when(sl >= 60, 400).otherwise(100), 1)
         .when(u < F.when(status == "O", 2100).otherwise(1500), 2)
         .otherwise(3).cast("int").alias("severity_code"),
        F.concat(_pad2(F.dayofmonth(ship)), F.lit("/"), _pad2(F.month(ship)), F.lit("/"),
                 _s(F.year(ship))).alias("date_str"),
        F.when(mix % 997 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(_pad2(mix % 24), F.lit(":"), _pad2(mix % 60))).alias("time_str"),
        (1 + mix % 7).cast("int").alias("day_of_week"),
        (1 + pk % 6).cast("int").alias("first_road_class"),
        F.when(sk % 7 == 0, -1).otherwise(sk % 7).cast("int").alias("second_road_class"),
        F.when(flag == "A", "Single carriageway").when(flag == "N", "Dual carriageway")
         .otherwise("Roundabout").alias("road_type"),
        sl.cast("int").alias("speed_limit"),
        F.when(mix % 1499 == 0, F.lit(None).cast("string"))
         .when(mix % 11 < 9, "No physical crossing").otherwise("Zebra crossing").alias("crossing"),
        F.when((mix % 24 >= 7) & (mix % 24 <= 18), "Daylight").otherwise("Dark").alias("light"),
        F.when(status == "O", 2).otherwise(1).cast("int").alias("area"),
        (mix % 1000003).cast("bigint").alias("location_e6"),
        (1 + mix % 5).cast("int").alias("number_of_vehicles"),
        F.year(ship).cast("int").alias("src_year"),
        "mix",
    )
    # every 43rd record gets a full copy under a shifted row_index: one scan,
    # one explode (a union would read lineitem twice)
    offsets = F.when(mix % 43 == 0, F.array(F.lit(0), F.lit(COPY_OFFSET))).otherwise(F.array(F.lit(0)))
    cols = [c for c in one.columns if c != "mix"]
    out = one.select(*cols, F.explode(offsets).alias("__off"))
    return out.withColumn("row_index", F.col("row_index") + F.col("__off")).select(*cols)


def clean_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``clean``: dedup on substantive columns (first copy kept) + complete cases.

    Same rows as the fixture ``clean`` view: all 16 columns, one row per
    substantive record, ``row_index`` = smallest index of its copies.
    """
    from ..operators.clean import complete_cases, dedup_substantive

    raw = collisions_raw(spark, sf_dir)
    return complete_cases(dedup_substantive(raw, SURROGATE.non_substantive,
                                            keep_min=SURROGATE.row_id))


def surrogate_scores(clean: DataFrame, row_id: str = "row_index",
                     severity: str = "severity_code", keep: tuple[str, ...] = ()) -> DataFrame:
    """Deterministic class scores over ``clean`` (stand-in for model output).

    ``p0`` deliberately leaks the label: it exists to give the metric and
    threshold operators a value oracle, not to model anything.  ``keep`` names columns to retain.
    """
    rid = F.col(row_id)
    sev = F.col(severity)
    a = 1 + F.when(sev == 1, 70).when(sev == 2, 12).otherwise(0) + F.pmod(rid, F.lit(61))
    b = 60 + F.when(sev == 2, 120).otherwise(0) + F.pmod(rid, F.lit(97))
    d = 130 + F.pmod(rid, F.lit(211))
    tot = (a + b + d).cast("double")
    return clean.select(
        rid.alias("row_index"),
        (sev - 1).cast("int").alias("y"),
        (a.cast("double") / tot).alias("p0"),
        (b.cast("double") / tot).alias("p1"),
        (d.cast("double") / tot).alias("p2"),
        (F.pmod(rid, F.lit(997)).cast("double") / 1000).alias("s_worse"),
        (F.pmod(rid, F.lit(499)).cast("double") / 1000).alias("s_rare"),
        *keep,
    )
