"""Cleaning contract, null tokens, scalar features."""

import math

import pytest
from pyspark.sql import functions as F

from stratakit.functions import expressions as X
from stratakit.operators.sampling import split_quota_table, stratified_kfold, stratified_split
from stratakit.operators.clean import (
    clean_records,
    complete_cases,
    contract_project,
    dedup_substantive,
    prepare_analytical,
    target_encode,
    time_features,
    validate_model_inputs,
    with_row_key,
)
from stratakit.presets import UK_COLLISIONS
from stratakit.sources.csv import normalise_null_tokens, read_raw, uk_schema

DEDUP_SCHEMA = "`Unnamed: 0` int, Accident_Index string, Accident_Severity int, Longitude double, Time string"


def test_dedup_ignores_row_index_and_treats_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, "A", 3, 1.5, None), (2, "A", 3, 1.5, None)], DEDUP_SCHEMA)
    out = dedup_substantive(df, ["Unnamed: 0"], keep_min="Unnamed: 0").collect()
    assert len(out) == 1 and out[0]["Unnamed: 0"] == 1
    assert df.columns == dedup_substantive(df, ["Unnamed: 0"], keep_min="Unnamed: 0").columns


def test_identifier_alone_is_not_the_key(spark):
    df = spark.createDataFrame([(1, "A", 3, 1.5, "08:00"), (2, "A", 3, 2.5, "08:00"),
                                (3, "A", 3, 1.5, "09:00")], DEDUP_SCHEMA)
    assert dedup_substantive(df, ["Unnamed: 0"], keep_min="Unnamed: 0").count() == 3


def test_dedup_happens_before_the_column_drop(spark):
    # the third row differs only in a column the contract drops later
    df = spark.createDataFrame([(1, "A", 3, 1.5, "08:00"), (2, "A", 3, 1.5, "08:00"),
                                (3, "A", 3, 9.9, "08:00")], DEDUP_SCHEMA)
    d = dedup_substantive(df, ["Unnamed: 0"], keep_min="Unnamed: 0")
    kept = complete_cases(contract_project(d, ["Longitude", "Accident_Index"], keep=["Unnamed: 0"]))
    assert kept.count() == 2


def test_null_tokens_follow_the_pandas_default_list(spark):
    df = spark.createDataFrame([("NA",), ("None",), ("none",), ("",), ("x",), ("#N/A",)], "v string")
    got = [r.v for r in normalise_null_tokens(df).collect()]
    assert got == [None, None, "none", None, "x", None]


def test_csv_scan_with_explicit_schema_and_tokens(spark, tmp_path):
    header = ",".join(f'"{c}"' if "," in c else c for c in uk_schema().fieldNames())
    row = ["1", "2.01E+12", "1.0", "2.0", "-1.5", "51.5", "3", "2", "1", "1", "01/02/2014", "2",
           "08:05", "12", "E1", "3", "10", "Single carriageway", "30", "None", "-1", "0",
           "None", "No physical crossing", "Daylight", "Fine", "Dry", "None", "None", "1", "Yes",
           "E01", "2014"]
    path = tmp_path / "raw.csv"
    path.write_text(header + "\n" + ",".join(row) + "\n")
    df = read_raw(spark, str(path))
    r = df.first()
    assert r["Accident_Index"] == "2.01E+12" and r["Junction_Control"] is None
    assert r["Speed_limit"] == 30 and r["Longitude"] == -1.5
    with pytest.raises(FileNotFoundError):
        read_raw(spark, str(tmp_path / "missing.csv"))


def test_leakage_guard_reports_both_faults():
    with pytest.raises(ValueError, match=r"leaks .*'Accident_Severity'.*lacks \['rush_hour'\]"):
        validate_model_inputs(["Number_of_Vehicles", "Accident_Severity", "Season"],
                              UK_COLLISIONS.forbidden, ["Season", "rush_hour"])
    validate_model_inputs(["Season"], UK_COLLISIONS.forbidden, ["Season"])


def test_row_key_splits_a_table_whose_row_numbers_repeat(spark):
    rows = [(i % 40, i % 3, f"a{i}", None if i % 5 else "x") for i in range(300)] + [(900, 0, "a|b", "c"), (901, 0, "a", "b|c")]
    df = spark.createDataFrame(rows, ["Unnamed: 0", "label", "p", "q"])
    keyed = with_row_key(df, ["label", "p", "q"])
    assert keyed.select("row_key").distinct().count() == len(rows)
    tagged = stratified_split(keyed, "label", "row_key", 0.25)
    assert tagged.where("is_test").count() == math.ceil(0.25 * len(rows))
    assert stratified_kfold(keyed, "label", "row_key", 4).groupBy("fold").count().count() == 4


def test_split_quotas_do_not_overflow(spark):
    n = 10**12
    strata = spark.createDataFrame([(0, n), (1, 3 * n), (2, 96 * n)], "label long, n_c long")
    got = {r.label: r["__q"] for r in split_quota_table(strata, "label", 0.2).collect()}
    assert got == {0: n // 5, 1: 3 * n // 5, 2: 96 * n // 5}


def test_target_encoding_rejects_unknown_codes(spark):
    ok = target_encode(spark.createDataFrame([(1,), (2,), (3,)], "s int"), "s")
    assert [r.label for r in ok.orderBy("s").collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        target_encode(spark.createDataFrame([(1,), (4,)], "s int"), "s")


def test_season_cyclical_and_rush_hour(spark):
    df = spark.createDataFrame([(1, 0), (7, 8), (7, 12)], "m int, h int")
    rows = df.select(X.season("m").alias("s"), X.hour_sin("h").alias("a"), X.hour_cos("h").alias("b"),
                     X.rush_hour("h").alias("r")).collect()
    assert [r.s for r in rows] == ["Winter", "Summer", "Summer"]
    assert (rows[0].a, rows[0].b) == (0.0, 1.0)
    assert [r.r for r in rows] == [0, 1, 0]


def test_time_feature_stage(spark):
    df = spark.createDataFrame([("01/01/2018", "17:30", 5)], "Date string, Time string, value int")
    out = time_features(df, "Date", "Time")
    r = out.first()
    assert "Date" not in out.columns and "Time" not in out.columns
    assert r["Season"] == "Winter" and r["rush_hour"] == 1 and r["Month"] == 1
    assert r["hour_sin"] == pytest.approx(math.sin(2 * math.pi * 17 / 24))


def test_lenient_parsing_like_strptime(spark):
    df = spark.createDataFrame([("1/2/2014", "8:05"), ("31/02/2014", "25:99"), ("01/02/14", "24:00")],
                               "d string, t string")
    rows = df.select(X.parse_date("d").alias("d"), X.parse_time("t").alias("t")).collect()
    assert rows[0].d is not None and rows[0].t is not None
    assert rows[1].d is None and rows[1].t is None and rows[2].t is None


def test_hour_reconstruction_and_string_predicates(spark):
    df = spark.createDataFrame([(h,) for h in range(24)], "h int")
    back = df.select("h", X.hour_from_cyclical(X.hour_sin("h"), X.hour_cos("h")).alias("b")).collect()
    assert all(r.h == r.b for r in back)
    s = spark.createDataFrame([("2.01e+12",), ("A1",), (None,), ("  \t",)], "v string")
    got = s.select(X.sci_notation("v").alias("sci"), X.is_blank("v").alias("blank")).collect()
    assert [r.sci for r in got] == [True, False, False, False]
    assert [r.blank for r in got] == [False, False, False, True]


def test_category_label_falls_back_to_raw_value(spark):
    df = spark.createDataFrame([(2,), (9,)], "d int")
    got = [r.x for r in df.select(X.category_label("d", {2: "Monday"}).alias("x")).collect()]
    assert got == ["2 — Monday", "9"]


EDA_SCHEMA = ("`Unnamed: 0` int, Accident_Index string, Accident_Severity int, Date string, Time string, "
              "Day_of_Week int, `1st_Road_Class` int, Road_Type string, Speed_limit int, "
              "`2nd_Road_Class` int, `Pedestrian_Crossing-Physical_Facilities` string, "
              "Light_Conditions string, Weather_Conditions string, Road_Surface_Conditions string, "
              "Urban_or_Rural_Area int")


def eda_rows():
    base = ["A1", 1, "01/01/2014", "08:00", 2, 3, "Single carriageway", 30, -1,
            "No physical crossing", "Daylight", "Fine", "Dry", 1]
    rows = []
    for i, (sev, t) in enumerate([(1, "08:00"), (2, "17:30"), (3, None), (3, "23:10")]):
        r = list(base)
        r[0] = f"A{i}"
        r[1] = sev
        r[3] = t
        rows.append(tuple([i] + r))
    return rows


def test_prepare_analytical_on_the_eda_frame(spark):
    raw = spark.createDataFrame(eda_rows(), EDA_SCHEMA)
    out = prepare_analytical(raw, UK_COLLISIONS)
    assert out.count() == 3
    assert len(out.columns) == 21          # row key + 20 derived columns
    r = out.where("severity = 'Serious'").first()
    assert (r.month, r.season, r.hour, r.rush_hour) == ("Jan", "Winter", 17, "Yes")
    assert r.second_road_class == "No second road" and r.day_of_week == "Monday"
    assert clean_records(raw, UK_COLLISIONS).count() == 3


def test_bad_cells_are_counted_or_raise(spark, tmp_path):
    from pyspark.sql import types as T

    from stratakit.sources.csv import bad_cell_counts

    (tmp_path / "t.csv").write_text("n,x,s\n3.0,1,a\nx,2.5,b\nx,NaN,c\n4e2,y,d\n3.5,NA,\n 7,1,e\n9223372036854775807,1,f\n")
    schema = T.StructType.fromDDL("n bigint, x double, s string")
    df = read_raw(spark, str(tmp_path / "t.csv"), schema, bad_cells="ledger")
    assert [r.n for r in df.collect()] == [3, None, None, 400, None, 7, 2**63 - 1]
    assert sorted(map(tuple, bad_cell_counts(df).collect())) == [("n", "3.5", 1), ("n", "x", 2), ("x", "y", 1)]
    kept = read_raw(spark, str(tmp_path / "t.csv"), schema, bad_cells="null")
    assert kept.columns == ["n", "x", "s"] and kept.count() == 7
    with pytest.raises(Exception, match="n holds no bigint: x|x holds no double: y|n holds no bigint: 3.5"):
        read_raw(spark, str(tmp_path / "t.csv"), schema).collect()


def test_unmapped_code_fails_the_job(spark):
    from stratakit.operators.clean import target_encode

    df = spark.createDataFrame([(1,), (3,)], "severity int")
    assert [r.label for r in target_encode(df, "severity", check="plan").collect()] == [0, 2]
    for bad in (4, None):
        with pytest.raises(Exception, match="severity: no label for code"):
            target_encode(spark.createDataFrame([(1,), (bad,)], "severity int"), "severity", check="plan").collect()


def test_rows_without_a_number_of_their_own_are_split_by_their_values(spark):
    """The published table's row number repeats; its layout makes the id of the substantive values."""
    from stratakit.operators import sampling as S
    from stratakit.operators.clean import clean_records, target_encode

    fields = uk_schema().fields
    rows = [tuple((i % 7 if f.name == "Unnamed: 0" else 1 + (i // 2) % 3 if f.name == UK_COLLISIONS.severity else i // 2
                   if f.name == "Police_Force" else 1) if f.dataType.simpleString() == "bigint"
                  else float(i // 2) if f.dataType.simpleString() == "double" else f"v{i // 2}" for f in fields) for i in range(120)]
    raw = spark.createDataFrame(rows, uk_schema())
    clean = clean_records(raw, UK_COLLISIONS)
    assert clean.count() == 60 == clean.select("row_key").distinct().count()
    frame = target_encode(clean, UK_COLLISIONS.severity)
    train, test = S.train_test(frame, "label", UK_COLLISIONS.row_id)
    assert (train.count(), test.count()) == (48, 12)
    folds = {r.row_key: r.fold for r in S.stratified_kfold(frame.repartition(5), "label", "row_key", 5).collect()}
    again = {r.row_key: r.fold for r in S.stratified_kfold(clean_records(raw.repartition(9), UK_COLLISIONS).transform(
        lambda d: target_encode(d, UK_COLLISIONS.severity)), "label", "row_key", 5).collect()}
    assert folds == again and len(folds) == 60
