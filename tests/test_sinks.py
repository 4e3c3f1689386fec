"""Result sinks, keyed upsert of stored tables and the EDA report builder."""

from stratakit.plans import inputs as I
from stratakit.plans.reports import eda_tables, write_eda
from stratakit.presets import SURROGATE
from stratakit.sources.sinks import upsert_table, write_table

from conftest import SF0001


def test_write_formats_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    for fmt in ("csv", "json", "parquet"):
        path = write_table(df, str(tmp_path / fmt), fmt, single_file=True)
        reader = spark.read.option("header", True) if fmt == "csv" else spark.read
        back = reader.format(fmt).load(path)
        assert sorted(str(r["k"]) for r in back.collect()) == ["a", "b"]


def test_upsert_creates_then_replaces_keys(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1)], "slug string, fold int")
    p1 = upsert_table(spark, None, a)
    b = spark.createDataFrame([("x", 9)], "slug string, fold int")
    p2 = upsert_table(spark, p1, b)
    got = sorted((r.slug, r.fold) for r in spark.read.parquet(p2).collect())
    assert got == [("x", 9), ("y", 1)]


def test_eda_report_tables(spark, tmp_path):
    raw = I.raw(spark, SF0001)
    tables = eda_tables(raw, SURROGATE)
    assert len(tables) == 8
    sev = {r.severity: r["count"] for r in tables["severity_summary"].collect()}
    assert sev == {"Fatal": 87, "Serious": 990, "Slight": 4917}
    paths = write_eda(raw, SURROGATE, str(tmp_path / "eda"))
    assert set(paths) == set(tables)


def test_scale_settings_bound_the_shuffle_width():
    from stratakit.session import scale_settings

    big = scale_settings(100 << 40, cores=8000)          # 100 TiB on 1000 executors x 8 cores
    assert int(big["spark.sql.shuffle.partitions"]) == 50_000
    assert big["spark.sql.adaptive.enabled"] == "true"
    small = scale_settings(10 << 20, cores=8)
    assert int(small["spark.sql.shuffle.partitions"]) == 16


def test_stored_table_shows_whole_versions_only(spark, tmp_path, monkeypatch):
    import pytest

    from stratakit.sources.store import Conflict, StoredTable

    table = StoredTable(spark, str(tmp_path / "t"))
    assert table.version() == 0 and table.read() is None and table.vacuum() == 0
    a = spark.createDataFrame([("x", 1), ("y", 1)], "slug string, fold int")
    assert table.publish(a) == 1
    # a writer that dies after its files and before its pointer changes nothing
    broken = StoredTable(spark, str(tmp_path / "t"))
    monkeypatch.setattr(broken, "_context", None)
    with pytest.raises(AttributeError):
        broken.upsert(a.limit(1), "slug")
    assert sorted(map(tuple, table.read().collect())) == [("x", 1), ("y", 1)]
    old = table.read()
    assert table.upsert(spark.createDataFrame([("x", 9), ("z", 2)], "slug string, fold int"), ["slug"]) == 2
    assert sorted(map(tuple, table.read().collect())) == [("x", 9), ("y", 1), ("z", 2)]
    assert sorted(map(tuple, old.collect())) == [("x", 1), ("y", 1)]  # a reader keeps its version
    with pytest.raises(Conflict):  # two writers from one version: the second doesn't hide the first
        table.publish(a, after=1)
    assert table.version() == 2 and table.vacuum(keep=1) == 1 and table.read().count() == 3
