"""Driver contract: entry, queries and oracle keys."""

import __spark_entry__ as E


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.oracle_sql()) >= 70


def test_entry_runs_on_the_smoke_tables(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"feature", "level", "count", "fatal_count"} <= set(df.columns)


def test_oracle_matches_on_sf0001_for_a_sample_of_queries(spark):
    import duckdb

    from conftest import SF0001
    con = duckdb.connect()
    for t in ("lineitem", "events", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    q, sql = E.queries(), E.oracle_sql()
    for key in ("category_by_class", "stratified_split", "threshold_sweep", "association_matrix",
                "audit_summary", "pr_curve"):
        s = sorted(map(tuple, q[key](spark, SF0001).collect()), key=repr)
        res = con.execute(sql[key])
        d = sorted(map(tuple, res.fetchall()), key=repr)
        assert len(s) == len(d), key
