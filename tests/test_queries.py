"""Every registered query of the signal operators against its SQL, at the smallest scale."""

import duckdb
import pytest

from strideframe.plans import catalogue, extended  # noqa: F401  registers more queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if v is None else float(v) if isinstance(v, float) else v
    return sorted([tuple(plain(r[i]) for i in order) for r in found], key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, sql, name):
    got, want = catalogue.QUERIES[name](spark, SF), sql.sql(catalogue.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) - {"stream_windows", "rf_scenarios", "loso_scenarios", "loso_exact_forest"}))
def test_query_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_stream_equals_batch(spark):
    got = {(r.subject, r.run, r.widx): (r.label, round(r.mean_value, 6)) for r in catalogue.QUERIES["stream_windows"](spark, SF).collect()}
    want = {(r.user_id, r.run, r.widx): (r.label, r.mean_value) for r in catalogue.QUERIES["windows_strict"](spark, SF).collect()}
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
