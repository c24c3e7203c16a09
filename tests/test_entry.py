"""Driver contract: entry, registry and oracle coverage on sf0.001."""

import os

import pytest

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["source", "n_reviews", "n_promotional", "n_inducing", "induced_share"]


def test_oracle_keys_are_queries():
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 60


TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _oracle_keys():
    import __spark_entry__ as E
    return sorted(E.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("key", _oracle_keys())
def test_query_matches_oracle_sf0001(spark, duck, key):
    import __spark_entry__ as E
    df = E.queries()[key](spark, SF)
    res = duck.sql(E.oracle_sql()[key])
    cols = df.columns
    assert sorted(cols) == sorted(res.columns)
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    oorder = sorted(range(len(res.columns)), key=lambda i: res.columns[i])
    a = sorted((tuple(r[i] for i in order) for r in df.collect()), key=repr)
    b = sorted((tuple(r[i] for i in oorder) for r in res.fetchall()), key=repr)
    assert a == b
