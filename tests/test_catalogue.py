"""The driver's contract, and all catalogue queries at the smallest scale against their SQL."""

import os

import duckdb
import pytest

import __spark_entry__
from quillon.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 6


def test_queries_have_sql():
    """All but those that ask a model over several rounds; these are tested against plain calls."""
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"pipeline_offline", "question_rounds"}
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, (int, float)) and abs(a - b) < 1e-6)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(*columns).collect()), key=repr)
    sql = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(sql.columns) == columns
    expected = sorted(duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall(), key=repr)
    assert len(got) == len(expected)
    assert all(same(a, b) for g, e in zip(got, expected, strict=True) for a, b in zip(g, e, strict=True))
