"""Every query of the subpackage that has SQL, against that SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from quillon.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return float(f"{value:.9g}") if isinstance(value, float) and math.isfinite(value) else value


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, database, name):
    df = queries.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    found = database.sql(queries.oracle_sql()[name])
    assert sorted(found.columns) == columns
    expected = sorted((tuple(plain(row[found.columns.index(c)]) for c in columns) for row in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == expected
