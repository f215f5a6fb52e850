"""Each query with SQL gives what that SQL gives in DuckDB."""

import duckdb
import pytest
from paperloom.queries import QUERIES, SQL, entry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def rounded(row):
    return [round(v, 9) if isinstance(v, float) else v for v in row]


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, D)
    columns = sorted(df.columns)
    got = sorted((rounded(r[c] for c in columns) for r in df.collect()), key=str)
    if name not in SQL:
        assert got
        return
    found = duck.execute(SQL[name])
    names = [x[0] for x in found.description]
    want = [[r[names.index(c)] for c in columns] for r in found.fetchall()] if sorted(names) == columns else None
    assert got == sorted(map(rounded, want), key=str)


def test_entry(spark):
    assert entry(spark).count() == 200
