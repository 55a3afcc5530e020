"""Every query with SQL gives the rows that the SQL gives; those without are tested by brute force elsewhere."""

import duckdb
import pytest

from tidegate.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, int) and not isinstance(x, bool):
        return f"{float(x):.9g}"
    return str(x)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_equal_the_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rel = duck.execute(ORACLE_SQL[name])
    cols = [d[0] for d in rel.description]
    assert sorted(got.columns) == sorted(cols)
    want = sorted(tuple(map(plain, r)) for r in rel.fetchall())
    assert sorted(tuple(map(plain, r)) for r in got.select(*cols).collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_the_others_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
