"""Every registered query of the engine against its SQL."""

import duckdb
import pytest

from driftline import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def shown(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(shown(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    got = rows_of(df.columns, df.collect())
    if name in plans.ORACLES:
        want = duck.execute(plans.ORACLES[name])
        assert got == rows_of([c[0] for c in want.description], want.fetchall())
    assert got[1]
