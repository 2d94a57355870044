"""Every registered query against its SQL on the smallest tables, or at least that it runs."""

from pathlib import Path

import pytest

from dyadflow import plans  # noqa: F401
from dyadflow.plans import registry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the tables aren't here")


def same(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    import duckdb

    df = registry.QUERIES[name](spark, str(DATA))
    rows = df.collect()
    if name not in registry.ORACLES:
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = con.sql(registry.ORACLES[name])
    names = sorted(df.columns)
    assert sorted(got.columns) == names
    at = [got.columns.index(c) for c in names]
    assert sorted(repr([same(r[c]) for c in names]) for r in rows) == sorted(repr([same(r[i]) for i in at]) for r in got.fetchall())
