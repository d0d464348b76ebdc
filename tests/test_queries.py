"""Every registered query of the engine over the smallest tables, against its SQL where there is one."""

import math
import os

import duckdb
import pytest

from attesta.plans import queries

TABLES = ("customer", "nation", "part", "lineitem")


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, t)}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0 if math.isfinite(v) else str(v)
    return str(v) if hasattr(v, "isoformat") else float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    if name not in queries.ORACLE_SQL:
        assert got.count() > 0
        return
    want = con.execute(queries.ORACLE_SQL[name])
    names = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == names
    order = [[d[0] for d in want.description].index(n) for n in names]
    expected = sorted(repr([plain(r[i]) for i in order]) for r in want.fetchall())
    assert sorted(repr([plain(v) for v in r]) for r in got.select(*names).collect()) == expected
    assert expected


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
