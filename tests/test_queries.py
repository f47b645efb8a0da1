"""Every query with SQL is held against DuckDB on the driver's smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from ledgerwright.plans import oracles, registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "lineitem", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(a, b) -> bool:
    return a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-9 * max(1.0, abs(a)))


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    mine = [tuple(r[c] for c in names) for r in df.collect()]
    cursor = db.execute(oracles.ORACLES[name])
    header = [d[0] for d in cursor.description]
    assert sorted(header) == names
    theirs = [tuple(r[header.index(c)] for c in names) for r in cursor.fetchall()]
    key = lambda r: tuple((x is None, f"{x + 0.0:.6e}" if isinstance(x, float) else str(x)) for x in r)
    assert len(mine) == len(theirs)
    for a, b in zip(sorted(mine, key=key), sorted(theirs, key=key)):
        assert all(map(same, a, b)), (a, b)


#: Draws of a random generator, held against a plain version in test_engine_scale.py.
WITHOUT_SQL = {"e10_resampled_interval"}


def test_all_have_sql():
    assert set(registry.QUERIES) - WITHOUT_SQL == set(oracles.ORACLES)
