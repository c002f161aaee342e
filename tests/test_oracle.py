"""Every registered query against its DuckDB twin on the smallest driver tables.

Same comparison as the driver's gate: row count, column names and the
order-insensitive multiset of rows (floats to 9 significant digits).
"""

from __future__ import annotations

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from oracle_check import TABLES, rows_of  # noqa: E402
from tillpoint.plans.catalog import load_all  # noqa: E402

SF = os.environ.get("TILLPOINT_TEST_SF", "/root/testdata/sf0.001")
REG = load_all()
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    yield c
    c.close()


@pytest.mark.parametrize("name", sorted(REG))
def test_query_matches_oracle(spark, con, name):
    q = REG[name]
    df = q.build(spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if q.sql is None:
        assert len(df.columns) > 0
        return
    res = con.execute(q.sql)
    dcols = [d[0] for d in res.description]
    a, ac = rows_of(df.columns, rows)
    b, bc = rows_of(dcols, res.fetchall())
    assert ac == bc
    assert len(a) == len(b)
    assert a == b
