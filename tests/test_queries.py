"""Every query with a DuckDB twin against it, the way the driver compares them."""

import decimal
import math
import os
from collections import Counter

import duckdb
import pytest

from tessella import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
SLOW = {"logo_cv", "diagnose", "heldout_scores", "grubbs_critical"}


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(norm, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - SLOW))
def test_query(spark, con, name):
    made = queries.queries()[name](spark, SF)
    columns = sorted(made.columns)
    rows = Counter(tuple(norm(x) for x in r) for r in made.select(*[f"`{c}`" for c in columns]).collect())
    twin = con.sql(queries.oracle_sql()[name])
    assert sorted(twin.columns) == columns
    listed = ", ".join(f'"{c}"' for c in columns)
    assert rows == Counter(tuple(norm(x) for x in r) for r in con.sql(f"SELECT {listed} FROM ({queries.oracle_sql()[name]}) q").fetchall())


def test_models(spark):
    logo = queries.logo_cv(spark, SF).collect()
    assert len(logo) == 4 and all(0 <= r["auc"] <= 1 and r["accuracy"] <= 1 for r in logo)
    assert {r["author"] for r in queries.heldout_scores(spark, SF).collect()} == {0, 1}
    assert {r["target"]: r["auc"] for r in queries.diagnose(spark, SF).collect()}["english"] > 0.9
    r = queries.grubbs_critical(spark, SF).first()
    assert 2 < r["critical"] < 3.5 and r["rejects"] == (r["g"] > r["critical"])
