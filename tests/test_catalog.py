"""Every query of the core against its SQL on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from sluice.plans import catalog


def norm(v):
    if v is None or v != v:
        return None
    return v.isoformat()[:19] if hasattr(v, "isoformat") else round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in Path(data).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, data, duck, name):
    df = catalog.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = Counter(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    want = duck.execute(catalog.oracle_sql()[name])
    at = [x[0] for x in want.description]
    assert sorted(at) == cols
    assert got == Counter(repr(tuple(norm(r[at.index(c)]) for c in cols)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, data, name):
    assert catalog.queries()[name](spark, data).count() > 0
