"""Each registered query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from corpusloom.plans import more, registry
from corpusloom.sources.tables import NAMES

assert more


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name):
    q = registry.QUERIES[name]
    df = q.run(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if q.sql:
        want = con.execute(q.sql)
        names = [c[0] for c in want.description]
        wanted = rows(names, want.fetchall())
        assert got[0] == wanted[0]
        assert len(got[1]) == len(wanted[1])
        for a, b in zip(got[1], wanted[1], strict=True):
            assert a == pytest.approx(b) if all(isinstance(x, int | float) for x in a) else repr(a).replace(".0,", ",") == repr(b).replace(".0,", ",")
