"""Every query with SQL gives what the SQL gives, on the smallest tables; none is empty."""

import math
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


def _load():
    from tessera.plans import registry

    registry.load()
    return registry


REGISTRY = _load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if v is None or isinstance(v, (bool, str)):
        return str(v)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in v.items()) + "}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(REGISTRY.QUERIES))
def test_query(spark, duck, name):
    df = REGISTRY.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in REGISTRY.ORACLES:
        out = duck.execute(REGISTRY.ORACLES[name])
        cols = [d[0] for d in out.description]
        assert sorted(cols) == sorted(df.columns)
        order = [cols.index(c) for c in df.columns]
        assert sorted(tuple(map(norm, r)) for r in rows) == sorted(tuple(norm(r[i]) for i in order) for r in out.fetchall())


def test_terrain_counts(spark):
    q = REGISTRY.QUERIES
    assert q["terrain_variants"](spark, SF).count() == 47
    assert q["terrain_pairs"](spark, SF).count() == 338
    assert q["terrain_pairs_sides"](spark, SF).count() == 128
