"""Every registered query of the event-log engine against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from caseloom.plans import catalog, feature_catalog, graph_catalog, label_catalog, matching_catalog, measure_catalog, object_catalog, resource_catalog, stream_catalog  # noqa: F401  these add their queries to the catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if value is None or isinstance(value, (bool, str)):
        return value
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat()
    number = float(value)
    return "nan" if math.isnan(number) else float(f"{number:.9g}")


def same(names, found, other, expected):
    assert sorted(names) == sorted(other)
    order = lambda have, rows: sorted((tuple(plain(r[have.index(c)]) for c in sorted(have)) for r in rows), key=repr)
    assert order(names, found) == order(other, expected)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, DIR)
    cur = con.execute(catalog.SQL[name])
    same(df.columns, [tuple(r) for r in df.collect()], [x[0] for x in cur.description], cur.fetchall())
