"""Each core query against its SQL on the small tables; the ones without SQL must give rows."""

import glob
import os

import pytest

D = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
from tidewire.plans import catalog  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{D}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(frame):
    def cell(v):
        if v is None or v != v:
            return "-"
        if isinstance(v, float):
            return f"{v:.6f}".rstrip("0").rstrip(".")
        if hasattr(v, "isoformat"):
            return v.isoformat()[:19].replace("T00:00:00", "")
        return str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, D).toPandas()
    if name in catalog.ORACLES:
        want = db.execute(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)
    else:
        assert len(got.columns) > 0
