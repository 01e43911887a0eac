"""Every query with SQL against DuckDB over the same tables."""

import glob
import os

import duckdb
import pytest

from almanack.plans import catalog, catalog_layout, catalog_links, catalog_mining, catalog_store, catalog_text, catalog_trees  # noqa: F401

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(clean(r[i]) or "" for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalog.ORACLES:
        assert rows
        return
    found = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in found.description]
    want = found.fetchall()
    assert sorted(df.columns) == sorted(columns)
    got, want = canonical(rows, df.columns), canonical(want, columns)
    assert len(got) == len(want) and got == want
