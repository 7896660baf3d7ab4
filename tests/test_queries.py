"""Every book query against its DuckDB SQL on the smallest tables."""

import os

import pytest

from quire.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def table(columns, rows):
    """Rows as sorted tuples of texts, columns by name."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    said = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return [columns[i] for i in order], sorted(tuple(said(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    assert table(got.columns, [tuple(r) for r in got.collect()]) == table([c[0] for c in want.description], want.fetchall())
