"""Every registered query against its SQL at the smallest scale."""

from __future__ import annotations

import math

import duckdb
import pytest

from quillgraph import oracle
from quillgraph.queries import REGISTRY

TABLES = ("documents", "events", "labels", "embeddings", "conversations")


def _rows(rows) -> list[tuple]:
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(plain(v) for v in r) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(REGISTRY) & set(oracle.statements())))
def test_query_equals_sql(spark, duck, small, name):
    sql = oracle.statements()[name]
    found = REGISTRY[name](spark, small)
    names = sorted(found.columns)
    assert names == sorted(duck.sql(sql).columns)
    listed = ", ".join(f'"{n}"' for n in names)
    assert _rows(map(tuple, found.select(*names).collect())) == _rows(duck.sql(f"SELECT {listed} FROM ({sql})").fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
