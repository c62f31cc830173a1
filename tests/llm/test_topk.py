"""Exact top-k search against all products."""

from __future__ import annotations

import math
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from quillgraph.llm import queries, topk

SCHEMA = "vec_id long, embedding array<float>, score int, v int, point int"


def brute(rows, k=5, every=50):
    """(vec_id, embedding) rows to (query_id, rank, vec_id, score)."""
    good = {(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, q in good:
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if len(v) == len(q) and (j, v) != (i, q))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found[:k])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def float32(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("numbers", [1 << 18, 256])
def test_hard_vectors(spark, monkeypatch, numbers):
    """Nulls, odd components, ties, repeated rows, copies of one vector, several widths; in one
    shard and in many."""
    monkeypatch.setattr(topk, "SHARD_NUMBERS", numbers)
    monkeypatch.setattr(topk, "LEAF", 8)
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(300)] + [(k, [0.5, -0.25, 0.0, 0.125, 1.0, 0.75]) for k in range(300, 520)]
    rows += [(k, rng.integers(-1, 2, 3).tolist()) for k in range(600, 700)] + [(700, [1.5]), (701, []), (750, []), (800, [2.0])]
    rows += [(50, rows[50][1]), (50, rows[51][1]), (100, [0.0] * 6), (None, [1.0] * 6), (850, None), (900, [1.0, None] * 3), (901, [float("nan")] * 6), (950, [float("inf")] * 6), (1000, [1000.0, -2000.0] * 3)]
    rows = float32(rows)
    table = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], SCHEMA)
    assert rows_of(topk.top_products(table)) == brute(rows)
    assert rows_of(topk.top_products(table, k=1, every=7)) == brute(rows, 1, 7)
    assert topk.top_products(table.filter("false")).count() == 0


def test_vectors_are_never_broadcast(spark, monkeypatch):
    """Neither trees nor the queries sent to them go through the driver, nor what questions are
    looked up in."""
    monkeypatch.setattr(topk, "SHARD_NUMBERS", 256)
    rng, plans = np.random.default_rng(6), {}
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    stored, answered = topk.stored, topk._answered
    monkeypatch.setattr(topk, "stored", lambda df, name, *a: plans.setdefault(name, plan_of(df)) and stored(df, name, *a))
    monkeypatch.setattr(topk, "_answered", lambda sent, k: plans.setdefault("sent", plan_of(sent)) and answered(sent, k))
    rows = float32([(k, rng.normal(size=6).tolist()) for k in range(300)])
    found = topk.top_products(spark.createDataFrame([(*r, 0, 0, 0) for r in rows], SCHEMA))
    assert rows_of(found) == brute(rows)
    for name in ("sent", "vector-questions"):
        assert "SortMergeJoin" in plans[name]
    assert not re.search(r"BroadcastHashJoin \[width#\d+, cluster#\d+, part#\d+\]", plans["sent"])
    assert "BroadcastHashJoin" not in plans["vector-questions"]


def test_large_numbers_are_exact():
    rng = np.random.default_rng(2)
    v = rng.integers(-(1 << 29), 1 << 29, (200, 4))
    scores, names = topk.Ball(v, [np.array([k]) for k in range(200)]).search(v[:9], np.full(9, topk._NONE), 4)
    for q, s, n in zip(v[:9].tolist(), scores.tolist(), names.tolist()):
        assert list(zip(s, n)) == [(-a, b) for a, b in sorted((-sum(x * y for x, y in zip(q, p)), k) for k, p in enumerate(v.tolist()))[:4]]


def test_far_nodes_are_not_entered(monkeypatch):
    """Of clustered vectors a query looks at few leaves, and a known score that nothing reaches
    closes the whole tree."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(16, 8)) * 4000
    v = (centre[np.arange(4096) % 16] + rng.normal(size=(4096, 8)) * 20).astype(np.int64)
    tree = topk.Ball(v, [np.array([k]) for k in range(len(v))])
    tree = topk.Ball.unpacked(8, tree.packed())
    seen, real = [], np.lexsort
    monkeypatch.setattr(topk.np, "lexsort", lambda *a, **b: seen.append(1) or real(*a, **b))
    tree.search(v[:1], np.full(1, topk._NONE), 5)
    assert 0 < len(seen) <= len([n for n in tree.nodes if not n[2]]) // 4
    seen.clear()
    tree.search(v[:8], np.full(8, 1 << 50), 5)
    assert not seen


def test_query_equals_sql_and_all_products(spark, small, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_NUMBERS", 64 * 100)
    medium = "/root/testdata/sf0.01"
    found = rows_of(queries.op13_exact_top_products(spark, medium))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{medium}/embeddings.parquet'")
    assert found == sorted(con.sql(f"SELECT query_id, rank, vec_id, score FROM ({queries.oracle_sql()['op13_exact_top_products']})").fetchall())
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{medium}/embeddings.parquet").collect()]
    assert found == brute(rows)
    held = defaultdict(list)
    for q, rank, *_ in found:
        held[q].append(rank)
    assert all(sorted(r) == [1, 2, 3, 4, 5] for r in held.values())
