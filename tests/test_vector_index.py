"""The inverted file against the exact search."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import retrieval, vector_index
from quillgraph.operators.vector_index import VectorIndex
from quillgraph.queries import REGISTRY
from quillgraph.sources.tables import materialized


def store(name, build):
    return materialized(build(), name)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    """Every id divisible by 100 against all rows: recall at 40, and fewer vectors read than there are."""
    rows = REGISTRY["vector_index_recall"](spark, f"/root/testdata/{sf}").collect()
    n = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    assert len(rows) == n.filter("vec_id % 100 = 0").count()
    assert sum(r.n_found for r in rows) >= 0.9 * sum(r.n_true for r in rows)
    assert all(r.n_true == 40 for r in rows) and all(0 < r.n_read <= n.count() for r in rows)
    found = REGISTRY["vector_topk_indexed"](spark, f"/root/testdata/{sf}")
    exact = REGISTRY["vector_topk"](spark, f"/root/testdata/{sf}")
    assert found.count() == exact.count()


def test_clustered_vectors_read_few_lists(spark, monkeypatch):
    """A third of the rows are one vector: its list lies in several blocks, and nothing is lost."""
    monkeypatch.setattr(vector_index, "BLOCK", 50)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(20, 12))
    v = centre[np.arange(1200) % 20] + rng.normal(size=(1200, 12)) * 0.05
    v[::3] = centre[0]
    table = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>")
    index = VectorIndex.of(table, store, lists=20, k=10)
    assert index.blocks.agg(F.sum("n")).first()[0] == 1200 and index.blocks.groupBy("list").count().agg(F.max("count")).first()[0] >= 8
    asked = table.filter("vec_id % 50 = 0")
    exact = {(r.query_id, r.vec_id) for r in retrieval.vector_topk(table, asked, 10).collect()}
    found = index.search(asked, 10).collect()
    assert len(exact & {(r.query_id, r.id) for r in found}) >= 0.95 * len(exact)
    assert max(r.n_read for r in found) < 1200
    every = {(r.query_id, r.id) for r in index.search(asked, 10, probes=20).collect()}
    assert every == exact


def test_odd_vectors(spark):
    rows = [(k, [float(k % 5), 1.0, -1.0]) for k in range(40)] + [(50, None), (51, []), (52, [0.0] * 3), (53, [1.0, None, 2.0]), (54, [float("nan"), 1.0, 1.0]), (60, [1.0, 2.0]), (61, [2.0, 4.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = VectorIndex.of(table, store, k=3)
    found = {(r.query_id, r.id, round(r.similarity, 6)) for r in index.search(table.filter("vec_id in (0, 50, 51, 52, 53, 54, 60)"), 3, probes=99).collect()}
    assert found == {(0, 0, 1.0), (0, 5, 1.0), (0, 10, 1.0), (60, 60, 1.0), (60, 61, 1.0)}
    empty = VectorIndex.of(table.filter("false"), store)
    assert empty.search(table, 3).count() == 0


def test_batches_stay_small(spark, monkeypatch):
    """What is packed for the lists leaves in small batches, and nothing is lost by that."""
    monkeypatch.setattr(vector_index, "HELD", 64)
    monkeypatch.setattr(vector_index, "BATCH_BYTES", 4096)
    rng = np.random.default_rng(6)
    table = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(rng.normal(size=(400, 8)))], "vec_id long, embedding array<float>")
    index = VectorIndex.of(table, store, lists=30, k=5)
    exact = {(r.query_id, r.vec_id) for r in retrieval.vector_topk(table, table, 5).collect()}
    assert {(r.query_id, r.id) for r in index.search(table, 5, probes=30).collect()} == exact
    seen = index.probed(table, probes=30).mapInArrow(lambda batches: (vector_index.pa.RecordBatch.from_pydict({"n": [sum(map(len, b.column("asked_vectors").to_pylist()))]}) for b in batches), "n long")
    assert sum(r.n for r in index.probed(table, probes=30).select(F.length("asked_vectors").alias("n")).collect()) == 400 * 30 * 64
    assert seen.agg(F.sum("n")).first()[0] == 400 * 30 * 64 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"


def test_few_similarities_are_sorted(monkeypatch):
    """The k best of each row as by a sort of all, with ties, gaps and few columns, from a sort of few."""
    rng = np.random.default_rng(2)
    near = np.round(rng.random((20, 3000)), 3)
    near[3, :40], near[4], near[5, 7] = np.nan, np.nan, 2
    keys = rng.permutation(3000)
    whole = [np.lexsort((keys, -np.round(row, 9)))[:10].tolist() for row in near]
    sizes, sort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda by: sizes.append(len(by[0])) or sort(by))
    assert [order.tolist() for order in retrieval._nearest(near, keys, 10)] == whole
    assert sorted(sizes)[-2] < 100
    assert [order.tolist() for order in retrieval._nearest(near[:, :3], keys[:3], 10)] == [sort((keys[:3], -np.round(row, 9))).tolist() for row in near[:, :3]]
    assert [order.tolist() for order in retrieval._nearest(near[:2, :0], keys[:0], 10)] == [[], []]
