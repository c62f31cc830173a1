"""Strongest paths, spreading and fusion against enumeration and dense matrices."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import graph, spreading
from quillgraph.plans.views import Graph, edges


def enumerated(linked, seeds, hops, least):
    """Every simple path from the seeds; of each pair the strongest, shortest, first."""
    out, best = defaultdict(list), {}
    for a, b, s in linked:
        out[a].append((b, s))
    held = [([s], 1.0) for s in seeds]
    for _ in range(hops):
        held = [([*p, b], x * s) for p, x in held for b, s in out[p[-1]] if b not in p and x * s >= least]
        for p, x in held:
            rank = (-x, len(p), p)
            if (p[0], p[-1]) not in best or rank < best[p[0], p[-1]]:
                best[p[0], p[-1]] = rank
    return {(a, b, tuple(p), n - 1, -x) for (a, b), (x, n, p) in best.items()}


def rows_of(df):
    return {(r.seed, r.name, tuple(r.path), r.hops, r.total_strength) for r in df.collect()}


@pytest.mark.parametrize("block", [4096, 2])
def test_strongest_paths_of_a_small_graph(spark, monkeypatch, block):
    """Ties, cycles of strength one, a hub in several blocks, a seed without edges."""
    monkeypatch.setattr(graph, "EDGE_BLOCK", block)
    rnd = random.Random(6)
    names = [f"n{k}" for k in range(18)]
    pairs = {tuple(sorted(rnd.sample(names, 2))) for _ in range(40)} | {("hub", n) for n in names}
    rows = [(a, b, rnd.choice([0.5, 0.7, 0.8, 0.9, 1.0, 1.0])) for a, b in sorted(pairs)]
    linked = edges(spark.createDataFrame(rows, "source_entity string, target_entity string, strength double"))
    both = [tuple(r) for r in linked.select("source_entity", "target_entity", "strength").collect()]
    seeds = spark.createDataFrame([("n1",), ("hub",), ("hub",), ("alone",)], "name string")
    way = graph.Adjacency.of(linked)
    for hops in (0, 1, 2, 4):
        found = graph.strongest_paths(way, seeds, hops, 0.5)
        assert rows_of(found) == enumerated(both, ["n1", "hub", "alone"], hops, 0.5)
        assert found.count() == found.select("seed", "name").distinct().count()
    with pytest.raises(ValueError):
        graph.strongest_paths(way, seeds, -1)


def test_strongest_paths_equal_enumeration(spark):
    g = Graph(spark, "/root/testdata/sf0.01")
    both = [tuple(r) for r in g.edges.select("source_entity", "target_entity", "strength").collect()]
    seeds = sorted({a for a, *_ in both})[::25]
    found = graph.strongest_paths(g.adjacency, spark.createDataFrame([(s,) for s in seeds], "name string"))
    assert rows_of(found) == enumerated(both, seeds, 3, 0.5)


@pytest.mark.parametrize("block", [4096, 2])
def test_spread_equals_matrices(spark, monkeypatch, block):
    monkeypatch.setattr(graph, "EDGE_BLOCK", block)
    rows = [("a", "b", 0.9), ("a", "c", 0.6), ("b", "c", 0.5), ("c", "d", 1.0), ("d", "e", 0.7), ("x", "y", 0.8)]
    linked = edges(spark.createDataFrame(rows, "source_entity string, target_entity string, strength double"))
    names = ["a", "b", "c", "d", "e", "x", "y", "lonely"]
    m = np.zeros((8, 8))
    for r in linked.collect():
        m[names.index(r.source_entity), names.index(r.target_entity)] = r.strength
    move = m / np.where(m.sum(1) > 0, m.sum(1), 1)[:, None]
    asked = [("q", "a"), ("q", "x"), ("q", "a"), ("r", "lonely"), ("r", "d")]
    found = spreading.spread(graph.Adjacency.of(linked), spark.createDataFrame(asked, "query_id string, name string"), 3, 0.15).collect()
    for q in ("q", "r"):
        start = np.zeros(8)
        start[[names.index(n) for n in {n for p, n in asked if p == q}]] = 0.5
        now = start
        for _ in range(3):
            now = 0.15 * start + 0.85 * now @ move
        held = {r.name: r.mass for r in found if r.query_id == q}
        assert {names[k] for k in np.flatnonzero(now)} == set(held)
        assert all(abs(held[names[k]] - now[k]) < 1e-12 for k in np.flatnonzero(now))
    assert spreading.spread(graph.Adjacency.of(linked), spark.createDataFrame([], "query_id string, name string")).count() == 0


def test_fusion(spark):
    lists = [[("q", "d1", 1), ("q", "d2", 2)], [("q", "d2", 1), ("q", "d3", 2)], [("r", "d9", 1)], []]
    frames = [spark.createDataFrame(x, "query_id string, document_id string, place int") for x in lists]
    found = [(r.query_id, r.document_id, r.place) for r in spreading.fused(frames, 2, 60).orderBy("query_id", "place").collect()]
    assert found == [("q", "d2", 1), ("q", "d1", 2), ("r", "d9", 1)]


def test_path_records(spark):
    rows = [("a", "b", "uses", 0.9), ("b", "c", "causes", 0.8)]
    related = spark.createDataFrame(rows, "source_entity string, target_entity string, relationship_type string, strength double")
    entities = spark.createDataFrame([(n, "tool", "other", 5) for n in "abc"], "name string, entity_type string, category string, frequency long")
    paths = spark.createDataFrame([(["c", "b", "a"], 0.72), (["a", "b"], 0.9)], "path array<string>, total_strength double")
    found = {tuple(r.path): r for r in graph.path_records(paths, entities, related).collect()}
    assert [e.name for e in found["c", "b", "a"].entities] == ["c", "b", "a"]
    assert [x.relationship_type for x in found["c", "b", "a"].relationships] == ["causes", "uses"]
    assert [x.relationship_type for x in found["a", "b"].relationships] == ["uses"]
