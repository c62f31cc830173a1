"""The set-similarity join against all pairs, in Python."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from quillgraph.config import SETTINGS
from quillgraph.operators import setjoin
from quillgraph.plans import views
from quillgraph.plans.views import Graph


def brute(rows, threshold):
    held, marks = defaultdict(set), {}
    for name, element, mark in rows:
        held[name].add(element)
        marks[element] = mark
    out, names = set(), sorted(held)
    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            both = held[a] & held[b]
            if both and len(both) / len(held[a] | held[b]) >= threshold:
                out.add((a, b, len(held[a]), len(held[b]), len(both), sum(marks[e] for e in both)))
    return out


def made(seed):
    """Sets of all sizes, families of likes, one element that every set has and one set of all."""
    rnd = random.Random(seed)
    rows = set()
    for family in range(12):
        core = rnd.sample(range(200), rnd.randint(1, 30))
        for k in range(rnd.randint(1, 6)):
            kept = [e for e in core if rnd.random() < 0.85] + rnd.sample(range(200), rnd.randint(0, 4))
            rows |= {(f"s{family}.{k}", e) for e in kept}
    rows |= {(n, 999) for n in {r[0] for r in rows}} | {("whole", e) for e in range(200)} | {("half", e) for e in range(0, 200, 2)} | {("twin", e) for e in range(200) if e % 7}
    return [(n, e, e % 3) for n, e in sorted(rows)]


@pytest.mark.parametrize("threshold", [0.25, 0.5, 0.8, 1.0])
def test_pairs_equal_brute_force(spark, monkeypatch, threshold):
    monkeypatch.setattr(setjoin, "ELEMENT_BLOCK", 7)
    monkeypatch.setattr(setjoin, "SET_BLOCK", 16)
    monkeypatch.setattr(setjoin, "CLASSES", 2)
    rows = made(int(threshold * 100))
    found = setjoin.similar_sets(spark.createDataFrame(rows, "name string, e int, mark int"), threshold, element=("e",), sums=("mark",))
    assert {tuple(r) for r in found.select("a", "b", "n_a", "n_b", "n_together", "mark").collect()} == brute(rows, threshold)
    assert found.count() == len(brute(rows, threshold))


def test_bounds_and_empty_tables(spark):
    none = spark.createDataFrame([], "name string, document_id string, order int")
    assert setjoin.similar_sets(none, 0.5).count() == 0
    for bad in (0, -1, 1.5):
        with pytest.raises(ValueError):
            setjoin.similar_sets(none, bad)


def test_relationships_equal_all_pairs(spark):
    """Every pair at the floor, wherever the two stand in a section."""
    g = Graph(spark, "/root/testdata/sf0.01")
    names = {r.name for r in g.entities.collect()}
    rows = [(r.name, (r.document_id, r.order), 0) for r in g.mentions.collect() if r.name in names]
    found = {(r.source_entity, r.target_entity, r.n_together, r.n_either) for r in g.relationships.collect()}
    assert found == {(a, b, n, x + y - n) for a, b, x, y, n, _ in brute(rows, SETTINGS.relationship_floor)}
    assert sum(n / e >= 0.5 for *_, n, e in found) > 1000


def test_what_is_written_follows_the_postings(spark, monkeypatch):
    """Most pairs of sets meet somewhere and hardly any are alike: none of them is written."""
    rnd, written = random.Random(5), []
    rows = [(f"s{k:03}", e, 1) for e in range(60) for k in rnd.sample(range(100), 20)]
    kept = setjoin.materialized

    def counted(df, name):
        out = kept(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(setjoin, "materialized", counted)
    found = setjoin.similar_sets(spark.createDataFrame(rows, "name string, e int, mark int"), 0.3, element=("e",), sums=("mark",))
    assert {tuple(r) for r in found.select("a", "b", "n_a", "n_b", "n_together", "mark").collect()} == brute(rows, 0.3)
    assert sum(written) < len(rows)


def test_relationships_read_mentions_once_and_bound_the_counting_tasks(spark, monkeypatch):
    """Nothing of the mentions' size is written, and lists go to as many tasks as postings ask for."""
    rows, written = made(3), []
    kept = setjoin.materialized
    mentions = spark.createDataFrame([(n, "d", e, 1 << e % 8, 0) for n, e, _ in rows], "name string, document_id string, order int, cues int, place int")
    sizes = mentions.groupBy("name").count()
    entities = sizes.filter("name != 'half'").select("name", sizes["count"].alias("n_sections"))

    def counted(df, name):
        out = kept(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(setjoin, "materialized", counted)
    monkeypatch.setattr(views, "materialized", counted)
    monkeypatch.setattr(setjoin, "TASK_POSTINGS", 10)
    found = views.relationships(mentions, entities)
    total = sum(n != "half" for n, *_ in rows)
    assert f", {-(-total // 10)}), REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert sum(written) <= entities.count()
    wanted = {(a, b, n, x + y - n) for a, b, x, y, n, _ in brute([r for r in rows if r[0] != "half"], SETTINGS.relationship_floor)}
    assert {(r.source_entity, r.target_entity, r.n_together, r.n_either) for r in found.collect()} == wanted


def test_pairs_of_repeated_and_missing_ids(spark, tmp_path):
    """Sections of documents with one id count once, and those of documents without an id meet
    nothing; no pair at the floor is lost and no strength is above 1."""
    texts = {k: f"alphabet betaword\ngammawo{k % 2}a betaword examples" for k in range(12)} | {20: "alphabet betaword deltaword", 21: "deltaword omegaword\nalphabet"}
    docs = [(k, t) for k, t in texts.items() for _ in range(1 + k % 3)] + [(20, "omegaword significant deltaword")] + [(None, "alphabet omegaword"), (None, "deltaword gammawo1a")]
    spark.createDataFrame([(*d, len(d[1])) for d in docs], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    g = Graph(spark, str(tmp_path))
    held, where = set(), defaultdict(set)
    for d, t in docs:
        for order, line in enumerate(t.split("\n")):
            held |= {(w, (d, order), 0) for w in line.split() if len(w) >= SETTINGS.entity_letters}
    for name, (d, _), _ in held:
        where[name].add(d)
    names = {n for n, ids in where.items() if len(ids - {None}) >= SETTINGS.entity_documents}
    size = {n: sum(w == n for w, *_ in held) for n in names}
    assert {(r.name, r.frequency, r.n_sections) for r in g.entities.collect()} == {(n, len(where[n] - {None}), size[n]) for n in names}
    together = {(a, b): n for a, b, _, _, n, _ in brute([r for r in held if r[0] in names and r[1][0] is not None], 1e-9)}
    wanted = {(a, b, n, size[a] + size[b] - n) for (a, b), n in together.items() if n / (size[a] + size[b] - n) >= SETTINGS.relationship_floor}
    found = g.relationships.collect()
    assert len(wanted) > 1 and {(r.source_entity, r.target_entity, r.n_together, r.n_either) for r in found} == wanted
    assert all(0 < r.strength <= 1 for r in found)
