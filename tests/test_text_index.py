"""The inverted index against scoring every section, and vector search over mixed widths."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.config import Settings
from quillgraph.operators import retrieval, text_index
from quillgraph.plans.views import Graph
from quillgraph.sources.tables import materialized


def store(name, build):
    return materialized(build(), name)


@pytest.fixture(scope="module")
def graph(spark):
    return Graph(spark, "/root/testdata/sf0.01")


@pytest.fixture()
def fine(monkeypatch):
    """Many small ranges, so that bounds have something to rule out."""
    monkeypatch.setattr(text_index, "SETTINGS", Settings(range_sections=16, seed_ranges=2))


def ranked(rows):
    return [(r._id, round(r.relevance_score, 9)) for r in rows]


def test_top_equals_all_scores(spark, graph, fine):
    sections = graph.sections.select("_id", "content").cache()
    index = text_index.TextIndex.of(sections, store)
    asked = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").filter("role = 'user' and conv_id < 3").select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), F.col("text").alias("query"))
    found, scores = index.top(asked).cache(), index.all_scores(asked).cache()
    for q in asked.collect():
        want = retrieval.top_sections(sections, q.query).collect()
        assert ranked(found.filter(F.col("query_id") == q.query_id).orderBy("place").collect()) == ranked(want)
        every = retrieval.bm25(sections, q.query)
        own = scores.filter(F.col("query_id") == q.query_id)
        assert own.count() == every.count()
        assert own.join(every.withColumnRenamed("relevance_score", "s"), "_id").filter(F.abs(F.col("s") - F.col("relevance_score")) > 1e-9).isEmpty()


def test_ranges_are_ruled_out(spark, fine):
    """One text is by far the best: of the ranges that hold the word most are never read."""
    rows = [(f"{k}:1", "alpha " + " ".join(f"w{k}x{j}" for j in range(30))) for k in range(400)] + [("best:1", "alpha"), ("next:1", "alpha alpha alpha beta")]
    texts = spark.createDataFrame(rows, "_id string, content string")
    index = text_index.TextIndex.of(texts, store)
    read = []

    def noted(name, build):
        out = store(name, build)
        read.append((name, out.count()))
        return out

    asked = spark.createDataFrame([("q", "alpha"), ("none", "gamma ."), ("null", None)], "query_id string, query string")
    assert ranked(index.top(asked, 1, noted).collect()) == ranked(retrieval.top_sections(texts, "alpha", 1).collect())
    seen = dict(read)["question-scores"]
    assert 0 < seen < 200 and dict(read)["question-bounds"] > 10


def test_odd_texts(spark):
    rows = [("a", None), ("b", ""), ("c", "..."), ("d", "One two two"), ("e", "two"), ("f", "two"), ("g", "x " * 5000 + "two")]
    texts = spark.createDataFrame(rows, "_id string, content string")
    index = text_index.TextIndex.of(texts, store)
    asked = spark.createDataFrame([(1, "two TWO"), (1, "two TWO")], "query_id int, query string")
    assert [r._id for r in index.top(asked, 3).orderBy("place").collect()] == ["d", "e", "f"]
    empty = text_index.TextIndex.of(texts.filter("false"), store)
    assert empty.top(asked).count() == 0 and empty.all_scores(asked).count() == 0


def test_search_reads_no_document(spark, graph):
    """The plan of a search reads the index and the stored sections alone."""
    question = graph.sections.filter("length(content) > 60").orderBy("_id").first().content
    best = retrieval.indexed_sections(graph.index, graph.collection, question)
    response = retrieval.search_response(question, graph.sections, graph.documents, graph.entities, graph.edges, top=best)
    plan = response._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "In(_id" in plan
    old = retrieval.search_response(question, graph.sections, graph.documents, graph.entities, graph.edges).first()
    new = response.first()
    assert [s.section_id for s in new.sources] == [s.section_id for s in old.sources] and new.graph_paths == old.graph_paths


def test_vectors_of_several_widths(spark):
    """A stray vector, or a stray query, of another width changes nothing for the others."""
    rows = [(k, [float(k % 7), 1.0, float(k % 3), 2.0]) for k in range(50)]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    mixed = spark.createDataFrame([*rows, (99, [1.0] * 5), (98, [1.0, 2.0]), (97, []), (96, [1.0, None, 1.0, 1.0])], "vec_id long, embedding array<float>")
    asked = "vec_id in (0, 10, 20, 99)"
    keyed = lambda df: {(r.query_id, r.vec_id, round(r.similarity, 9)) for r in df.collect()}
    before = keyed(retrieval.vector_topk(plain, plain.filter(asked), 5))
    after = keyed(retrieval.vector_topk(mixed, mixed.filter(asked), 5))
    assert len(before) == 15 and after == before | {(99, 99, 1.0)}


def test_few_words_leave_the_postings_in_place(spark):
    """Texts are shuffled once to be indexed, and no posting is to score one question."""
    rows = [(f"{k}:1", " ".join(f"w{(k * j) % 97}" for j in range(20))) for k in range(300)]
    texts, made = spark.createDataFrame(rows, "_id string, content string"), {}

    def noted(name, build):
        made[name] = build()
        return store(name, lambda: made[name])

    index = text_index.TextIndex.of(texts, noted)
    assert made["section-index-postings"]._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    found = index.all_scores(spark.createDataFrame([(1, "w5 w7")], "query_id int, query string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning(term" not in plan
    assert found.count() == sum(bool({"w5", "w7"} & set(text.split())) for _, text in rows)


def test_many_questions_meet_texts_in_blocks(spark, graph, fine, monkeypatch):
    """No row for a word of a question in a text is shuffled, and the results are those of bounds."""
    sections = graph.sections.select("_id", "content").cache()
    index = text_index.TextIndex.of(sections, store)
    asked = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").filter("role = 'user' and conv_id < 20").select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), F.col("text").alias("query"))
    keyed = lambda df: sorted((r.query_id, r.place, r._id, round(r.relevance_score, 8)) for r in df.collect())
    monkeypatch.setattr(text_index, "FEW", 1 << 40)
    want = keyed(index.top(asked))
    monkeypatch.setattr(text_index, "FEW", 0)
    for name, value in (("QUESTION_BLOCK", 7), ("MET_RANGES", 50), ("AT_A_TIME", 5)):
        monkeypatch.setattr(text_index, name, value)
    found = index.top(asked)
    assert keyed(found) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "inline(" not in plan
    odd = spark.createDataFrame([("none", "qqqqzzzz"), ("null", None)], "query_id string, query string")
    assert index.top(odd).count() == 0
    assert text_index.TextIndex.of(sections.filter("false"), store).top(asked).count() == 0
    # Of copies with one score those of the least ids stay.
    same = text_index.TextIndex.of(spark.createDataFrame([(f"c{i:02d}", "alpha beta") for i in range(30)], "_id string, content string"), store)
    assert [r._id for r in same.top(spark.createDataFrame([(1, "alpha")], "query_id int, query string"), 3).orderBy("place").collect()] == ["c00", "c01", "c02"]


def test_many_questions_are_shuffled_to_few_blocks(spark, graph, fine, monkeypatch):
    """A question goes to a few blocks of ranges and not to each eight ranges, a range to one block of
    questions, in one row with each text, term and length once."""
    monkeypatch.setattr(text_index, "FEW", 0)
    sections = graph.sections.select("_id", "content").cache()
    index = text_index.TextIndex.of(sections, store)
    asked = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").filter("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), F.col("text").alias("query"))
    plan = index.top(asked)._jdf.queryExecution().analyzed().toString()
    copies = [int(x) + 1 for x in re.findall(r"explode\(sequence\(0, (\d+)", plan)]
    ranges, cores = index.about.first().ranges, spark.sparkContext.defaultParallelism
    assert ranges > 200 and sorted(copies) == [1, max(-(-ranges // 128), 2 * cores)]
    packed, held = index.packed, index.postings
    assert packed.count() == packed.select("range").distinct().count() == held.select("range").distinct().count()
    assert packed.select(F.explode("names")).distinct().count() == packed.agg(F.sum(F.size("names"))).first()[0] == held.select(F.explode("entries._id")).distinct().count()
    size = packed.agg(F.sum(F.octet_length("at") + F.octet_length("tf"))).first()[0]
    assert size < 3 * held.agg(F.sum("n")).first()[0]


def test_best_scores_equal_sorting_them_all():
    rng = np.random.default_rng(8)
    for n in (0, 1, 9, 160, 161, 5000):
        for scores in (rng.integers(0, 40, n) / 8, np.where(rng.random(n) < 0.01, rng.random(n), 0), rng.random(n), np.zeros(n), 1 + rng.random(n) * 1e-10):
            for k in (1, 10):
                want = [p for p in np.lexsort((np.arange(n), -np.round(scores, 9))) if scores[p] > 0][:k]
                assert text_index._best(scores.astype(float), k).tolist() == want


def test_vectors_meet_in_few_blocks(spark, monkeypatch):
    """Vectors aren't shuffled once for each few hundred queries, nor in double precision."""
    vectors = spark.range(20_000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.sin(k + F.col("id")).cast("float")).alias("embedding"))
    plan = retrieval.vector_topk(vectors, vectors, 5)._jdf.queryExecution().analyzed().toString()
    copies = sorted(int(x) + 1 for x in re.findall(r"explode\(sequence\(0, (\d+)", plan))
    assert copies == [2, max(3, spark.sparkContext.defaultParallelism)] and "array<double>" not in plan
