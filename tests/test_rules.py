"""Rules that the generated tables don't reach, on rows made by hand."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillgraph.config import SETTINGS
from quillgraph.functions import scalars
from quillgraph.operators import graph, listing, mutations, retrieval, validation
from quillgraph.plans import views
from quillgraph.plans.views import Graph, edges
from quillgraph.schemas import DOCUMENT
from quillgraph.sources import tables

def now():
    return F.timestamp_seconds(F.lit(1_700_000_000))


def values(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


@pytest.fixture()
def names(spark):
    return spark.createDataFrame([("a", "method"), ("b", "tool"), ("c", "method"), ("d", None)], "name string, entity_type string")


def test_empty_filter_asks_for_nothing(names):
    assert listing.matching(names, entity_type="").count() == 4
    assert listing.matching(names, entity_type=None).count() == 4
    assert listing.matching(names, entity_type="nothing").count() == 0


def test_paging_edges(names):
    assert listing.page(names, ["name"], 0, 0).count() == 4
    assert listing.page(names, ["name"], 9, 2).count() == 0
    for bad in ((-1, 1), (0, -1)):
        with pytest.raises(ValueError):
            listing.page(names, ["name"], *bad)


def test_pages_make_up_the_listing(spark, small):
    docs = Graph(spark, small).documents
    pages = [r._id for k in range(0, 200, 70) for r in listing.list_documents(docs, k, 70).collect()]
    assert pages == sorted(r._id for r in docs.select("_id").collect())


def test_uploads(spark):
    rows = [("a.pdf", 1), ("b.txt", None), ("c.docx", 52_428_800), ("d.PDF", 1), ("e.exe", 1), ("", 1), (None, 1), ("f.pdf", 52_428_801)]
    checked = validation.validated_uploads(spark.createDataFrame(rows, "filename string, file_size long"))
    assert [r.reason for r in checked.collect()] == [None, None, None, "bad_type", "bad_type", "bad_type", "bad_type", "too_large"]
    made = mutations.new_documents(checked, now()).collect()
    assert [r.title for r in made][5:7] == [SETTINGS.default_title] * 2
    assert made[1].file_size is None and {r.status for r in made} == {"uploaded"}
    assert [f.name for f in mutations.new_documents(checked, now()).schema] == [f.name for f in DOCUMENT]


def test_update_and_delete(spark, small):
    docs = Graph(spark, small).documents
    patch = spark.createDataFrame([("7", "New", None), ("none", "X", 1)], "_id string, title string, year int")
    changed = mutations.update_result(docs, patch, now()).collect()
    assert [(r._id, r.title, r.year) for r in changed] == [("7", "New", 2007)]
    assert changed[0].updated_at == dt.datetime(2023, 11, 14, 22, 13, 20)
    assert mutations.updated(docs, patch, now()).count() == docs.count()
    once = mutations.deleted(docs, patch)
    assert mutations.deleted(once, patch).count() == once.count() == docs.count() - 1


def test_latest_status(spark, small):
    docs = Graph(spark, small).documents
    at = dt.datetime(2024, 5, 1)
    log = spark.createDataFrame([("7", "processing", at, 1), ("7", "failed", at, 2), ("no such", "failed", at, 3)], "document_id string, status string, at timestamp, seq long")
    after = mutations.with_latest_status(docs, log)
    assert after.count() == docs.count()
    assert after.filter("_id = '7'").first().status == "failed"


def test_progress_percent(spark):
    docs = spark.createDataFrame([("x", "uploaded"), ("y", "failed")], "_id string, status string")
    assert [r.current for r in mutations.processing_progress(docs).orderBy("step").collect()] == [14, 28, 42, 57, 71, 85, 100]


def test_relationship_checks(spark):
    rows = [("a", "b", "uses", -0.1), ("a", "b", "uses", 0.0), ("a", "b", "uses", 1.0), ("a", "b", "uses", 1.1), ("a", "b", "likes", 0.5), (None, "b", "uses", 0.5), ("a", "b", None, None)]
    checked = validation.validated_relationships(spark.createDataFrame(rows, "source_entity string, target_entity string, relationship_type string, strength double"))
    assert [r.reason for r in checked.collect()] == ["bad_strength", None, None, "bad_strength", "bad_type", "missing_end", "bad_type"]


def test_dois(spark):
    docs = spark.createDataFrame([("1", None), ("2", None), ("3", "x"), ("4", "x"), ("5", "y")], "_id string, doi string")
    assert values(validation.doi_duplicates(docs), "doi", "n", "keeper") == [("x", 2, "3")]


def test_blank_queries(spark):
    asked = spark.createDataFrame([("  ",), (" a ",), (None,)], "text string")
    assert [(r.query, r.valid) for r in validation.validated_queries(asked, "text").collect()] == [("", False), ("a", True), ("", False)]


def test_paths_are_simple_and_bounded(spark):
    rows = [("a", "b", 0.9), ("b", "c", 0.8), ("c", "a", 0.7), ("c", "d", 0.4), ("e", "e", 1.0)]
    linked = edges(spark.createDataFrame(rows, "source_entity string, target_entity string, strength double"))
    seeds = spark.createDataFrame([("a",), ("e",)], "name string")
    found = {r.p: round(r.total_strength, 6) for r in graph.paths(linked, seeds).select(F.array_join("path", "").alias("p"), "total_strength").collect()}
    assert found == {"ab": 0.9, "ac": 0.7, "abc": 0.72, "acb": 0.56}
    assert graph.paths(linked, seeds, max_hops=0).count() == 0


def test_missing_and_unknown_fields(spark):
    out = tables.conformed(spark.createDataFrame([("1", 2)], "_id string, extra int"), DOCUMENT).first()
    assert out._id == "1" and out.title is None and "extra" not in out.asDict()


def test_views_of_hard_texts(spark, tmp_path):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "\n\n \nword " + "elephant " * 3000, None, None, 1)] + [(k, "elephant crocodile\nelephant", "en", "s", 1) for k in range(4, 12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    g = Graph(spark, str(tmp_path))
    assert g.sections.count() == 17
    assert values(g.entities, "name", "frequency", "n_sections") == [("crocodile", 8, 8), ("elephant", 9, 17)]
    assert values(g.relationships, "source_entity", "target_entity", "n_together", "n_either") == [("crocodile", "elephant", 8, 17)]
    none = spark.read.parquet(f"{tmp_path}/documents.parquet").filter("doc_id < 0")
    none.write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert Graph(spark, f"{tmp_path}/empty").relationships.count() == 0


def test_search_without_words(spark, small):
    g = Graph(spark, small)
    assert retrieval.bm25(g.sections, " .,; ").count() == 0
    row = retrieval.search_response("nosuchword", g.sections, g.documents, g.entities, g.edges).first()
    assert row.sources == [] and row.graph_paths == [] and row.answer is None


def test_vectors(spark, monkeypatch):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, None), (5, [3.0, 0.0]), (6, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = table.filter("vec_id in (1, 2, 3, 4)")
    for block in (8192, 2):
        monkeypatch.setattr(retrieval, "VECTOR_BLOCK", block)
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        found = values(retrieval.vector_topk(table, asked, 2), "query_id", "vec_id", F.round("similarity", 6))
        assert found == [(1, 1, 1.0), (1, 5, 1.0), (2, 2, 1.0), (2, 6, 0.707107)]
    assert retrieval.vector_topk(table.filter("false"), asked).count() == 0


def test_repeated_patch_rows_and_cleared_fields(spark, small):
    docs = Graph(spark, small).documents
    patch = spark.createDataFrame([("7", "A", 1), ("7", "B", None), ("7", "B", None), ("8", None, None), ("8", None, None)], "_id string, title string, year int")
    kept = values(mutations.update_result(docs, patch, now()), "_id", "title", "year")
    assert kept == [("7", "B", 2007), ("8", "Document 8", 2008)]
    assert values(mutations.update_result(docs, patch, now(), assigned=("year",)), "_id", "title", "year") == [("7", "B", None), ("8", "Document 8", None)]
    assert mutations.updated(docs, patch, now()).count() == docs.count()


def test_evidence_of_kinds(spark, tmp_path):
    text = "hepatitis penicillin treats\nreadings reading\nwindmills aardvark"
    rows = [(k, text, "en", "s", 1) for k in range(6)] + [(9, "Hepatitis HEPATITIS aardvark windmills uses", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    g = Graph(spark, str(tmp_path))
    assert {(r.name, r.entity_type, r.category) for r in g.entities.collect()} >= {("hepatitis", "disease", "diseases_and_conditions"), ("penicillin", "drug", "drugs_and_compounds"), ("aardvark", "other", "other")}
    kinds = {(r.source_entity, r.target_entity): r.relationship_type for r in g.relationships.collect()}
    assert kinds["hepatitis", "penicillin"] == "treats" and kinds["aardvark", "windmills"] == "uses"
    assert values(views.aliases(g.sections, g.entities), "name", "alias", "n") == [("hepatitis", "HEPATITIS", 1), ("hepatitis", "Hepatitis", 1)]
    asked = spark.createDataFrame([(" HePatitis ",), ("nothing",), (None,)], "alias string")
    assert values(views.resolved(asked, g.entities), "alias", "name") == [(" HePatitis ", "hepatitis")]


def test_one_scan_of_documents_for_relationships(spark, small):
    """Texts are read once; all that follows reads what was stored of them."""
    g = Graph(spark, small)
    plan = g.relationships._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "mentions-" in plan


def test_files(spark, tmp_path):
    for name in ("a.txt", "b.pdf", "c.PDF", "d.exe"):
        (tmp_path / name).write_text(f"contents of {name}\nline")
    assert values(tables.uploaded_files(spark, str(tmp_path)), "filename") == [("a.txt",), ("b.pdf",)]
    assert values(tables.text_files(spark, str(tmp_path)), "filename", "text") == [("a.txt", "contents of a.txt\nline")]
    df = spark.createDataFrame([(1, "x")], "k int, v string")
    tables.write_json(df, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").first().v == "x"
    tables.append(df, f"{tmp_path}/t")
    tables.append(df, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        tables.write_new_version(df, f"{tmp_path}/t")


def test_display(spark):
    row = spark.range(1).select(
        scalars.arrow_path(F.array(F.lit("a"), F.lit("b"))).alias("p"), scalars.display_percent(F.lit(0.12345)).alias("q"), scalars.display_megabytes(F.lit(1_572_864)).alias("m"), scalars.iso_time(now()).alias("t")
    ).first()
    assert tuple(row) == ("a → b", 12.3, 1.5, "2023-11-14T22:13:20.000000")


def test_cues_are_found_once_a_section(spark, small):
    """The words of a section are cut and searched for cues before a row is made of each name."""
    plan = views.mentions(views.sections(spark, small))._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate posexplode")]
    assert "array_intersect" not in above and "arrays_overlap" not in above and plan.count("regexp_extract_all") == 1
    lines = spark.createDataFrame([("1", 1, "Measured with spectrometers, spectrometers and standards"), ("1", 2, "short"), ("1", 3, "standards it uses")], "document_id string, order int, content string")
    found = sorted(tuple(r) for r in views.mentions(lines).collect())
    assert found == [("1", 1, 2, 0, "measured"), ("1", 1, 2, 1, "spectrometers"), ("1", 1, 2, 2, "standards"), ("1", 3, 1, 0, "standards")]
