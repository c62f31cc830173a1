"""Every registered query of the engine: a name and a function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.config import SETTINGS
from quillgraph.functions.scalars import TOKEN, arrow_path, display_megabytes, display_percent, iso_time, tokens
from quillgraph.operators import aliases, answers, graph, listing, mutations, retrieval, sketches, spreading, terms, validation
from quillgraph.operators.vector_index import VectorIndex
from quillgraph.plans import views as plans
from quillgraph.plans.views import Graph, _pick
from quillgraph.schemas import RELATIONSHIP_TYPE
from quillgraph.sources.tables import as_json, conformed, file_state, kept, materialized, table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def now() -> Column:
    """The time of all changes, fixed so that results can be compared."""
    return F.timestamp_seconds(F.lit(1_735_689_600))


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def _documents(df: DataFrame) -> DataFrame:
    """Documents for output: times as text."""
    return df.withColumns({c: iso_time(F.col(c)) for c in ("created_at", "updated_at")})


def _rounded(df: DataFrame, *fields: str) -> DataFrame:
    return df.withColumns({f: F.round(f, 6) for f in fields})


def _strongest(g: Graph) -> tuple[str, str]:
    """Ends of the strongest relationship, for the lookups by end."""
    row = listing.top_relationships(g.related, 1).select("source_entity", "target_entity").first()
    return (row[0], row[1]) if row else ("", "")


def _question(g: Graph) -> str:
    """The first opening line of 8 to 30 words, by document id, serves as the question."""
    line = F.substring_index(F.col("text"), "\n", 1)
    lines = g.table.select("doc_id", line.alias("line")).filter(F.size(F.split("line", " ")).between(8, 30))
    row = g._stored("question", lambda: lines.agg(F.min_by("line", "doc_id").alias("query"))).first()
    return row[0] or ""


def _asked(g: Graph) -> DataFrame:
    return g.spark.createDataFrame([(0, _question(g))], "query_id int, query string")


def _best(g: Graph, n: int = SETTINGS.max_results) -> DataFrame:
    return retrieval.indexed_sections(g.index, g.collection, _question(g), n)


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users ask in conversations: query_id and query."""
    said = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return said.select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), F.col("text").alias("query"))


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads to check: names with all kinds of endings, some missing, some very large files."""
    suffix = _pick((".pdf", ".txt", ".docx", ".PDF", ".exe"), F.col("doc_id"))
    name = F.when(F.col("source") == "src7", F.lit("")).otherwise(F.concat(F.lit("file"), F.col("doc_id").cast("string"), suffix))
    return table(spark, sf_dir, "documents").select(name.alias("filename"), (F.col("n_chars") * 20_000).cast("long").alias("file_size"))


def _marked(spark: SparkSession, sf_dir: str, mark: str, value: int) -> DataFrame:
    return table(spark, sf_dir, "labels").filter(F.col(mark) == value).select(F.col("doc_id").cast("string").alias("_id")).distinct()


def _claims(g: Graph) -> DataFrame:
    """Relationships as an extractor might claim them: strengths out of range, unknown types."""
    kind = _pick((*RELATIONSHIP_TYPE, "resembles"), F.length("source_entity") + F.length("target_entity"))
    return g.related.select("source_entity", "target_entity", kind.alias("relationship_type"), (F.col("strength") * 1.5 - 0.05).alias("strength"))


# Scans, lookups, listings


@query
def list_documents_page(spark, sf_dir):
    return _documents(listing.list_documents(Graph(spark, sf_dir).documents, skip=20, limit=10))


@query
def get_document(spark, sf_dir):
    return _documents(listing.get_document(Graph(spark, sf_dir).documents, "7"))


@query
def document_projection(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("_id"), F.col("source").alias("title"), F.col("n_chars").alias("file_size"), "lang")
    from quillgraph.schemas import DOCUMENT

    return _documents(conformed(raw, DOCUMENT)).withColumnRenamed("_id", "id")


@query
def documents_since_year(spark, sf_dir):
    return listing.since_year(Graph(spark, sf_dir).documents, 2020).select("_id", "title", "year", "status")


@query
def documents_by_status(spark, sf_dir):
    return listing.matching(Graph(spark, sf_dir).documents, status="processed").select("_id", "title", "year", "status")


@query
def document_sections(spark, sf_dir):
    return listing.matching(Graph(spark, sf_dir).sections, document_id="7")


@query
def sections_by_type(spark, sf_dir):
    return listing.matching(Graph(spark, sf_dir).sections, section_type="abstract")


@query
def list_entities(spark, sf_dir):
    return listing.list_entities(Graph(spark, sf_dir).entities)


@query
def list_entities_by_type(spark, sf_dir):
    return listing.list_entities(Graph(spark, sf_dir).entities, entity_type="method")


@query
def entity_by_name(spark, sf_dir):
    g = Graph(spark, sf_dir)
    first = listing.top_entities(g.entities, 1).select("name").first()
    return g.entities.filter(F.col("name") == (first[0] if first else ""))


@query
def entities_by_category(spark, sf_dir):
    return listing.matching(Graph(spark, sf_dir).entities, category="techniques_and_tools")


@query
def top_entities(spark, sf_dir):
    return listing.top_entities(Graph(spark, sf_dir).entities)


@query
def list_relationships(spark, sf_dir):
    return _rounded(listing.list_relationships(Graph(spark, sf_dir).related), "strength")


@query
def list_relationships_by_source(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return _rounded(listing.list_relationships(g.related, source_entity=_strongest(g)[0]), "strength")


@query
def list_relationships_by_target(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return _rounded(listing.list_relationships(g.related, target_entity=_strongest(g)[1]), "strength")


@query
def list_relationships_by_type(spark, sf_dir):
    return _rounded(listing.list_relationships(Graph(spark, sf_dir).related, relationship_type="associated_with"), "strength")


@query
def list_relationships_conj(spark, sf_dir):
    g = Graph(spark, sf_dir)
    source, target = _strongest(g)
    return _rounded(listing.list_relationships(g.related, source, target, "associated_with"), "strength")


@query
def strong_relationships(spark, sf_dir):
    return _rounded(Graph(spark, sf_dir).related.filter(F.col("strength") >= SETTINGS.min_strength), "strength")


@query
def top_relationships(spark, sf_dir):
    return _rounded(listing.top_relationships(Graph(spark, sf_dir).related), "strength")


@query
def entities_json(spark, sf_dir):
    return as_json(Graph(spark, sf_dir).entities.select("name", "entity_type", "category", "frequency"))


@query
def document_display(spark, sf_dir):
    g = Graph(spark, sf_dir)
    share = F.col("file_size") / F.lit(SETTINGS.max_upload_bytes)
    return g.documents.select("_id", display_megabytes(F.col("file_size")).alias("megabytes"), display_percent(share).alias("percent_of_limit"))


# Inserts, updates, deletes, life cycle


@query
def validate_upload(spark, sf_dir):
    return validation.validated_uploads(_uploads(spark, sf_dir)).withColumn("valid", F.col("reason").isNull())


@query
def upload_document(spark, sf_dir):
    g, good = Graph(spark, sf_dir), validation.validated_uploads(_uploads(spark, sf_dir)).filter("reason is null")
    after = mutations.inserted(g.documents, mutations.new_documents(good, now()))
    return after.groupBy("status", "title").agg(F.count("*").alias("n"), F.sum("file_size").alias("bytes"))


@query
def update_document(spark, sf_dir):
    patch = _marked(spark, sf_dir, "quality", 0).select("_id", F.concat(F.lit("Low quality "), F.col("_id")).alias("title"), F.lit(None).cast("int").alias("year"))
    return _documents(mutations.update_result(Graph(spark, sf_dir).documents, patch, now()))


@query
def delete_document(spark, sf_dir):
    return _documents(mutations.deleted(Graph(spark, sf_dir).documents, _marked(spark, sf_dir, "toxic", 1)))


@query
def delete_cascade(spark, sf_dir):
    g = Graph(spark, sf_dir)
    documents, sections = mutations.deleted_cascade(g.documents, g.sections, _marked(spark, sf_dir, "toxic", 1))
    of = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("collection"), "n")
    return of(documents, "documents").union(of(sections, "sections"))


@query
def delete_cascade_graph(spark, sf_dir):
    """What a delete leaves of every collection: entities and relationships follow the sections."""
    g = Graph(spark, sf_dir)
    left = Graph(spark, sf_dir, *mutations.deleted_cascade(g.documents, g.sections, _marked(spark, sf_dir, "toxic", 1)))
    of = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("collection"), "n")
    entities, linked = left.linked[1], left.related
    return of(left.documents, "documents").union(of(left.sections, "sections")).union(of(entities, "entities")).union(of(linked, "relationships"))


@query
def update_document_cleared(spark, sf_dir):
    """Patches with two rows a key, of which the greater counts, and a null that clears a field."""
    marked = _marked(spark, sf_dir, "quality", 0)
    patch = marked.select("_id", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("title"), F.lit(None).cast("int").alias("year"))
    return _documents(mutations.update_result(Graph(spark, sf_dir).documents, patch, now(), assigned=("year",)))


@query
def document_status_transition(spark, sf_dir):
    kind = _pick(("processing", "processed", "failed"), F.col("event_id"))
    log = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("document_id"), kind.alias("status"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"))
    return _documents(mutations.with_latest_status(Graph(spark, sf_dir).documents, log)).select("_id", "status", "updated_at")


@query
def processing_progress(spark, sf_dir):
    return mutations.processing_progress(Graph(spark, sf_dir).documents)


@query
def cleanup_candidates(spark, sf_dir):
    return mutations.cleanup_candidates(Graph(spark, sf_dir).documents, F.timestamp_seconds(F.lit(1_704_067_200 + 30_000))).select("_id", "status")


# Checks


@query
def validate_query(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("  "), F.col("text")).alias("text"))
    return validation.validated_queries(said, "text").select("conv_id", "turn", F.length("query").cast("long").alias("n_chars"), "valid")


@query
def validate_relationship(spark, sf_dir):
    return validation.validated_relationships(_claims(Graph(spark, sf_dir))).groupBy("relationship_type", "reason").agg(F.count("*").alias("n"))


@query
def validate_entity(spark, sf_dir):
    kind = F.when(F.col("frequency") % 7 == 0, F.lit("person")).otherwise(F.col("entity_type"))
    place = F.when(F.col("frequency") % 5 == 0, F.lit("places")).otherwise(F.col("category"))
    return validation.validated_entities(Graph(spark, sf_dir).entities.select("name", kind.alias("entity_type"), place.alias("category")))


@query
def doi_duplicates(spark, sf_dir):
    return validation.doi_duplicates(Graph(spark, sf_dir).documents)


@query
def orphan_sections(spark, sf_dir):
    g = Graph(spark, sf_dir)
    left = mutations.deleted(g.documents, _marked(spark, sf_dir, "toxic", 1))
    return validation.orphan_sections(g.sections, left).select("_id", "document_id", "order")


@query
def dangling_relationships(spark, sf_dir):
    g = Graph(spark, sf_dir)
    common = g.entities.filter(F.col("frequency") >= 2 * SETTINGS.entity_documents)
    return _rounded(validation.dangling_relationships(g.related, common), "strength")


# Extraction and graph


@query
def extract_sections(spark, sf_dir):
    return Graph(spark, sf_dir).sections


@query
def extract_entities(spark, sf_dir):
    return Graph(spark, sf_dir).entities


@query
def entity_frequency(spark, sf_dir):
    return Graph(spark, sf_dir).entities.select("name", "frequency", "n_sections")


@query
def entity_aliases(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return plans.aliases(g.sections, g.entities)


@query
def resolve_aliases(spark, sf_dir):
    """Spellings in the first lines of documents, resolved to the entities that they stand for."""
    g = Graph(spark, sf_dir)
    asked = g.documents.select(F.explode(F.regexp_extract_all("abstract", F.lit(TOKEN), F.lit(1))).alias("alias")).distinct()
    return plans.resolved(asked, g.entities).select("alias", "name", "entity_type")


@query
def corrected_aliases(spark, sf_dir):
    """Rare long words of the texts that are one slip away from an entity that is far more common."""
    g = Graph(spark, sf_dir)
    return aliases.corrected(g.mentions.groupBy("name").agg(F.count("*").alias("n")))


@query
def extract_terms(spark, sf_dir):
    """Terms of two and three words that belong together."""
    g = Graph(spark, sf_dir)
    counts = g._stored("run-counts", lambda: terms.run_counts(g.sections))
    n_words = F.coalesce(F.sum(F.size(tokens(F.col("content")))), F.lit(0)).alias("n")
    total = g._stored("word-count", lambda: g.sections.agg(n_words)).first().n
    found = terms.terms(counts, total)
    return found.withColumns({"likelihood": F.round("likelihood", 2), "value": F.round("value", 4)})


@query
def entity_frequency_sketched(spark, sf_dir):
    """Frequencies from the sketches of four batches of documents, merged one after another."""
    g = Graph(spark, sf_dir)
    batch = lambda k: sketches.batch_sketches(g.mentions.filter(F.pmod(F.col("document_id").cast("long"), F.lit(4)) == k))
    held = batch(0)
    for k in (1, 2, 3):
        held = sketches.merged(held, batch(k))
    return sketches.frequencies(held)


@query
def entity_records(spark, sf_dir):
    g = Graph(spark, sf_dir)
    mentions, entities = g.linked
    found = plans.entity_records(entities, plans.aliases(g.sections, entities), mentions)
    return found.withColumn("aliases", F.array_join("aliases", "|"))


@query
def entity_provenance(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return graph.provenance(g.mentions, g.entities)


@query
def extract_relationships(spark, sf_dir):
    return _rounded(Graph(spark, sf_dir).related, "strength")


@query
def relationship_strength(spark, sf_dir):
    bands = Graph(spark, sf_dir).related.withColumn("band", F.floor(F.col("strength") * 10 + 1e-9).cast("long"))
    return bands.groupBy("band").agg(F.count("*").alias("n"), F.sum("n_together").alias("n_together"), F.sum("n_either").alias("n_either"))


@query
def section_document_join(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return graph.section_documents(g.sections, g.documents).select("_id", "document_id", "document_title", "doi", "section_type", "order")


@query
def relationship_entities_join(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return _rounded(graph.relationship_entities(g.related, g.entities), "strength")


@query
def graph_degree(spark, sf_dir):
    return _rounded(graph.degrees(Graph(spark, sf_dir).edges), "total_strength")


def _hop(spark, sf_dir, hops: int) -> DataFrame:
    linked = Graph(spark, sf_dir).edges
    found = graph.paths_by_hop(linked, graph.nodes(linked), hops)[-1]
    return _rounded(found.select(arrow_path(F.col("path")).alias("path"), "total_strength"), "total_strength")


@query
def graph_paths_1hop(spark, sf_dir):
    return _hop(spark, sf_dir, 1)


@query
def graph_paths_2hop(spark, sf_dir):
    return _hop(spark, sf_dir, 2)


@query
def graph_paths_3hop(spark, sf_dir):
    return _hop(spark, sf_dir, 3)


@query
def strongest_paths(spark, sf_dir):
    """The strongest path of at most three hops between any two names."""
    g = Graph(spark, sf_dir)
    found = graph.strongest_paths(g.adjacency, graph.nodes(g.edges))
    return _rounded(found.select("seed", "name", arrow_path(F.col("path")).alias("path"), "hops", "total_strength"), "total_strength")


# Retrieval


@query
def lexical_scores(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return _rounded(g.index.all_scores(_asked(g)).select(F.col("_id").alias("section_id"), "relevance_score"), "relevance_score")


@query
def search_sources(spark, sf_dir):
    return _rounded(retrieval.ranked_sources(_best(Graph(spark, sf_dir))), "relevance_score")


@query
def search_many(spark, sf_dir):
    """The ten best sections for each thing that a user asks in a conversation."""
    g = Graph(spark, sf_dir)
    found = g.index.top(_talk(spark, sf_dir), store=lambda name, build: materialized(build(), name))
    return _rounded(found.select("query_id", F.col("_id").alias("section_id"), "relevance_score", "place"), "relevance_score")


@query
def spread_entities(spark, sf_dir):
    """How near each entity is to what each user asks."""
    g = Graph(spark, sf_dir)
    found = spreading.spread(g.adjacency, spreading.named_entities(_talk(spark, sf_dir), g.entities))
    return found.withColumn("mass", F.round("mass", 9))


@query
def search_fused(spark, sf_dir):
    """The ten best documents for each thing that a user asks, by text, graph and vectors."""
    g, asked = Graph(spark, sf_dir), _talk(spark, sf_dir)
    store = lambda name, build: materialized(build(), name)
    near = spreading.spread(g.adjacency, spreading.named_entities(asked, g.entities))
    text = store("text-list", lambda: spreading.by_document(g.index.top(asked, store=store)))
    walked = spreading.by_document(g.index.top_weighted(near.select("query_id", F.col("name").alias("term"), F.col("mass").alias("weight")), store=store))
    seen = spreading.nearest_documents(text, table(spark, sf_dir, "embeddings"))
    return spreading.fused([text, walked, seen]).withColumn("score", F.round("score", 9))


@query
def search_graph_paths(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return _rounded(retrieval.search_paths(_best(g), g.entities, g.edges), "total_strength")


@query
def graph_path_records(spark, sf_dir):
    """All two-hop paths from the names of most edges, with entities and relationships."""
    g = Graph(spark, sf_dir)
    found = graph.path_records(graph.paths_by_hop(g.edges, graph.hubs(g.edges), 2)[-1], g.entities, g.related)
    kinds = F.array_join(F.transform("entities", lambda e: e["entity_type"]), "|")
    steps = F.array_join(F.transform("relationships", lambda r: r["relationship_type"]), "|")
    strengths = F.array_join(F.transform("relationships", lambda r: F.format_number(r["strength"], 4)), "|")
    return _rounded(found.select(arrow_path(F.col("path")).alias("path"), kinds.alias("entity_types"), steps.alias("relationship_types"), strengths.alias("strengths"), "total_strength"), "total_strength")


def _flat(response: DataFrame) -> DataFrame:
    """A response as plain columns."""
    listed = F.array_join(F.transform("sources", lambda s: s["section_id"]), ",")
    walked = F.array_join(F.transform("graph_paths", lambda p: p["path"]), "; ")
    return response.select("query", "answer", F.size("sources").cast("long").alias("n_sources"), listed.alias("section_ids"), F.size("graph_paths").cast("long").alias("n_paths"), walked.alias("paths"))


@query
def search_response(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return _flat(retrieval.search_response(_question(g), g.sections, g.documents, g.entities, g.edges, top=_best(g)))


@query
def search_no_graph(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return _flat(retrieval.search_response(_question(g), g.sections, g.documents, g.entities, g.edges, include_graph=False, top=_best(g)))


@query
def search_answer(spark, sf_dir):
    return _best(Graph(spark, sf_dir), 1).select(F.col("content").alias("answer"), F.col("_id").alias("section_id"))


@query
def search_answer_sentences(spark, sf_dir):
    """An answer of three sentences from the best sections, none of which says what another did."""
    g = Graph(spark, sf_dir)
    found = answers.marginal_sentences(answers.sentences(_best(g)), _question(g))
    return found.withColumn("score", F.round("score", 6))


@query
def document_search(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return _rounded(g.abstracts.all_scores(_asked(g)).select(F.col("_id").alias("document_id"), "relevance_score"), "relevance_score")


@query
def vector_topk(spark, sf_dir):
    """Every vector whose id is divisible by 100 against all."""
    vectors = table(spark, sf_dir, "embeddings")
    return _rounded(retrieval.vector_topk(vectors, vectors.filter("vec_id % 100 = 0")), "similarity")


_VECTORS: dict[tuple, VectorIndex] = {}


def _vector_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The index of all vectors, built once for as long as their files stay the same."""
    state = file_state(spark, f"{sf_dir}/embeddings.parquet")
    key = (spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None), state)
    if key not in _VECTORS:
        _VECTORS[key] = VectorIndex.of(table(spark, sf_dir, "embeddings"), lambda name, build: kept(spark, state, name, build))
    return _VECTORS[key]


@query
def vector_topk_indexed(spark, sf_dir):
    """The same queries by the inverted file; ``vector_index_recall`` tells what that misses."""
    found = _vector_index(spark, sf_dir).search(table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0"))
    return _rounded(found.select("query_id", F.col("id").alias("vec_id"), "similarity"), "similarity")


@query
def vector_index_recall(spark, sf_dir):
    """For each of these queries how many vectors the index read, of how many, and how many of the
    true neighbours it found."""
    vectors, index = table(spark, sf_dir, "embeddings"), _vector_index(spark, sf_dir)
    queries = vectors.filter("vec_id % 100 = 0")
    true = retrieval.vector_topk(vectors, queries).select("query_id", F.col("vec_id").alias("id"))
    both = true.join(index.search(queries), ["query_id", "id"], "left")
    rows = both.groupBy("query_id").agg(F.count("*").alias("n_true"), F.count("similarity").alias("n_found"), F.coalesce(F.max("n_read"), F.lit(0)).alias("n_read"))
    return rows.withColumn("n_vectors", F.lit(vectors.count()))
