"""The document graph derived from the plain tables: documents, sections, entities, edges.

The definitions of entities, their types and the strength of relationships are choices of this
engine. Each view is a plan; ``Graph`` stores what is derived from texts once, so that texts are
read and cut into words once whatever is asked afterwards.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.config import SETTINGS
from quillgraph.functions import evidence
from quillgraph.functions.scalars import TOKEN, tokens
from quillgraph.operators import setjoin
from quillgraph.operators.graph import Adjacency, section_documents
from quillgraph.operators.text_index import TextIndex
from quillgraph.schemas import DOCUMENT_STATUS
from quillgraph.sources.tables import file_state, kept, materialized, spread, table


def _pick(values: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document collection. What the plain table lacks follows from its id."""
    key, made = F.col("doc_id"), F.lit(1_704_067_200) + F.col("doc_id") * 60
    return table(spark, sf_dir, "documents").select(
        key.cast("string").alias("_id"),
        F.concat(F.lit("Document "), key.cast("string")).alias("title"),
        F.concat(F.lit("10.5555/"), F.substring(F.md5(F.col("text").cast("binary")), 1, 16)).alias("doi"),
        (F.lit(2000) + key % 25).cast("int").alias("year"),
        F.substring_index("text", "\n", 1).alias("abstract"),
        _pick(DOCUMENT_STATUS, key).alias("status"),
        F.timestamp_seconds(made).alias("created_at"),
        F.timestamp_seconds(made + 3600).alias("updated_at"),
        F.lit(None).cast("string").alias("file_path"),
        F.col("n_chars").cast("long").alias("file_size"),
    )


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with contents, numbered as they stand in the text."""
    texts = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lines = texts.select(F.col("doc_id").cast("string").alias("document_id"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "content"))
    order = (F.col("pos") + 1).cast("int")
    return lines.filter(F.col("content").rlike(r"\S")).select(
        F.concat_ws(":", "document_id", order.cast("string")).alias("_id"),
        "document_id",
        F.when(order == 1, "abstract").otherwise("body").alias("section_type"),
        "content",
        order.alias("order"),
    )


def mentions(sections: DataFrame, repeated: bool = False) -> DataFrame:
    """Distinct long words of each section, the place where each first stands among them, and the
    section's cue words for kinds of relationships.

    ``repeated`` tells that several sections may have one document and order, as those of documents
    with one id or with none. They are one section then, with the words and cues of all, and places
    go by name."""
    cut = sections.select("document_id", "order", tokens(F.col("content")).alias("words"))
    long = F.filter("words", lambda t: F.length(t) >= SETTINGS.entity_letters)
    # All that needs a section's words is found before a row is made of each name.
    told = cut.select("document_id", "order", evidence.told(F.col("words")).alias("told"), F.array_distinct(long).alias("names"))
    known = told.select("document_id", "order", evidence.cue_bits(F.col("told")).alias("cues"), "names")
    # An inner one would have the names found once more, to filter for sections that hold any.
    rows = known.select("document_id", "order", "cues", F.posexplode_outer("names").alias("place", "name"))
    rows = rows.filter(F.col("name").isNotNull())
    if not repeated:
        return rows
    key = ["document_id", "order"]
    all_cues = known.groupBy(*key).agg(F.expr("bit_or(cues)").alias("all")).select(*[F.col(c).alias(f"__{c}") for c in key], F.col("all").alias("cues"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("name")) - 1
    once = rows.select(*key, "name").distinct().select(*key, place.alias("place"), "name")
    same = F.col("document_id").eqNullSafe(F.col("__document_id")) & (F.col("order") == F.col("__order"))
    return once.join(all_cues, same).select(*key, "cues", "place", "name")


def entities(mentions: DataFrame) -> DataFrame:
    """Names found in enough documents; those without an id don't count as such, their sections do.
    Counts are taken by name and document first."""
    by_document = mentions.groupBy("name", "document_id").agg(F.count("*").alias("n"))
    counts = by_document.groupBy("name").agg(F.count("document_id").alias("frequency"), F.sum("n").alias("n_sections"))
    kind = evidence.entity_type(F.col("name"))
    return counts.filter(F.col("frequency") >= SETTINGS.entity_documents).select("name", kind.alias("entity_type"), evidence.category(kind).alias("category"), "frequency", "n_sections")


def aliases(sections: DataFrame, entities: DataFrame) -> DataFrame:
    """name, alias, n: spellings of entities in the texts that differ from their names, and how
    often each occurs. Counted by spelling before anything is joined."""
    found = sections.select(F.explode(F.regexp_extract_all("content", F.lit(TOKEN), F.lit(1))).alias("alias")).filter(F.length("alias") >= SETTINGS.entity_letters)
    counts = found.groupBy("alias").agg(F.count("*").alias("n")).withColumn("name", F.lower("alias")).filter("alias != name")
    return counts.join(entities.select("name"), "name").select("name", "alias", "n")


def resolved(asked: DataFrame, entities: DataFrame) -> DataFrame:
    """``asked`` (alias) with the name of the entity that each stands for; unknown ones go."""
    return asked.withColumn("name", F.lower(F.trim("alias"))).join(entities.select("name", "entity_type"), "name")


def entity_records(entities: DataFrame, aliases: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities with all fields of the data model that the texts give: aliases in order, a
    description, and where they were found (documents, the first of them)."""
    spelled = aliases.groupBy("name").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    where = mentions.groupBy("name", "document_id").agg(F.count("*").alias("n")).groupBy("name").agg(F.min("document_id").alias("first_document"), F.max("n").alias("most_sections"))
    about = F.concat(F.col("entity_type"), F.lit(" in "), F.col("frequency").cast("string"), F.lit(" documents"))
    both = entities.join(spelled, "name", "left").join(where, "name")
    none = F.array().cast("array<string>")
    return both.select("name", "entity_type", "category", F.coalesce("aliases", none).alias("aliases"), "frequency", about.alias("description"), "first_document", "most_sections")


def relationships(mentions: DataFrame, entities: DataFrame, floor: float = SETTINGS.relationship_floor) -> DataFrame:
    """Pairs of entities whose sets of sections have a Jaccard similarity, the strength, of at
    least ``floor``; all of them, wherever the two stand in their sections.

    ``mentions`` and ``entities`` are stored tables; names are broadcast after a check of their
    bytes. Mentions are read once: entities tell the sizes of the sets, and places the sections
    that hold very many names.
    """
    cues = {f"cue{k}": F.expr(f"shiftright(cues, {k}) & 1") for k in range(len(evidence.CUES))}
    common = mentions.filter(F.col("place") >= setjoin.ELEMENT_BLOCK).groupBy("document_id", "order").agg((F.max("place") + 1).alias("held"))
    both = setjoin.similar_sets(mentions.select("name", "document_id", "order", "cues"), floor, sums=cues, tells=("cues",), sizes=entities.select("name", F.col("n_sections").alias("n")), common=common)
    either = F.col("n_a") + F.col("n_b") - F.col("n_together")
    kind = evidence.relationship_type([F.col(f"cue{k}") for k in range(len(evidence.CUES))], F.col("a"), F.col("b"))
    return both.select(F.col("a").alias("source_entity"), F.col("b").alias("target_entity"), kind.alias("relationship_type"), (F.col("n_together") / either).alias("strength"), "n_together", either.alias("n_either"))


def edges(relationships: DataFrame, min_strength: float = SETTINGS.min_strength) -> DataFrame:
    """Strong relationships in both directions."""
    way = lambda a, b: F.struct(F.col(a).alias("source_entity"), F.col(b).alias("target_entity"))
    both = F.explode(F.array(way("source_entity", "target_entity"), way("target_entity", "source_entity")))
    return relationships.filter(F.col("strength") >= min_strength).select(both.alias("way"), "strength").select("way.*", "strength")


def stored_sections(sections: DataFrame, documents: DataFrame) -> DataFrame:
    """The section collection: sections with title and DOI of their documents, in the order of
    their ids within files, so that a lookup of ids skips row groups."""
    return section_documents(sections, documents).sortWithinPartitions("_id")


#: What graphs over given tables have built of several stored tables, by the tables' state.
_BUILT: dict[tuple, dict] = {}


class Graph:
    """The collections over one set of tables, or over other documents and sections than theirs.

    Documents are a view. What is derived from texts (sections, mentions, entities, relationships,
    edges, the text index) is stored when first asked for; over given tables it is stored once for
    as long as their files stay the same.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, documents_: DataFrame | None = None, sections_: DataFrame | None = None):
        self.spark, own = spark, documents_ is None and sections_ is None
        self.state = file_state(spark, f"{sf_dir}/documents.parquet") if own else None
        self._built = _BUILT.setdefault((spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None), self.state), {}) if own else {}
        self.table = table(spark, sf_dir, "documents")
        self.documents = documents(spark, sf_dir) if documents_ is None else documents_
        self.sections = sections(spark, sf_dir) if sections_ is None else sections_

    def _stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return kept(self.spark, self.state, name, build) if self.state else materialized(build(), name)

    @cached_property
    def collection(self) -> DataFrame:
        return self._stored("sections", lambda: stored_sections(self.sections, self.documents))

    @cached_property
    def repeated(self) -> bool:
        """Whether some documents of the table share an id or have none."""
        return not self.table.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty()

    @cached_property
    def mentions(self) -> DataFrame:
        return self._stored("mentions", lambda: mentions(self.sections, self.repeated))

    @cached_property
    def entities(self) -> DataFrame:
        return self._stored("entities", lambda: entities(self.mentions))

    @property
    def linked(self) -> tuple[DataFrame, DataFrame]:
        return self.mentions, self.entities

    @cached_property
    def relationships(self) -> DataFrame:
        """The plan of the relationships; ``related`` is what it gives, stored."""
        return relationships(*self.linked)

    @cached_property
    def related(self) -> DataFrame:
        return self._stored("relationships", lambda: self.relationships)

    @cached_property
    def edges(self) -> DataFrame:
        """Strong relationships in both directions."""
        return self._stored("edges", lambda: edges(self.related))

    @cached_property
    def adjacency(self) -> Adjacency:
        """The edges in blocks, each with its share of what leaves its source."""
        if "adjacency" not in self._built:
            self._built["adjacency"] = Adjacency.of(self.edges)
        return self._built["adjacency"]

    @cached_property
    def index(self) -> TextIndex:
        """The inverted index of the sections."""
        return TextIndex.of(self.sections.select("_id", "content"), self._stored)

    @cached_property
    def abstracts(self) -> TextIndex:
        """The inverted index of titles and abstracts."""
        text = self.documents.select("_id", F.concat_ws(" ", "title", "abstract").alias("content"))
        return TextIndex.of(text, self._stored, "abstract")
