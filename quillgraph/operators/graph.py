"""Joins and bounded path expansion over the entity graph."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.config import SETTINGS
from quillgraph.sources.tables import materialized

#: Edges of a node that are joined in one task.
EDGE_BLOCK = 4096


def section_documents(sections: DataFrame, documents: DataFrame) -> DataFrame:
    """Sections with the title and DOI of their document."""
    about = documents.select(F.col("_id").alias("document_id"), F.col("title").alias("document_title"), "doi")
    return sections.join(about, "document_id")


def relationship_entities(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationships with type and frequency of the entities at both ends."""
    end = lambda s: entities.select(F.col("name").alias(f"{s}_entity"), F.col("entity_type").alias(f"{s}_type"), F.col("frequency").alias(f"{s}_frequency"))
    return relationships.join(end("source"), "source_entity").join(end("target"), "target_entity")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("source_entity").alias("name")).agg(F.count("*").alias("degree"), F.sum("strength").alias("total_strength"))


def hubs(edges: DataFrame, n: int = SETTINGS.path_seeds) -> DataFrame:
    """The names with most edges."""
    return degrees(edges).orderBy(F.desc("degree"), "name").limit(n).select("name")


def nodes(edges: DataFrame) -> DataFrame:
    """Every name with an edge; each edge stands in both directions."""
    return edges.select(F.col("source_entity").alias("name")).distinct()


def paths_by_hop(edges: DataFrame, seeds: DataFrame, max_hops: int = SETTINGS.max_hops, min_strength: float = SETTINGS.min_strength) -> list[DataFrame]:
    """Simple paths of one hop, two hops and so on from the seeds: path, total_strength.

    The strength of a path is the product of its edges'; a path below ``min_strength`` is given
    up at once, as no longer path can be stronger. A name occurs once in a path.
    """
    if max_hops < 0:
        raise ValueError("max_hops must not be negative")
    held, out = seeds.select(F.array("name").alias("path"), F.lit(1.0).alias("total_strength")), []
    for _ in range(max_hops):
        step = held.join(edges, F.element_at("path", -1) == F.col("source_entity")).filter(~F.array_contains("path", F.col("target_entity")))
        held = step.select(F.concat("path", F.array("target_entity")).alias("path"), (F.col("total_strength") * F.col("strength")).alias("total_strength"))
        held = held.filter(F.col("total_strength") >= min_strength)
        out.append(held)
    return out


def paths(edges: DataFrame, seeds: DataFrame, max_hops: int = SETTINGS.max_hops, min_strength: float = SETTINGS.min_strength) -> DataFrame:
    """All simple paths of one hop to ``max_hops``."""
    found = paths_by_hop(edges, seeds, max_hops, min_strength)
    none = seeds.filter(F.lit(False)).select(F.array("name").alias("path"), F.lit(1.0).alias("total_strength"))
    return reduce(DataFrame.union, found, none)


def provenance(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Where each entity was found, a row for each document: sections and the first of them."""
    by_document = mentions.groupBy("name", "document_id").agg(F.count("*").alias("n_sections"), F.min("order").alias("first_order"))
    return by_document.join(entities.select("name"), "name", "left_semi")


def path_records(paths: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """``paths`` (path, total_strength) with the entities on each and the relationships between
    them, in the order of the path: path, entities, relationships, total_strength.

    Each node and each step is looked up on its own and put back by its place; a step may go along
    a relationship in either direction.
    """
    numbered = paths.select("path", "total_strength")
    about = F.struct("at", "name", "entity_type", "category", "frequency")
    nodes = numbered.select("path", F.posexplode("path").alias("at", "name")).join(entities, "name")
    nodes = nodes.groupBy("path").agg(F.array_sort(F.collect_set(about)).alias("entities"))
    walked = numbered.select("path", F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("at"))
    ends = (F.element_at("path", F.col("at")), F.element_at("path", F.col("at") + 1))
    walked = walked.select("path", "at", F.least(*ends).alias("source_entity"), F.greatest(*ends).alias("target_entity"))
    step = F.struct("at", "source_entity", "target_entity", "relationship_type", "strength")
    steps = walked.join(relationships, ["source_entity", "target_entity"]).groupBy("path").agg(F.array_sort(F.collect_set(step)).alias("relationships"))
    return numbered.join(nodes, "path").join(steps, "path").select("path", "entities", "relationships", "total_strength")


@dataclass(frozen=True)
class Adjacency:
    """Edges with the block of their source that each lies in, and the nodes with several blocks."""

    edges: DataFrame
    hubs: DataFrame

    @classmethod
    def of(cls, edges: DataFrame) -> Adjacency:
        """``edges`` (source_entity, target_entity, strength), with share, each one's part of the
        strength that leaves its source. Edges of a hub are dealt into blocks."""
        out = edges.groupBy(F.col("source_entity").alias("name")).agg(F.sum("strength").alias("total"), F.ceil(F.count("*") / EDGE_BLOCK).cast("int").alias("blocks"))
        out = materialized(out, "out-edges")
        dealt = edges.withColumnRenamed("source_entity", "name").join(out, "name")
        block = F.expr("cast(pmod(xxhash64(target_entity), blocks) as int)")
        dealt = dealt.select("name", block.alias("block"), "target_entity", "strength", (F.col("strength") / F.col("total")).alias("share"))
        return cls(materialized(dealt, "adjacency"), out.filter("blocks > 1").select("name", "blocks"))

    def follow(self, states: DataFrame) -> DataFrame:
        """``states`` (name, any more) with each edge that leaves the name."""
        known = states.join(self.hubs, "name", "left")
        every = known.withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
        return every.join(self.edges, ["name", "block"]).drop("block")


def strongest_paths(adjacency: Adjacency, seeds: DataFrame, max_hops: int = SETTINGS.max_hops, min_strength: float = SETTINGS.min_strength) -> DataFrame:
    """The strongest path from each seed to each name within ``max_hops``: seed, name, path, hops
    and total_strength, a row for each pair; of equally strong ones the shortest, then the first.

    Each round keeps one state for a pair, and only states that got better go on, so the work
    grows with the pairs in reach and not with the paths between them. Strengths are at most 1,
    so the strongest path never visits a name twice.
    """
    if max_hops < 0:
        raise ValueError("max_hops must not be negative")
    rank = F.struct((-F.col("total_strength")).alias("less"), "hops", "path")
    best = seeds.select(F.col("name").alias("seed"), "name", F.array("name").alias("path"), F.lit(0).alias("hops"), F.lit(1.0).cast("double").alias("total_strength"), F.lit(True).alias("fresh")).distinct()
    best = materialized(best, "strongest")
    for hop in range(1, max_hops + 1):
        step = adjacency.follow(best.filter("fresh").drop("fresh", "hops")).filter(~F.array_contains("path", F.col("target_entity")))
        step = step.select("seed", F.col("target_entity").alias("name"), F.concat("path", F.array("target_entity")).alias("path"), F.lit(hop).alias("hops"), (F.col("total_strength") * F.col("strength")).alias("total_strength"))
        step = step.filter(F.col("total_strength") >= min_strength).withColumn("fresh", F.lit(True))
        both = best.withColumn("fresh", F.lit(False)).unionByName(step)
        won = both.groupBy("seed", "name").agg(F.min(F.struct(rank.alias("rank"), "fresh")).alias("won"))
        won = won.select("seed", "name", "won.rank.path", "won.rank.hops", (-F.col("won.rank.less")).alias("total_strength"), "won.fresh")
        best = materialized(won, "strongest")
    return best.filter("hops > 0").select("seed", "name", "path", "hops", "total_strength")
