"""Checks that put a reason beside a row instead of failing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.config import SETTINGS
from quillgraph.functions.scalars import has_suffix
from quillgraph.schemas import ENTITY_CATEGORY, ENTITY_TYPE, RELATIONSHIP_TYPE


def _first_reason(*checks: tuple[Column, str]) -> Column:
    """The reason of the first check that holds; null if none does."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for c, r in checks])


def validated_uploads(uploads: DataFrame) -> DataFrame:
    """``uploads`` with reason: bad_type, too_large or null. Sizes that are not known pass."""
    bad = ~has_suffix(F.col("filename"), SETTINGS.upload_suffixes)
    return uploads.withColumn("reason", _first_reason((bad, "bad_type"), (F.col("file_size") > SETTINGS.max_upload_bytes, "too_large")))


def validated_queries(queries: DataFrame, field: str) -> DataFrame:
    """The query without outer blanks, and whether anything is left of it."""
    trimmed = F.trim(F.coalesce(F.col(field), F.lit("")))
    return queries.withColumn("query", trimmed).withColumn("valid", F.length(trimmed) > 0)


def validated_relationships(claims: DataFrame) -> DataFrame:
    """``claims`` with reason: missing_end, bad_type, bad_strength or null."""
    ends = F.col("source_entity").isNull() | F.col("target_entity").isNull()
    strength = F.col("strength").isNull() | ~F.col("strength").between(0.0, 1.0)
    kind = F.col("relationship_type").isNull() | ~F.col("relationship_type").isin(*RELATIONSHIP_TYPE)
    return claims.withColumn("reason", _first_reason((ends, "missing_end"), (kind, "bad_type"), (strength, "bad_strength")))


def validated_entities(claims: DataFrame) -> DataFrame:
    """``claims`` with reason: missing_name, bad_type, bad_category or null."""
    no_name = F.col("name").isNull() | (F.col("name") == "")
    outside = lambda c, allowed: F.col(c).isNull() | ~F.col(c).isin(*allowed)
    return claims.withColumn("reason", _first_reason((no_name, "missing_name"), (outside("entity_type", ENTITY_TYPE), "bad_type"), (outside("category", ENTITY_CATEGORY), "bad_category")))


def doi_duplicates(documents: DataFrame) -> DataFrame:
    """DOIs that several documents have, how many, and the id that keeps it. Null DOIs are free."""
    claimed = documents.filter(F.col("doi").isNotNull()).groupBy("doi").agg(F.count("*").alias("n"), F.min("_id").alias("keeper"))
    return claimed.filter("n > 1")


def orphan_sections(sections: DataFrame, documents: DataFrame) -> DataFrame:
    return sections.join(documents.select(F.col("_id").alias("document_id")), "document_id", "left_anti")


def dangling_relationships(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationships with an end that is no entity."""
    known = lambda s: entities.select(F.col("name").alias(f"{s}_entity"), F.lit(True).alias(f"has_{s}"))
    both = relationships.join(known("source"), "source_entity", "left").join(known("target"), "target_entity", "left")
    return both.filter("has_source is null or has_target is null").select(*relationships.columns)
