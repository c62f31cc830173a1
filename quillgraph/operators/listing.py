"""Filtered, ordered and paged listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.config import SETTINGS


def page(df: DataFrame, order: list[Column | str], skip: int = 0, limit: int = SETTINGS.list_limit) -> DataFrame:
    """Rows skip to skip + limit in a total order. A limit of 0 is none; negatives are errors."""
    if skip < 0 or limit < 0:
        raise ValueError("skip and limit must not be negative")
    out = df.orderBy(*order)
    out = out.offset(skip) if skip else out
    return out.limit(limit) if limit else out


def matching(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows equal in all of the given fields; None and the empty string ask for nothing."""
    for field, value in wanted.items():
        if value:
            df = df.filter(F.col(field) == value)
    return df


def list_documents(documents: DataFrame, skip: int = 0, limit: int = SETTINGS.list_limit) -> DataFrame:
    return page(documents, ["_id"], skip, limit)


def get_document(documents: DataFrame, document_id: str) -> DataFrame:
    """One row, or none for an unknown id."""
    return documents.filter(F.col("_id") == document_id).limit(1)


def list_entities(entities: DataFrame, entity_type: str | None = None, limit: int = SETTINGS.list_limit) -> DataFrame:
    return page(matching(entities, entity_type=entity_type), ["name"], 0, limit)


def list_relationships(relationships: DataFrame, source_entity: str | None = None, target_entity: str | None = None, relationship_type: str | None = None, limit: int = SETTINGS.list_limit) -> DataFrame:
    found = matching(relationships, source_entity=source_entity, target_entity=target_entity, relationship_type=relationship_type)
    return page(found, ["source_entity", "target_entity"], 0, limit)


def top_entities(entities: DataFrame, limit: int = SETTINGS.list_limit) -> DataFrame:
    return page(entities, [F.desc("frequency"), "name"], 0, limit)


def top_relationships(relationships: DataFrame, limit: int = SETTINGS.list_limit) -> DataFrame:
    return page(relationships, [F.desc("strength"), "source_entity", "target_entity"], 0, limit)


def since_year(documents: DataFrame, year: int) -> DataFrame:
    return documents.filter(F.col("year") >= year)
