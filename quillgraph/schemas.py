"""Schemas of the four collections and the values their enumerations take."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data model.
DOCUMENT_STATUS = ("uploaded", "processing", "processed", "failed")
ENTITY_TYPE = ("method", "dataset", "organism", "metric", "gene", "protein", "disease", "drug", "technique", "tool", "other")
ENTITY_CATEGORY = (
    "methods_and_approaches",
    "data_and_materials",
    "biological_entities",
    "measurements_and_metrics",
    "diseases_and_conditions",
    "drugs_and_compounds",
    "techniques_and_tools",
    "concepts_and_theories",
    "locations_and_environments",
    "temporal_concepts",
    "other",
)
RELATIONSHIP_TYPE = (
    "uses",
    "evaluated_by",
    "associated_with",
    "improves",
    "supports",
    "contradicts",
    "causes",
    "treats",
    "interacts_with",
    "part_of",
    "contains",
    "other",
)
PROCESSING_STEPS = (
    "Parsing document...",
    "Extracting text sections...",
    "Generating embeddings...",
    "Extracting entities...",
    "Extracting relationships...",
    "Building knowledge graph...",
    "Finalizing...",
)


def _struct(required: dict[str, T.DataType], optional: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(k, v, False) for k, v in required.items()] + [T.StructField(k, v, True) for k, v in optional.items()])


_TEXT, _WHEN = T.StringType(), T.TimestampType()
_STAMPS = {"created_at": _WHEN, "updated_at": _WHEN}
_PROVENANCE = {"provenance": T.ArrayType(T.MapType(_TEXT, _TEXT))}

DOCUMENT = _struct({"_id": _TEXT, "title": _TEXT, "status": _TEXT, **_STAMPS}, {"doi": _TEXT, "year": T.IntegerType(), "abstract": _TEXT, "file_path": _TEXT, "file_size": T.LongType()})
SECTION = _struct({"_id": _TEXT, "document_id": _TEXT, "section_type": _TEXT, "content": _TEXT, "order": T.IntegerType(), **_STAMPS}, {"embedding": T.ArrayType(T.FloatType())})
ENTITY = _struct({"_id": _TEXT, "name": _TEXT, "entity_type": _TEXT, "category": _TEXT, "aliases": T.ArrayType(_TEXT), "frequency": T.LongType(), **_STAMPS, **_PROVENANCE}, {"description": _TEXT})
RELATIONSHIP = _struct({"_id": _TEXT, "source_entity": _TEXT, "target_entity": _TEXT, "relationship_type": _TEXT, "strength": T.DoubleType(), **_STAMPS, **_PROVENANCE}, {"description": _TEXT})
UPLOAD = _struct({}, {"filename": _TEXT, "file_size": T.LongType()})
