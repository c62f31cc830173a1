"""Inserts, updates, deletes and the status life cycle as plans that give the new table.

Tables are files that do not change, so an operator returns what the table becomes; writing it
to a new path is up to the caller. Unknown ids never make a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.config import SETTINGS
from quillgraph.functions.scalars import or_default, percent_done, stable_id
from quillgraph.schemas import DOCUMENT, PROCESSING_STEPS
from quillgraph.sources.tables import conformed


def new_documents(uploads: DataFrame, now: Column) -> DataFrame:
    """Document rows for uploads (filename, file_size): status uploaded, a default title for a
    missing name, the size as it is (null stays null)."""
    made = uploads.select(
        stable_id(F.coalesce("filename", F.lit("")), F.coalesce(F.col("file_size").cast("string"), F.lit("")), now.cast("string")).alias("_id"),
        or_default(F.col("filename"), SETTINGS.default_title).alias("title"),
        F.lit("uploaded").alias("status"),
        now.alias("created_at"),
        now.alias("updated_at"),
        F.col("file_size").cast("long").alias("file_size"),
    )
    return conformed(made, DOCUMENT)


def inserted(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows)


def updated(table: DataFrame, patch: DataFrame, now: Column, key: str = "_id", assigned: tuple[str, ...] = ()) -> DataFrame:
    """The table after a patch, and updated rows are stamped.

    ``patch`` has the key and any of the table's fields. Its non-null fields win; in the fields
    named in ``assigned`` a null is a value too and clears the field. Of several rows of a key the
    greatest counts, compared field by field in their order with nulls least, so a row of the
    table never multiplies.
    """
    fields = [c for c in patch.columns if c != key]
    one = patch.groupBy(key).agg(F.max(F.struct(*fields)).alias("__new")) if fields else patch.select(key).distinct().withColumn("__new", F.lit(True))
    both = table.join(one.withColumn("__hit", F.lit(True)), key, "left")
    set_ = {c: F.when(F.col("__hit"), F.col(f"__new.{c}")).otherwise(F.col(c)) if c in assigned else F.coalesce(F.col(f"__new.{c}"), F.col(c)) for c in fields}
    if "updated_at" in table.columns:
        set_["updated_at"] = F.when(F.col("__hit"), now).otherwise(F.col("updated_at"))
    return both.select(*[set_.get(c, F.col(c)).alias(c) for c in table.columns])


def update_result(table: DataFrame, patch: DataFrame, now: Column, key: str = "_id", assigned: tuple[str, ...] = ()) -> DataFrame:
    """Only the rows that a patch changed."""
    return updated(table, patch, now, key, assigned).join(patch.select(key), key, "left_semi")


def deleted(table: DataFrame, keys: DataFrame, key: str = "_id") -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def deleted_cascade(documents: DataFrame, sections: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and sections after a delete that takes the sections along. What is derived from
    sections, entities and relationships, follows when the views are built over the result."""
    return deleted(documents, keys), deleted(sections, keys.select(F.col("_id").alias("document_id")), "document_id")


def with_latest_status(documents: DataFrame, log: DataFrame) -> DataFrame:
    """Documents with the last status that a log (document_id, status, at, seq) has for them.

    The last entry is an aggregate, so a document with very many entries is no hot spot.
    """
    last = log.groupBy(F.col("document_id").alias("_id")).agg(F.max(F.struct("at", "seq", "status")).alias("last"))
    both = documents.join(last, "_id", "left")
    return both.withColumns({"status": F.coalesce("last.status", "status"), "updated_at": F.coalesce("last.at", "updated_at")}).select(*documents.columns)


def processing_progress(documents: DataFrame) -> DataFrame:
    """A row for each pending document and step: current (percent), total, status."""
    pending = documents.filter(F.col("status") == "uploaded").select(F.col("_id").alias("document_id"))
    steps = pending.select("document_id", F.posexplode(F.array(*map(F.lit, PROCESSING_STEPS))).alias("step", "status"))
    return steps.select("document_id", "step", percent_done(F.col("step"), len(PROCESSING_STEPS)).alias("current"), F.lit(100).alias("total"), "status")


def cleanup_candidates(documents: DataFrame, before: Column) -> DataFrame:
    return documents.filter((F.col("status") == "processed") & (F.col("updated_at") < before))
