"""Entity frequencies from mergeable sketches, so that a new batch needs no recount."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.config import SETTINGS


def batch_sketches(mentions: DataFrame, bits: int = SETTINGS.sketch_bits) -> DataFrame:
    """name, documents (a sketch of the distinct documents) and n_sections of one batch.

    ``bits`` is the logarithm of the sketch's slots: estimates are off by 1.04 / sqrt(2 ** bits) in
    one standard deviation, and exact for names of few documents.
    """
    return mentions.groupBy("name").agg(F.hll_sketch_agg("document_id", bits).alias("documents"), F.count("*").alias("n_sections"))


def merged(*batches: DataFrame) -> DataFrame:
    """The sketches of several batches, or of a table and a new batch, as those of one. Documents
    that occur in several batches count once; sections are added up."""
    first, *others = batches
    for other in others:
        first = first.unionByName(other)
    return first.groupBy("name").agg(F.hll_union_agg("documents").alias("documents"), F.sum("n_sections").alias("n_sections"))


def frequencies(sketches: DataFrame, least: int = SETTINGS.entity_documents) -> DataFrame:
    """name, frequency (estimated documents) and n_sections of names in enough documents."""
    found = sketches.select("name", F.hll_sketch_estimate("documents").alias("frequency"), "n_sections")
    return found.filter(F.col("frequency") >= least)
