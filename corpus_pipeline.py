"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir). What it returns is written as Parquet and
read back as the next stage's documents. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import langid, packing, pii, quality, simhash
from quillgraph.llm.common import discard, documents, stored
from quillgraph.llm.queries import END_ID_WORDS, tokenizer_file


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far from their language and source go.

    Null and empty texts fail; nulls in lang or source form groups of their own; repeated rows
    and ties fare alike; texts of any length are read whole; an empty table stays empty; more
    columns pass through.
    """
    return quality.filtered(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language stays unknown or unsure go.

    Null and empty texts and those without a letter go. The text alone decides, so repeated rows
    fare alike; an empty table stays empty; more columns pass through.
    """
    rows = docs.select(F.struct(*docs.columns).alias("__doc"), "text")
    return langid.predict(rows, langid.fit(docs), keep=("__doc",)).filter(langid.accepted()).select("__doc.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least doc_id.

    Null and empty texts are copies of each other; of repeated rows one stays; a null doc_id
    gives way to any other; an empty table stays empty; more columns pass through.
    """
    return simhash.deduplicated(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows.

    Every row stays, repeated ones too; null texts stay null; an empty table stays empty; more
    columns pass through.
    """
    return pii.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens.

    A null or empty text is its end id alone; very long texts are cut; repeated rows are packed
    as often as they occur; an empty table gives no rows; more columns are ignored.
    """
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"), END_ID_WORDS, capacity=2048)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: Models, fingerprints and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. Each stage's table is deleted when the next one is written."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            discard(before)
    return docs
