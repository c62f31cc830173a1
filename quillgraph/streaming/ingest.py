"""Streams: uploads into the document table, and the status log as windows and latest states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.operators.mutations import new_documents
from quillgraph.operators.validation import validated_uploads
from quillgraph.schemas import UPLOAD


def upload_stream(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """Upload records (JSON lines: filename, file_size) as they arrive in a folder."""
    return spark.readStream.schema(UPLOAD).option("maxFilesPerTrigger", files_a_batch).json(folder)


def ingest_uploads(uploads: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Valid uploads become document rows under ``path``; runs until what is there is read.

    The file sink and its log make each batch count once, also after a restart.
    """
    valid = validated_uploads(uploads).filter("reason is null").select("filename", "file_size")
    # A time that follows from nothing but the batch would differ after a retry.
    rows = new_documents(valid, F.current_timestamp())
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def status_counts(log: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Entries of a status log (document_id, status, at, seq) by window and status.

    Repeats of an entry within ``late`` are dropped, and so is what comes later than that.
    """
    once = log.withWatermark("at", late).dropDuplicatesWithinWatermark(["document_id", "seq"])
    return once.groupBy(F.window("at", window), "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "status", "n")


def latest_states(log: DataFrame) -> DataFrame:
    """The last status of each document, for output mode update or complete."""
    last = log.groupBy("document_id").agg(F.max(F.struct("at", "seq", "status")).alias("last"))
    return last.select("document_id", "last.status", "last.at")
