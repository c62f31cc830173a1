"""Reading and writing: parquet tables, uploaded files, plain text, JSON."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.config import SETTINGS
from quillgraph.functions.scalars import has_suffix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes a core below which a table is dealt out by rows.
SMALL_SHARE = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """A scan that is small for the cores at hand, dealt out by rows.

    A small file may be one row group and so one task, whatever its texts cost to work on. Scans
    of more than ``SMALL_SHARE`` bytes a core have splits enough and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SMALL_SHARE else df


#: Rows and bytes of an Arrow batch. Spark's own 10,000 rows are too many for whole texts or packed vectors.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def modest_batches(spark: SparkSession) -> None:
    """Bound what Python workers and the JVM hold at a time. A setting of the user's
    own is left alone."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def materialized(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder that the driver and all executors share
    (``spark.checkpoint.dir``) and read back, so that what rests on it doesn't compute it again and
    a lost executor loses nothing. Only a local session without that setting gets a temporary
    folder, which goes with the process."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillgraph-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_state(spark: SparkSession, path: str) -> tuple[str, int, int, int]:
    """A path with the bytes and the number of its files and the time it was changed."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    held = fs.getContentSummary(where)
    return path, held.getLength(), held.getFileCount(), fs.getFileStatus(where).getModificationTime()


#: Where the tables of ``kept`` lie.
_KEPT: dict[tuple, DataFrame] = {}


def kept(spark: SparkSession, state: tuple, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` gives, stored once for an application and the state of the files that it
    rests on (``file_state``), and read back by whoever asks for it again."""
    key = (spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None), state, name)
    if key not in _KEPT:
        _KEPT[key] = materialized(build(), name)
    return _KEPT[key]


def broadcast_if_small(df: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """A stored table, to be broadcast if its strings and numbers take at most so many bytes; a
    larger one is left to a join that shuffles."""
    width = sum((F.coalesce(F.octet_length(c) if kind == "string" else F.lit(0), F.lit(0)) + 16 for c, kind in df.dtypes), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= most_bytes else df


def uploaded_files(spark: SparkSession, folder: str) -> DataFrame:
    """filename, file_size, content of files with an allowed suffix; contents are read lazily."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    allowed = files.filter(has_suffix(F.col("path"), SETTINGS.upload_suffixes))
    return allowed.select(name.alias("filename"), F.col("length").alias("file_size"), "content")


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """filename and whole text of plain-text files."""
    files = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").text(folder, wholetext=True)
    return files.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("filename"), F.col("value").alias("text"))


def conformed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the fields of the schema: unknown ones go, missing ones are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_new_version(df: DataFrame, path: str) -> None:
    """A changed table goes to a path of its own; the one it was read from stays whole."""
    df.write.mode("errorifexists").parquet(path)


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON object a row; null fields are left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)
