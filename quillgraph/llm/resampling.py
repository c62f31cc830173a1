"""Importance resampling towards a target distribution, over hashed word n-grams.

A document's weight is the sum of the gains of its features, and the gain of a feature is the
log ratio of how often its bucket occurs in the target and in the corpus. Texts longer than
``CHUNK`` bytes are cut at word boundaries into chunks that overlap by n-1 words; a chunk owns the
features that start in its own part, so every feature counts once. Chunks are dealt out to all
tasks, and their counts and weights are summed by document.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, slices, stored

BUCKETS = 10_000
#: Bytes of a text above which it is cut, and of the part that a chunk owns.
CHUNK = 1 << 16
#: Words that a document needs to be drawn, and the percentage that is drawn.
LEAST_WORDS, PERCENT = 20, 10
_WORD, _GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")


def cut(text: bytes, words: int, size: int = CHUNK) -> Iterator[tuple[bytes, int]]:
    """Chunks of a text in lower case: the bytes with ``words`` - 1 words carried over from what
    follows, and how many of the bytes are the chunk's own. A word is never split."""
    at = 0
    while True:
        gap = _GAP.search(text, min(at + size, len(text)))
        end = stop = gap.start() if gap else len(text)
        for word in islice(_WORD.finditer(text, end), words - 1):
            stop = word.end()
        yield text[at:stop], end - at
        if end == len(text):
            return
        at = end


def features(chunk: bytes, own: int, words: int, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """How many words start in the first ``own`` bytes, and the buckets of all runs of 1 to
    ``words`` words that start there."""
    found = _WORD.findall(chunk)
    mine = len(found) if own >= len(chunk) else len(_WORD.findall(chunk, 0, own))
    crc = list(map(zlib.crc32, found[:mine]))
    out = crc.copy()
    for k in range(1, words):
        crc = [zlib.crc32(b" " + w, c) for w, c in zip(found[k : mine + k], crc)]
        out += crc
    return mine, np.array(out, np.int64) % buckets


def _pieces(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """Short texts as they lie, and the chunks of long ones, dealt out one by one.

    Both have doc_id, same (a hash of a long text), nth, chunk and own.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("chunk"))
    size, schema = F.octet_length("chunk"), "doc_id long, same string, nth int, chunk binary, own int"
    short = rows.filter(size <= CHUNK).select("doc_id", F.lit("").alias("same"), F.lit(0).alias("nth"), "chunk", size.alias("own"))
    long = rows.filter(size > CHUNK).select("doc_id", F.md5("chunk").alias("same"), "chunk")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            (doc_id,), (same,) = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            parts = enumerate(cut(batch.column(2)[0].as_py().lower(), words))
            while some := list(islice(parts, 64)):
                cols = zip(*((doc_id, same, k, chunk, own) for k, (chunk, own) in some))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.int32()))], names=["doc_id", "same", "nth", "chunk", "own"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return short, long.mapInArrow(split, schema).repartition(n)


def _counted(batch: pa.RecordBatch, words: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    for chunk, own in zip(batch.column("chunk"), batch.column("own").to_pylist()):
        yield features(chunk.as_py().lower(), own, words, buckets)


def bucket_counts(docs: DataFrame, words: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. ``buckets`` bounds what a task sends
    and what reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for _, cells in _counted(batch, words, buckets):
                total += np.bincount(cells, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    short, long = _pieces(docs, words)
    parts = short.mapInArrow(run, "bucket long, n long").union(long.mapInArrow(run, "bucket long, n long"))
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio) for each bucket."""
    s_all, t_all, n = float(corpus.sum()), float(target.sum()), len(corpus)
    ratio = lambda s, t: (t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, words: int = 1) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row of ``docs``.

    A null or empty text has none of them and weight 0. Long texts are put together again by
    doc_id and contents; what repeated rows give together is shared out among them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [(mine, len(cells), int(gain[cells].sum())) for mine, cells in _counted(batch, words, len(gain))]
            sums = [pa.array(c, pa.int64()) for c in (zip(*found) if found else ((), (), ()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "same", "nth")), *sums], names=["doc_id", "same", "nth", "n_words", "n_features", "weight"])

    schema, sums = "doc_id long, same string, nth int, n_words long, n_features long, weight long", ("n_words", "n_features", "weight")
    short, long = (part.mapInArrow(run, schema) for part in _pieces(docs, words))
    whole = long.groupBy("doc_id", "same").agg(F.sum((F.col("nth") == 0).cast("long")).alias("copies"), *[F.sum(c).alias(c) for c in sums])
    each = whole.select("doc_id", *[F.expr(f"{c} div copies").alias(c) for c in sums], F.explode(F.expr("sequence(1, copies)"))).drop("col")
    return short.select("doc_id", *sums).unionByName(each)


def gumbel_score(doc_id: Column, weight: Column, seed: int = 2024) -> Column:
    """The weight with Gumbel noise that follows from the id; a null id counts as empty."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` (doc_id, n_words, score, any more) with rank: 1, 2, 3 ... for the given
    percentage, rounded down, of the rows with enough words, by descending score; ties go to the
    smaller doc_id, a missing one last. All other ranks are null. The result is stored.

    Rows are dealt out by ranges of the score and numbered where they lie; the counts of the
    ranges, one number each, are all that reaches the driver.
    """
    enough, names = F.col("n_words") >= least_words, scored.columns
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    sorted_ = scored.filter(enough).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at, at + batch.num_rows) + 1)], names=[*batch.schema.names, "nth"])
            at += batch.num_rows

    kinds = ", ".join(f"`{n}` {t}" for n, t in sorted_.dtypes)
    placed = stored(sorted_.mapInArrow(number, f"{kinds}, nth long"), "resampling-ranks")
    sizes = {r.part: r.n for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, at = {}, 0
    for part in sorted(sizes):
        before[part], at = at, at + sizes[part]
    base = placed.sparkSession.createDataFrame(list(before.items()), "part int, base long")
    rank = F.col("base") + F.col("nth")
    drawn = placed.join(F.broadcast(base), "part").select(*names, F.when(rank <= percent * at // 100, rank).alias("rank"))
    out = stored(drawn.unionByName(scored.filter(~enough).withColumn("rank", F.lit(None).cast("long"))), "resampled")
    discard(placed)
    return out


def resampled(docs: DataFrame, target: DataFrame, words: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs``, drawn towards
    the texts of ``target``.

    A null or empty text has no features, weight 0 and no rank; very long texts are cut into
    chunks; repeated rows are scored and ranked each; ties in score go to the smaller doc_id; an
    empty table gives no rows, and an empty target leaves the smoothing alone; columns other than
    doc_id and text are ignored whatever their names.
    """
    gain = gains(bucket_counts(docs, words, buckets), bucket_counts(target.select(F.lit(0).alias("doc_id"), "text"), words, buckets))
    found = weights(docs, gain, words)
    scored = stored(found.withColumn("score", gumbel_score(F.col("doc_id"), F.col("weight"), seed)), "resampling-scores")
    out = ranked(scored, percent, least_words)
    discard(scored)
    return out
