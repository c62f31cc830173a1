"""An inverted file over vectors: lists by nearest centre, a few lists read for each query.

Centres come from k-means whose sums are Spark aggregates. A list is stored in blocks of vectors,
so a list of any length is dealt over tasks. A query reads the lists of its nearest centres and is
compared with every vector in them, in full precision. How many lists that takes is measured: the
index holds the number that covers the wanted share of true neighbours of a sample of queries.
``retrieval.vector_topk`` remains the exact way.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.config import SETTINGS
from quillgraph.operators.retrieval import vector_topk
from quillgraph.sources.tables import modest_batches

Store = Callable[[str, Callable[[], DataFrame]], DataFrame]

#: Lists at most, vectors of a block, and queries that are compared with a block at a time.
MOST_LISTS, BLOCK, QUERY_BLOCK = 4096, 1024, 1024
#: Similarities that are held at a time, and bytes of packed queries in a batch, about.
HELD, BATCH_BYTES = 1 << 20, 4 << 20
#: Vectors for each list that centres are fitted on, at most, and turns of k-means.
SAMPLE, TURNS = 256, 8
#: Queries whose true neighbours tell how many lists to read, and the share of these to cover.
CALIBRATION, COVERED = 64, 0.97


def _units(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of length one; the column holds whole vectors of that width."""
    v = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    return v / np.sqrt((v * v).sum(1))[:, None]


def _usable(vectors: DataFrame, key: str, field: str) -> DataFrame:
    """key, v and width of vectors that have a direction: no component missing, not all zero."""
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(key).cast("long").alias("id"), F.col(field).cast("array<double>").alias("v"), F.size(field).alias("width")).filter(F.col("width") > 0).filter(good)


def _nearest(batch: pa.RecordBatch, width: int, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each vector of a batch, nearest first. What is held besides the
    result grows neither with the batch nor with the number of centres."""
    units, out = _units(batch.column("v"), width), np.zeros((batch.num_rows, min(n, len(centres))), np.int32)
    rows = max(1, HELD // max(1, len(centres)))
    for at in range(0, batch.num_rows, rows):
        near = units[at : at + rows] @ centres.T
        out[at : at + rows] = near.argmax(1)[:, None] if n == 1 else np.argsort(-near, axis=1, kind="stable")[:, :n]
    return out


def _fitted(sample: DataFrame, width: int, n: int) -> np.ndarray:
    """Centres by spherical k-means. Each turn is one pass: tasks add up their vectors by nearest
    centre, and one sum for each centre reaches the driver. Centres without vectors stay."""
    first = sample.orderBy(F.xxhash64("id"), "id").limit(n).select("v").toArrow().combine_chunks()
    centres = np.concatenate([_units(b.column("v"), width) for b in first.to_batches()] or [np.zeros((0, width))])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, many = np.zeros((len(centres), width)), np.zeros(len(centres), np.int64)
        for batch in batches:
            if batch.num_rows:
                units, near = _units(batch.column("v"), width), _nearest(batch, width, centres, 1)[:, 0]
                np.add.at(total, near, units)
                many += np.bincount(near, minlength=len(centres))
        held = np.flatnonzero(many)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held].tolist(), pa.list_(pa.float64()))], names=["list", "total"])

    for _ in range(TURNS):
        parts = sample.mapInArrow(sums, "list long, total array<double>").select("list", F.posexplode("total").alias("at", "x"))
        for r in parts.groupBy("list", "at").agg(F.sum("x").alias("x")).groupBy("list").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("total")).collect():
            total = np.array([x.x for x in r.total])
            if (size := np.sqrt((total * total).sum())) > 0:
                centres[r.list] = total / size
    return centres


@dataclass(frozen=True)
class VectorIndex:
    """``blocks``: list, block, ids and vectors (length one, packed doubles). ``centres``: at most
    ``MOST_LISTS`` rows. ``probes``: lists that a query reads unless told otherwise. Vectors of
    another width than most are in no list; ``rest`` holds them for the exact way."""

    width: int
    centres: np.ndarray
    probes: int
    blocks: DataFrame
    rest: DataFrame

    @classmethod
    def of(cls, vectors: DataFrame, store: Store, key: str = "vec_id", field: str = "embedding", lists: int | None = None, k: int = SETTINGS.vector_candidates) -> VectorIndex:
        """Index every vector that has a direction. ``lists``: about four square roots of the
        number of vectors unless given."""
        modest_batches(vectors.sparkSession)
        rows = store("index-vectors", lambda: _usable(vectors, key, field))
        common = rows.groupBy("width").count().orderBy(F.desc("count"), "width").first()
        width, total = common or (1, 0)
        own = rows.filter(F.col("width") == width)
        n = max(1, min(lists or math.ceil(4 * math.sqrt(total)), MOST_LISTS, total))
        share = n * SAMPLE / total if total else 1
        sample = own if share >= 1 else own.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
        centres = _fitted(sample, width, n)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = _nearest(batch, width, centres, 1)[:, 0] if batch.num_rows else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(near.astype(np.int32))], names=["id", "v", "list"])

        lined = store("index-placed", lambda: own.mapInArrow(placed, "id long, v array<double>, list int"))
        sizes = lined.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))

        def packed(table: pa.Table) -> pa.Table:
            v = np.concatenate([_units(b.column("v"), width) for b in table.to_batches() if b.num_rows])
            return pa.table({"list": table.column("list")[:1], "block": table.column("block")[:1], "n": pa.array([len(v)]), "ids": pa.array([table.column("id").to_numpy().astype("<i8").tobytes()]), "vectors": pa.array([v.astype("<f8").tobytes()])})

        # One row for each list is broadcast: ``MOST_LISTS`` bounds it.
        dealt = lined.join(F.broadcast(sizes), "list").withColumn("block", F.expr("cast(pmod(xxhash64(id), parts) as int)"))
        blocks = store("index-blocks", lambda: dealt.groupBy("list", "block").applyInArrow(packed, "list int, block int, n long, ids binary, vectors binary"))
        index = cls(width, centres, len(centres), blocks, rows.filter(F.col("width") != width))
        return cls(width, centres, index._calibrated(own, store, k), blocks, index.rest)

    def _calibrated(self, own: DataFrame, store: Store, k: int) -> int:
        """Lists that hold ``COVERED`` of the k true neighbours of each of a bounded sample of
        vectors, in sum."""
        queries = store("index-calibration", lambda: own.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(CALIBRATION).select("id", "v"))
        true = store("index-neighbours", lambda: vector_topk(own, queries, k, "id", "v").select("query_id", "id"))
        lists = store("index-neighbour-lists", lambda: true.join(own, "id").select("query_id", "v"))
        asked = {r.id: r.v for r in queries.collect()}
        found = lists.toArrow()  # CALIBRATION * k rows
        if not found.num_rows:
            return 1
        held = np.concatenate([_nearest(b, self.width, self.centres, 1)[:, 0] for b in found.to_batches() if b.num_rows])
        wanted = np.array([asked[q] for q in found.column("query_id").to_pylist()])
        order = np.argsort(-(wanted @ self.centres.T), axis=1, kind="stable")
        depth = np.sort((order == held[:, None]).argmax(1))
        return int(depth[min(len(depth) - 1, math.ceil(COVERED * len(depth)) - 1)]) + 1

    def probed(self, queries: DataFrame, key: str = "vec_id", field: str = "embedding", probes: int | None = None) -> DataFrame:
        """list and the queries that read it, in blocks: block_of, ids, vectors (packed)."""
        n = min(probes or self.probes, len(self.centres))
        width, centres = self.width, self.centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, QUERY_BLOCK):
                    batch = whole.slice(at, QUERY_BLOCK)
                    ids, units, near = batch.column("id").to_numpy(), _units(batch.column("v"), width), _nearest(batch, width, centres, n)
                    # Each query stands once in a row of ``near``, so lists come as runs of this order.
                    order = np.argsort(near, axis=None, kind="stable")
                    starts = np.flatnonzero(np.diff(near.ravel()[order], prepend=-1))
                    rows, size = [], 0
                    for run_, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
                        who = order[run_:stop] // near.shape[1]
                        rows.append((int(near.ravel()[order[run_]]), ids[who].astype("<i8").tobytes(), units[who].astype("<f8").tobytes()))
                        size += len(rows[-1][2])
                        if size >= BATCH_BYTES or stop == len(order):
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["list", "asked", "asked_vectors"])
                            rows, size = [], 0

        rows = _usable(queries, key, field).filter(F.col("width") == width)
        return rows.mapInArrow(run, "list int, asked binary, asked_vectors binary")

    def search(self, queries: DataFrame, k: int = SETTINGS.vector_candidates, key: str = "vec_id", field: str = "embedding", probes: int | None = None) -> DataFrame:
        """query_id, id and similarity (cosine): the k best of what each query reads, ties to the
        smaller id, and n_read, how many vectors it was compared with. Queries of another width
        than the lists' are compared with all vectors of theirs."""
        width = self.width
        # Rows of queries and vectors that meet are a megabyte each.
        modest_batches(queries.sparkSession)

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                    who, ids = np.frombuffer(row["asked"], "<i8"), np.frombuffer(row["ids"], "<i8")
                    near = np.frombuffer(row["asked_vectors"], "<f8").reshape(-1, width) @ np.frombuffer(row["vectors"], "<f8").reshape(-1, width).T
                    order = np.lexsort((np.broadcast_to(ids, near.shape), -np.round(near, 9)), axis=1)[:, :k]
                    m = order.shape[1]
                    read = np.zeros((len(who), m), np.int64)
                    read[:, 0] = len(ids)  # counted once a query and block
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(who, m)), pa.array(ids[order].ravel()), pa.array(np.take_along_axis(near, order, 1).ravel()), pa.array(read.ravel())], names=["query_id", "id", "similarity", "read"])

        found = self.probed(queries, key, field, probes).join(self.blocks, "list").mapInArrow(meet, "query_id long, id long, similarity double, read long")
        usable = _usable(queries, key, field).filter(F.col("width") != width)
        other = vector_topk(self.rest, usable.select("id", "v"), k, "id", "v").withColumn("read", F.lit(0).cast("long"))
        place = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "id")
        best = found.unionByName(other).withColumn("place", F.row_number().over(place))
        total = F.sum("read").over(Window.partitionBy("query_id"))
        return best.withColumn("n_read", total).filter(F.col("place") <= k).select("query_id", "id", "similarity", "n_read")
