"""Exact top-k inner-product search with a ball tree in every shard.

Equal vectors are one point with its least ids. Points are dealt into shards by the nearest of a
bounded number of centres, large clusters into several; each shard is a ball tree. A query first
searches the shard that it lies in, which gives a k-th score that any result must reach. That
score goes along to the other shards: a cluster whose ball can't reach it is never sent the
query, a node that can't is not entered, and leaves are searched in the order of their bounds
while the k-th score rises. Bounds decide only what is looked at, so results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, slices, stored

#: Numbers in the vectors of a shard, points of a leaf, queries that travel together.
SHARD_NUMBERS, LEAF, BLOCK = 1 << 18, 64, 1024
#: Centres at most, and points for each of them in the sample that they are fitted on.
MOST_CENTRES, SAMPLE = 1024, 16
#: Leaves that each query searches in its own order before those left are searched in a common one.
BEST_FIRST = 4
_LAST = np.iinfo(np.int64).max
_NONE = -_LAST


def whole_vectors(vectors: DataFrame, key: str = "vec_id", field: str = "embedding", scale: int = 256) -> DataFrame:
    """Distinct rows of an id and floor(scale * x) of each component. Vectors that are null or
    hold a null, NaN or infinity take no part, nor do rows without an id."""
    good = F.coalesce(F.forall(field, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    whole = F.transform(field, lambda x: F.floor(x.cast("double") * scale))
    return vectors.filter(good & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), whole.alias("v")).distinct()


class Ball:
    """A ball tree over the rows of a matrix of whole numbers, each with one or more ids."""

    def __init__(self, vectors: np.ndarray, ids: list[np.ndarray]):
        self.nodes: list[tuple[int, int, int]] = []  # first row, end, right child (0: a leaf)
        self.centres: list[np.ndarray] = []
        self.radius: list[float] = []
        points = vectors.astype(float)
        order = np.arange(len(vectors))

        def grow(lo: int, hi: int) -> int:
            own = points[order[lo:hi]]
            centre, me = own.mean(0), len(self.nodes)
            apart = np.sqrt(((own - centre) ** 2).sum(1))
            self.nodes.append((lo, hi, 0))
            self.centres.append(centre)
            self.radius.append(float(apart.max()))
            if hi - lo > LEAF:
                far = own[apart.argmax()]
                other = own[((own - far) ** 2).sum(1).argmax()]
                mid = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(own @ (other - far), mid)]
                grow(lo, lo + mid)
                self.nodes[me] = (lo, hi, grow(lo + mid, hi))
            return me

        if len(vectors):
            grow(0, len(vectors))
        self.vectors = vectors[order]
        many = [len(ids[k]) for k in order]
        self.ids = np.concatenate([ids[k] for k in order]) if many else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(order)), many)

    def packed(self) -> dict[str, bytes]:
        return {
            "vectors": self.vectors.astype("<i8").tobytes(), "ids": self.ids.astype("<i8").tobytes(), "owner": self.owner.astype("<i4").tobytes(),
            "nodes": np.array(self.nodes, "<i4").tobytes(), "centres": np.array(self.centres, "<f8").tobytes(), "radius": np.array(self.radius, "<f8").tobytes(),
        }

    @classmethod
    def unpacked(cls, width: int, row: dict[str, bytes]) -> Ball:
        self = cls.__new__(cls)
        self.ids, self.owner = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["owner"], "<i4")
        self.radius = np.frombuffer(row["radius"], "<f8")
        self.nodes = [tuple(n) for n in np.frombuffer(row["nodes"], "<i4").reshape(-1, 3).tolist()]
        self.centres = np.frombuffer(row["centres"], "<f8").reshape(len(self.nodes), width)
        self.vectors = np.frombuffer(row["vectors"], "<i8").reshape(int(self.owner.max()) + 1, width)
        return self

    def search(self, queries: np.ndarray, known: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best entries for each query, descending, equals by id; entries
        below ``known``, a score that k entries elsewhere reach, may be missing."""
        m, q = len(queries), queries.astype(float)
        size = np.sqrt((q * q).sum(1))
        best, names = np.full((m, k), _NONE), np.full((m, k), _LAST)
        floor = known.astype(float)
        big = int(np.abs(queries).max(initial=0)) * int(np.abs(self.vectors).max(initial=0)) * max(1, queries.shape[1])
        rows = self.vectors.astype(float) if big < 1 << 53 else self.vectors.astype(object)
        asked = q if big < 1 << 53 else queries.astype(object)

        def look(leaf: int, who: np.ndarray) -> None:
            lo, hi, _ = self.nodes[leaf]
            a, b = np.searchsorted(self.owner, (lo, hi))
            score = (asked[who] @ rows[lo:hi].T).astype(np.int64)[:, self.owner[a:b] - lo]
            score = np.concatenate([best[who], score], 1)
            name = np.concatenate([names[who], np.broadcast_to(self.ids[a:b], (len(who), b - a))], 1)
            order = np.lexsort((name, -score), axis=1)[:, :k]
            best[who], names[who] = np.take_along_axis(score, order, 1), np.take_along_axis(name, order, 1)
            floor[who] = np.maximum(floor[who], best[who, k - 1])

        # Down the tree: a node is entered by the queries whose bound reaches their k-th score.
        leaves, bounds = [], []
        stack = [(0, np.arange(m))] if self.nodes else []
        while stack:
            node, who = stack.pop()
            reach = size[who] * self.radius[node]
            near = q[who] @ self.centres[node]
            bound = near + reach + 1e-9 * (np.abs(near) + reach) + 1e-6
            who, bound = who[bound >= floor[who]], bound[bound >= floor[who]]
            if not len(who):
                continue
            if self.nodes[node][2]:
                stack += [(self.nodes[node][2], who), (node + 1, who)]
            else:
                column = np.full(m, -np.inf)
                column[who] = bound
                leaves.append(node)
                bounds.append(column)
        if leaves:
            table = np.stack(bounds, 1)
            order = np.argsort(-table, axis=1, kind="stable")
            for turn in range(min(BEST_FIRST, len(leaves))):
                mine = order[:, turn]
                can = table[np.arange(m), mine] >= np.maximum(floor, -1e300)
                for leaf in np.unique(mine[can]):
                    who = np.flatnonzero(can & (mine == leaf))
                    look(leaves[leaf], who)
                    table[who, leaf] = -np.inf
            for leaf in np.argsort(-table.max(0), kind="stable"):
                who = np.flatnonzero(table[:, leaf] >= np.maximum(floor, -1e300))
                if len(who):
                    look(leaves[leaf], who)
        return best, names


def _centres(points: DataFrame, n: int, width: int) -> np.ndarray:
    """Centres by a few turns of k-means over the points of least hash, a sample that n bounds."""
    sample = points.orderBy(F.xxhash64("point"), "point").limit(n * SAMPLE).select("v").toArrow().column(0).to_pylist()
    data = np.array(sample, float).reshape(-1, width)
    centres = data[:n].copy()
    for _ in range(6):
        near = ((centres * centres).sum(1) - 2 * data @ centres.T).argmin(1)
        for k in np.unique(near):
            centres[k] = data[near == k].mean(0)
    return centres


def _placed(points: DataFrame, width: int, centres: np.ndarray) -> DataFrame:
    """Points with their cluster, the nearest centre's number, and how far they lie from it;
    those of another width than the centres' make one cluster a width, around zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BLOCK):
            cluster, apart = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            own = np.array([x.as_py() == width for x in batch.column("width")], bool)
            column = batch.column("v").filter(pa.array(own))
            if own.any():
                v = column.flatten().to_numpy().astype(float).reshape(-1, width)
                cluster[own] = ((centres * centres).sum(1) - 2 * v @ centres.T).argmin(1)
                apart[own] = np.sqrt(((v - centres[cluster[own]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster.astype(np.int32)), pa.array(apart)], names=[*batch.schema.names, "cluster", "apart"])

    return points.mapInArrow(run, "point long, width int, v array<long>, ids array<long>, cluster int, apart double")


_SHARD = ["width", "cluster", "part"]
_TREE = ["vectors", "ids", "owner", "nodes", "centres", "radius"]
_SEARCHED = "width int, cluster int, part int, " + ", ".join(f"{c} binary" for c in _TREE) + ", point long, v array<long>, scores array<long>, names array<long>"


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), width)


def _built(points: DataFrame, k: int) -> DataFrame:
    """The tree of each shard, a row of its own, and for each of its points that is asked for the
    k best that the shard holds."""

    def build(table: pa.Table) -> pa.Table:
        width, cluster, part = (table.column(c)[0].as_py() for c in _SHARD)
        v = _matrix(table.column("v"), width)
        tree = Ball(v, [np.array(x, np.int64) for x in table.column("ids").to_pylist()])
        rows = [{"width": width, "cluster": cluster, "part": part, **tree.packed()}]
        asked = np.flatnonzero(table.column("asked").to_numpy())
        for at in range(0, len(asked), BLOCK):
            some = asked[at : at + BLOCK]
            points_ = table.column("point").to_numpy()[some].tolist()
            scores, names = tree.search(v[some], np.full(len(some), _NONE), k)
            rows += [{"width": width, "cluster": cluster, "part": part, "point": p, "v": x, "scores": s, "names": n} for p, x, s, n in zip(points_, v[some].tolist(), scores.tolist(), names.tolist())]
        return pa.Table.from_pylist(rows, pa.schema([*((c, pa.int32()) for c in _SHARD), *((c, pa.binary()) for c in _TREE), ("point", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("v", "scores", "names"))]))

    return points.groupBy(*_SHARD).applyInArrow(build, _SEARCHED)


_SENT = "width int, cluster int, part int, points binary, queries binary, known binary"


def _sent(asked: DataFrame, width: int, centres: np.ndarray, radius: np.ndarray, parts: np.ndarray) -> DataFrame:
    """Queries in blocks for each shard whose ball reaches their k-th score, their own left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BLOCK):
            q, known = _matrix(batch.column("v"), width), np.array([s[-1] for s in batch.column("scores").to_pylist()], np.int64)
            point, cluster, part = (batch.column(c).to_numpy() for c in ("point", "cluster", "part"))
            near, reach = q @ centres.T, np.sqrt((q.astype(float) ** 2).sum(1))[:, None] * radius
            open_ = near + reach + 1e-9 * (np.abs(near) + reach) + 1e-6 >= known.astype(float)[:, None]
            rows = []
            for c in np.flatnonzero(open_.any(0)).tolist():
                for p in range(parts[c]):
                    who = np.flatnonzero(open_[:, c] & ~((cluster == c) & (part == p)))
                    if len(who):
                        rows.append((width, c, p, point[who].astype("<i8").tobytes(), q[who].astype("<i8").tobytes(), known[who].astype("<i8").tobytes()))
            cols = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [*[pa.int32()] * 3, *[pa.binary()] * 3])], names=[*_SHARD, "points", "queries", "known"])

    return asked.mapInArrow(run, _SENT)


def _sent_one(asked: DataFrame) -> DataFrame:
    """Queries of rare widths, one by one, for the shard of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = lambda c: pa.array([np.array(x, "<i8").tobytes() for x in c], pa.binary())
            known = [s[-1] for s in batch.column("scores").to_pylist()]
            cols = [packed(batch.column("point").to_pylist()), packed(batch.column("v").to_pylist()), packed(known)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _SHARD), *cols], names=[*_SHARD, "points", "queries", "known"])

    return asked.mapInArrow(run, _SENT)


def _answered(sent: DataFrame, k: int) -> DataFrame:
    """point, score, name: what each shard holds for the queries sent to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = {c: batch.column(c)[0].as_py() for c in batch.schema.names}
            point, known = (np.frombuffer(row[c], "<i8") for c in ("points", "known"))
            queries = np.frombuffer(row["queries"], "<i8").reshape(len(point), row["width"])
            scores, names = Ball.unpacked(row["width"], row).search(queries, known, k)
            good = (scores >= known[:, None]) & (names != _LAST)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(point, good.sum(1))), pa.array(scores[good]), pa.array(names[good])], names=["point", "score", "name"])

    return sent.mapInArrow(run, "point long, score long, name long")


def top_products(vectors: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", field: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each row whose id is divisible by ``every``
    the k highest integer inner products with all rows but its own, ties to the smaller id.

    Null vectors and those with a null or non-finite component take no part, nor do rows without
    an id; a row that repeats id and vector counts once; rows of one id with other vectors are
    rows of their own; only vectors of the same width have a product, an empty one has 0 with
    others; a query has fewer than k rows if there are no more; products must fit 64 bits; an
    empty table gives no rows; other columns are ignored whatever their names.

    The centres, at most ``MOST_CENTRES`` fitted on a sample of ``SAMPLE`` points for each, decide
    where points lie; every row is indexed and every result is exact.
    """
    spark = vectors.sparkSession
    rows = stored(whole_vectors(vectors, key, field, scale), "whole-vectors")
    # The query itself is one entry more.
    least = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("n") <= k + 1)
    points = stored(least.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.monotonically_increasing_id().alias("point"), F.size("v").alias("width"), "v", "ids"), "vector-points")
    common = points.groupBy("width").count().orderBy(F.desc("count"), "width").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, n = common
    size = max(LEAF, SHARD_NUMBERS // max(1, width))
    centres = _centres(points.filter(F.col("width") == width), min(MOST_CENTRES, -(-n // size)), width)
    placed = stored(_placed(points, width, centres), "vector-clusters")
    sizes = placed.groupBy("width", "cluster").agg(F.max("apart").alias("radius"), F.ceil(F.count("*") / F.when(F.col("width") == width, size).otherwise(F.greatest(F.lit(LEAF), F.lit(SHARD_NUMBERS) / F.greatest(F.lit(1), F.col("width"))))).cast("int").alias("parts"))
    clusters = stored(sizes, "vector-cluster-sizes")
    questions = rows.filter(F.col("id") % every == 0).join(points.select("v", "point").hint("merge"), "v").select("id", "point", F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x).alias("own"))
    questions = stored(questions, "vector-questions")
    asked = questions.select("point").distinct().withColumn("asked", F.lit(True))
    dealt = placed.join(clusters, ["width", "cluster"]).withColumn("part", F.expr("cast(pmod(xxhash64(point), parts) as int)")).join(asked, "point", "left")
    dealt = dealt.select(*_SHARD, "point", "v", "ids", F.coalesce("asked", F.lit(False)).alias("asked"))
    found = stored(_built(dealt, k + 1), "vector-trees")
    trees, home = found.filter("nodes is not null").select(*_SHARD, *_TREE), found.filter("point is not null").select(*_SHARD, "point", "v", "scores", "names")
    radius, parts = np.zeros(len(centres)), np.zeros(len(centres), int)
    for r in clusters.filter(F.col("width") == width).collect():
        radius[r.cluster], parts[r.cluster] = r.radius, r.parts
    rare = home.filter(F.col("width") != width).withColumnRenamed("part", "own").join(clusters.select("width", "cluster", "parts"), ["width", "cluster"])
    rare = rare.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).filter("part != own").select(*_SHARD, "point", "v", "scores")
    sent = _sent(home.filter(F.col("width") == width), width, centres, radius, parts).unionByName(_sent_one(rare))
    # Spark can't know how many queries a row of bytes holds, nor how well vectors are packed in
    # files; it would broadcast either side of such a join through the driver.
    more = _answered(sent.join(trees.hint("merge"), _SHARD), k + 1)
    first = home.select("point", F.explode(F.arrays_zip("scores", "names")).alias("e")).select("point", "e.scores", "e.names").toDF("point", "score", "name").filter(F.col("name") != _LAST)
    order = Window.partitionBy("point").orderBy(F.desc("score"), "name")
    best = first.unionByName(more).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    listed = best.groupBy("point").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "name"))).alias("list"))
    out = questions.join(listed, "point").withColumn("at", F.array_position("list", F.struct((-F.col("own")).alias("less"), F.col("id").alias("name"))).cast("int"))
    others = F.when(F.col("at") > 0, F.expr(f"concat(slice(list, 1, at - 1), slice(list, at + 1, {k + 1}))")).otherwise(F.col("list"))
    each = out.select(F.col("id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("pos", "e"))
    result = stored(each.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("e.name").alias("vec_id"), (-F.col("e.less")).alias("score")), "vector-results")
    discard(rows, points, placed, clusters, questions, found)
    return result
