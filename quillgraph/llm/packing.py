"""Best-fit packing by a grouping genetic algorithm on the histogram of piece lengths.

Which document fills a place does not matter to the number of sequences, only its length does.
So a solution is a multiset of *bins*, a bin being a tuple of lengths, and its size is bounded
by the capacity, not by the corpus. Crossover injects whole well-filled bins of one parent into
the other, drops the bins that hold what is now double, and puts the lengths that this displaces
back by best fit. Islands evolve in Spark tasks and exchange their elites after each epoch.
The winning plan is then dealt out to the pieces by their rank among those of equal length.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored, texts
from .token_cache import library_encoder

Bin = tuple[int, ...]
Plan = Counter  # of bins


def best_fit(lengths: Counter, capacity: int, open_bins: Plan | None = None) -> Plan:
    """Put lengths, longest first, into the fullest bins that still have room.

    Equal lengths and equal bins are handled as one, so this takes time by distinct values.
    """
    room: dict[int, Counter] = defaultdict(Counter)
    for b, n in (open_bins or {}).items():
        room[capacity - sum(b)][b] += n
    free = sorted(r for r in room if r > 0)
    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        while left > 0:
            k = bisect_left(free, length)
            space = free[k] if k < len(free) else capacity
            if k < len(free):
                old, n = next(iter(room[space].items()))
            else:
                old, n = (), left
            each = min(space // length, left)
            used = min(n, left // each)
            if k < len(free):
                room[space][old] -= used
                if not room[space][old]:
                    del room[space][old]
                    if not room[space]:
                        del room[space]
                        free.pop(k)
            rest = space - each * length
            if rest > 0 and not room[rest]:
                insort(free, rest)
            room[rest][tuple(sorted(old + (length,) * each, reverse=True))] += used
            left -= each * used
    out = Counter()
    for bins in room.values():  # added in place: a sum of counters copies all bins for each
        for b, n in bins.items():
            if n > 0:
                out[b] += n
    return out


def fitness(plan: Plan, capacity: int) -> tuple[int, float]:
    """Fewer bins first; then bins that are very full beside bins that are very empty."""
    return -sum(plan.values()), sum(n * (sum(b) / capacity) ** 2 for b, n in plan.items())


def lower_bound(lengths: Counter, capacity: int) -> int:
    total = sum(k * n for k, n in lengths.items())
    return max(-(-total // capacity), sum(n for k, n in lengths.items() if 2 * k > capacity))


def crossover(into: Plan, donor: Plan, capacity: int, rng: random.Random) -> Plan:
    """Inject a random part of the donor's well-filled bins; repair by elimination and best fit."""
    full = sorted(donor, key=lambda b: (-sum(b), b))
    full = [b for b in full if sum(b) * 20 >= capacity * 19] or full[:1]
    injected = Counter()
    for b in full:
        if rng.random() < 0.3 and (n := rng.randint(0, donor[b])):
            injected[b] = n
    double = Counter()
    for b, n in injected.items():
        for k in b:
            double[k] += n
    kept, displaced = Counter(into), Counter()
    for b in sorted(into, key=lambda b: (sum(b), b)):
        own = Counter(b)
        hit = [-(-double[k] // c) for k, c in own.items() if double[k]]
        if not hit:
            continue
        gone = min(kept[b], max(hit))
        kept[b] -= gone
        for k, c in own.items():
            dropped = min(double[k], gone * c)
            double[k] -= dropped
            displaced[k] += gone * c - dropped
    return best_fit(displaced, capacity, +kept + injected)


def mutate(plan: Plan, capacity: int, rng: random.Random) -> Plan:
    """Empty the worst bins and a few others, and put their contents back."""
    kept, freed = Counter(plan), Counter()
    for rank, b in enumerate(sorted(plan, key=lambda b: (sum(b), b))):
        if sum(b) < capacity and (rank < 4 or rng.random() < 0.05):
            n = rng.randint(1, kept[b])
            kept[b] -= n
            for k in b:
                freed[k] += n
    return best_fit(freed, capacity, +kept)


def evolve(lengths: Counter, capacity: int, population: list[Plan], generations: int, size: int, seed: int) -> list[Plan]:
    """One island's epoch; the best plan comes first and never gets worse."""
    rng, best = random.Random(seed), lower_bound(lengths, capacity)
    value = lambda p: fitness(p, capacity)
    pool = list(population)
    while len(pool) < size:
        # A best-fit start whose small lengths come in after a random cut: other bins, as full.
        cut = rng.randint(1, capacity)
        first = best_fit(Counter({k: n for k, n in lengths.items() if k >= cut}), capacity)
        pool.append(best_fit(Counter({k: n for k, n in lengths.items() if k < cut}), capacity, first))
    for _ in range(generations):
        pool = sorted(pool, key=value, reverse=True)[:size]
        if sum(pool[0].values()) == best:
            break
        a, b = pool[0], rng.choice(pool[1:] or pool)
        children = [crossover(a, b, capacity, rng), crossover(b, a, capacity, rng)]
        pool += [*children, mutate(min(children, key=value), capacity, rng)]
    return sorted(pool, key=value, reverse=True)[:size]


def _rows(plan: Plan) -> tuple[list[list[int]], list[int]]:
    return [list(b) for b in plan], list(plan.values())


def plan_bins(spark, lengths: Counter, capacity: int, islands: int = 6, epochs: int = 3, generations: int = 12, size: int = 6, seed: int = 1) -> Plan:
    """Evolve islands in Spark tasks; the elite of each is sent to all after an epoch.

    What moves through the driver are histograms and plans, bounded by the capacity.
    """
    if not lengths:
        return Counter()
    counts, best, elites = dict(lengths), Counter(), []
    bound = lower_bound(lengths, capacity)
    for epoch in range(epochs):
        sent = [dict(e) for e in elites]

        def island(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    start = [best_fit(Counter(counts), capacity), *map(Counter, sent)]
                    bins, many = _rows(evolve(Counter(counts), capacity, start, generations, size, seed + 1000 * epoch + k)[0])  # noqa: B023
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([bins], pa.list_(pa.list_(pa.int32()))), pa.array([many], pa.list_(pa.int64()))], names=["island", "bins", "many"])

        found = spark.range(0, islands, 1, islands).mapInArrow(island, "island long, bins array<array<int>>, many array<long>").collect()
        elites = [Counter(dict(zip(map(tuple, r.bins), r.many))) for r in sorted(found)]
        best = max(elites, key=lambda p: (fitness(p, capacity), sorted(p)))
        if sum(best.values()) == bound:
            break
    return best


class Places:
    """The plan as a table: rank r among the pieces of one length has one sequence and offset."""

    def __init__(self, plan: Plan):
        rows, first, filled = [], 0, Counter()
        for b in sorted(plan, reverse=True):
            offset = 0
            for length, copies in sorted(Counter(b).items(), reverse=True):
                rows.append((length, filled[length], copies, first, offset))
                filled[length] += copies * plan[b]
                offset += copies * length
            first += plan[b]
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.length, self.base, self.copies, self.first, self.offset = table.T
        self.key = self.length << 44 | self.base

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.searchsorted(self.key, length << 44 | rank, "right") - 1
        copy, nth = np.divmod(rank - self.base[row], self.copies[row])
        return self.first[row] + copy, self.offset[row] + nth * length


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """Token pieces of at most ``capacity``: doc_id, piece, start, length, ids_crc32, and place (a
    number of its own for each row), stored.

    Only documents longer than a sequence are cut. A null or empty text has the end id alone.
    Repeated rows are cut as often as they occur; an empty table gives no rows; null ids stay
    null; columns other than doc_id and text are ignored whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = library_encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, 1000):
            cols: list[list] = [[], [], [], [], []]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(texts(batch))):
                ids += end
                for no, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for c, v in zip(cols, (doc_id, no, at // 4, len(part) // 4, zlib.crc32(part))):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")
    return stored(cut.withColumn("place", F.monotonically_increasing_id()), "pieces")


#: Pieces of one length that a rank window should hold about.
RANKED_TOGETHER = 100_000


def pack(cut: DataFrame, capacity: int) -> DataFrame:
    """``cut`` (of ``pieces``) with sequence_id and offset.

    Ranks among equal lengths come in two steps, counts by length and hash bucket and then a
    window within a bucket, so that a very common length is spread over tasks, and so are the
    pieces of a document that occurs very often.
    """
    counts = cut.groupBy("length").count().collect()  # one row a length: at most `capacity`
    lengths = Counter({r["length"]: r["count"] for r in counts})
    places = Places(plan_bins(cut.sparkSession, lengths, capacity))
    buckets = max(16, -(-max(lengths.values(), default=0) // RANKED_TOGETHER))
    spread = cut.withColumn("bucket", F.pmod(F.xxhash64("place"), F.lit(buckets)).cast("int"))
    sums = spread.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = stored(sums.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")), "length-ranks")
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "place")
    ranked = spread.withColumn("nth", F.row_number().over(within) - 1).join(base, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, offset = places.of(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """All documents in sequences of at most ``capacity`` tokens, one row a piece.

    Null and empty texts are their end id alone; longer documents than a sequence are cut;
    repeated rows are packed as often as they occur; ties between equal lengths go by doc_id and
    piece within a bucket; no documents, no rows; null ids stay null; columns other than doc_id
    and text are ignored whatever their names.
    """
    return pack(pieces(docs, tokenizer_path, end_id, capacity), capacity)
