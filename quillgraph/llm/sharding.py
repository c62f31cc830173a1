"""Sharding over fixed virtual slots.

A record's virtual slot is a hash of the record and never changes. What changes is the map
from slots to shards, a small versioned table: the first version balances the bytes of the
slots over the shards, later versions move as few slots as the new balance needs.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, hinted, stored

VIRTUAL_SLOTS = 8192


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1), text_crc32 and copy, stored. Copies of a row are numbered
    from 0; a null text has no bytes.

    Numbers come in two steps, counts by row and partition and then a rank within a partition,
    so that the copies of one row never meet in one task.
    """
    key = ["doc_id", "text_crc32", "size"]
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.crc32(data).alias("text_crc32"), (F.octet_length(data).cast("long") + 1).alias("size"))
    rows = stored(rows.withColumn("place", F.monotonically_increasing_id()), "slot-records")
    repeated = stored(rows.groupBy(key).count().filter("count > 1").select(key), "slot-repeats")
    if repeated.isEmpty():
        discard(repeated)
        return rows.select(*key, F.lit(0).cast("long").alias("copy"))
    same = lambda a, b: reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in key))
    known = hinted(repeated).alias("r")
    once = rows.alias("l").join(known, same("l", "r"), "left_anti").select(*key, F.lit(0).cast("long").alias("copy"))
    again = rows.alias("l").join(known, same("l", "r"), "left_semi").withColumn("part", F.shiftright("place", 33))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = again.groupBy(*key, "part").count().select(*key, "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    nth = again.withColumn("nth", F.row_number().over(Window.partitionBy(*key, "part").orderBy("place")) - 1)
    at = same("n", "b") & (F.col("n.part") == F.col("b.part"))
    copies = nth.alias("n").join(base.alias("b"), at).select(*[F.col(f"n.{c}") for c in key], (F.col("base") + F.col("nth")).alias("copy"))
    out = stored(once.unionByName(copies), "slot-records")
    discard(rows, repeated)
    return out


def with_virtual_slot(records: DataFrame, slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """``records`` of ``numbered`` with virtual_slot, a hash of the record and its copy number."""
    return records.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "copy"), F.lit(slots)).cast("int"))


def slot_sizes(records: DataFrame) -> DataFrame:
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def assign(sizes: dict[int, int], shards: int, current: dict[int, int] | None = None) -> dict[int, int]:
    """Slot to shard, bytes near equal. Slots with a place in ``current`` stay there as long as
    their shard holds no more than its share; only the surplus and new slots move."""
    share, load, out, move = sum(sizes.values()) / shards, [0] * shards, {}, []
    placed = defaultdict(list)
    for slot in sizes:
        shard = (current or {}).get(slot)
        placed[shard if shard is not None and shard < shards else None].append(slot)
    move += placed.pop(None, [])
    for shard, own in placed.items():
        for slot in sorted(own, key=lambda s: (-sizes[s], s)):
            if load[shard] + sizes[slot] <= share:
                out[slot], load[shard] = shard, load[shard] + sizes[slot]
            else:
                move.append(slot)
    heap = [(n, k) for k, n in enumerate(load)]
    heapq.heapify(heap)
    for slot in sorted(move, key=lambda s: (-sizes[s], s)):
        n, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (n + sizes[slot], shard))
    return out


def new_map(spark: SparkSession, sizes: DataFrame, shards: int, slots: int = VIRTUAL_SLOTS, previous: DataFrame | None = None) -> DataFrame:
    """The next version of the map, stored: version, virtual_slot, shard, bytes.

    One row a slot comes to the driver: ``slots`` bounds it whatever the corpus.
    """
    held = {r.virtual_slot: r.bytes for r in sizes.collect()}
    held = {k: held.get(k, 0) for k in range(slots)}
    old = previous.collect() if previous is not None else []
    shard_of = assign(held, shards, {r.virtual_slot: r.shard for r in old})
    version = max((r.version for r in old), default=0) + 1
    rows = [(version, k, shard_of[k], held[k]) for k in range(slots)]
    return stored(spark.createDataFrame(rows, "version int, virtual_slot int, shard int, bytes long").coalesce(1), f"slot-map-v{version}")


def place(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Records with their shard and ``slot``, a gapless place in the shard.

    Places come in two steps: the rows of all slots before (one row a slot is summed), and the
    rank within the virtual slot.
    """
    rows = records.groupBy("virtual_slot").agg(F.count("*").alias("rows"))
    order = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    start = slot_map.join(rows, "virtual_slot").select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(order), F.lit(0)).alias("first"))
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "copy")
    ranked = records.withColumn("nth", F.row_number().over(within) - 1)
    return ranked.join(start, "virtual_slot").select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth")).alias("slot"), "virtual_slot")


def shard_documents(docs: DataFrame, shards: int = 8, slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """Every row in one of ``shards`` shards of near-equal bytes.

    A null or empty text has size 1; very long texts are one record as any other; copies of a
    row are numbered and hash to slots of their own, so many of them are spread as well; null
    ids hash like any other value; an empty table gives no rows; columns other than doc_id and
    text are ignored whatever their names.
    """
    records = with_virtual_slot(numbered(docs), slots)
    return place(records, new_map(docs.sparkSession, slot_sizes(records), shards, slots))
