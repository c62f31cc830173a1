"""Exact similarity join of sets that are given by their postings.

Every pair of sets that meet in an element is counted there, so what this costs follows from how
many sets the elements hold and not from how large the sets of likely pairs are. Sets are numbered;
the smaller set of each pair gets, from each of its elements, one list of the larger ones that it
meets there and that are not too large for it. The lists of a set come together in one place, so
pairs are counted, and nearly all of them dropped, before anything else is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.sources.tables import broadcast_if_small, materialized

#: Sets of an element, or elements of a set, that meet in one task.
ELEMENT_BLOCK, SET_BLOCK = 512, 1 << 16
#: Parts at most that the elements of a set are dealt into, by hash; each is counted on its own.
CLASSES = 64
#: Postings whose sets are counted in one task; what a task holds and spills follows from that.
TASK_POSTINGS = 1 << 18
#: What bounds are taken by, so that rounding drops no pair of very large sets at the threshold.
CLOSE = 1 - 1e-12
#: Bits of a set's number; its size stands above them, so that sets are in order of their sizes.
ID_BITS = 31


def _numbered(sizes: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``sizes`` (name, n), stored, with the size and a number in one, set; and the sum of n."""
    made = materialized(sizes.select(name, "n", F.monotonically_increasing_id().alias("row")), "set-sizes")
    # Such ids leave gaps between partitions; without these they fit into few bits.
    part, within = F.shiftright("row", 33), F.col("row").bitwiseAND((1 << 33) - 1)
    most = made.agg(F.max(part).alias("part"), F.max(within).alias("within"), F.sum("n").alias("n")).first()
    width = (most.within or 0) + 1
    if width * ((most.part or 0) + 1) > 1 << ID_BITS:
        raise ValueError(f"more sets than {ID_BITS} bits can number")
    return made.select(name, "n", F.shiftleft("n", ID_BITS).bitwiseOR(part * width + within).alias("set")), most.n or 0


def similar_sets(
    postings: DataFrame,
    threshold: float,
    name: str = "name",
    element: tuple[str, ...] = ("document_id", "order"),
    sums: tuple[str, ...] | dict[str, Column] = (),
    tells: tuple[str, ...] = (),
    sizes: DataFrame | None = None,
    common: DataFrame | None = None,
) -> DataFrame:
    """Pairs of sets with a Jaccard similarity of at least ``threshold``: a, b (a < b), n_a, n_b,
    n_together, and the ``sums`` of what the elements that both hold tell, added up.

    Nothing is held together under a key with a null, which still counts in the size of a set.

    ``postings``: distinct rows of a set's name, the columns of an element, and those that tell of
    the element: ``sums``, or ``tells`` if ``sums`` are expressions over these; only they are
    shuffled. Nothing is grouped by an element or a set alone: very common elements are cut into
    blocks of sets, and large sets into blocks of elements, so no task holds either whole.

    Whoever knows them gives ``sizes`` (name, n: the rows of each set; sets that don't stand there
    take no part) and ``common`` (an element's columns and held, no fewer sets than it has; those
    with more than ``ELEMENT_BLOCK``, others may follow). Then postings are read once; else they
    should be stored.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    key, added = list(element), sums if isinstance(sums, dict) else {c: F.col(c) for c in sums}
    tells = tuple(tells) if isinstance(sums, dict) else tuple(sums)
    if sizes is None:
        sizes = postings.groupBy(name).agg(F.count("*").alias("n"))
    if common is None:
        common = postings.groupBy(*key).agg(F.count("*").alias("held"))
    sets, total = _numbered(sizes, name)
    # Sets meet in blocks of an element, each with its own and with every other block.
    common = common.filter(F.col("held") > ELEMENT_BLOCK)
    common = materialized(common.select(*key, F.ceil(F.col("held") / ELEMENT_BLOCK).cast("int").alias("blocks")), "common-elements")
    known = broadcast_if_small(sets)
    held = postings.dropna(subset=key).join(known, name).join(broadcast_if_small(common), key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block_of = lambda x: F.pmod(F.xxhash64(x), F.col("blocks")).cast("int")
    held = held.withColumn("block", block_of(F.col("set"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    met = held.groupBy(*key, i, j).agg(F.sort_array(F.collect_list("set")).alias("met"), F.max("blocks").alias("blocks"), *[F.max(c).alias(c) for c in tells])
    heads = met.filter(F.size("met") > 1).select(*key, *tells, "i", "j", "blocks", "met", F.posexplode("met").alias("at", "head"))
    size_of = lambda x: F.shiftright(x, ID_BITS)
    can = lambda x: (F.lit(threshold * CLOSE) * size_of(x) <= size_of("head") + 1e-9) & ((F.col("i") == F.col("j")) | (block_of(x) != block_of(F.col("head"))))
    number = lambda x: x.bitwiseAND((1 << ID_BITS) - 1).cast("int")
    later = F.transform(F.filter(F.slice("met", F.col("at") + 2, F.size("met")), can), number)
    parts = lambda x: F.least(F.ceil(size_of(x) / SET_BLOCK), F.lit(CLASSES)).cast("int")
    lists = heads.select(F.col("head").alias("a"), F.pmod(F.xxhash64(*key), parts("head")).cast("int").alias("part"), later.alias("later"), *tells)
    # Lists are short beside the pairs that come of them, so Spark would put too many into a task.
    tasks = max(postings.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_POSTINGS))
    each = lists.filter(F.size("later") > 0).repartition(tasks, "a", "part").withColumn("b", F.explode("later"))
    # b has no fewer elements than a; a set in one part is counted in full here.
    enough = F.col("n_together") >= F.lit(2 * threshold / (1 + threshold) * CLOSE) * size_of("a") - 1e-9
    counted = each.groupBy("a", "part", "b").agg(F.count("*").alias("n_together"), *[F.sum(c).alias(k) for k, c in added.items()]).filter((parts("a") > 1) | enough)
    both = counted.groupBy("a", "b").agg(F.sum("n_together").alias("n_together"), *[F.sum(k).alias(k) for k in added]).filter(enough)
    both = both.withColumn("a", number(F.col("a")))
    named = lambda side: known.select(number(F.col("set")).alias(side), F.struct(F.col(name).alias("name"), "n").alias(f"set_{side}"))
    both = both.join(named("a"), "a").join(named("b"), "b").withColumns({"a": F.least("set_a", "set_b"), "b": F.greatest("set_a", "set_b")})
    return both.select(F.col("a.name").alias("a"), F.col("b.name").alias("b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"), "n_together", *added).filter(
        F.col("n_together") / (F.col("n_a") + F.col("n_b") - F.col("n_together")) >= threshold
    )
