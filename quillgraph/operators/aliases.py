"""Resolution of spellings: names that differ by a slip of the pen, and initials of names.

Names are blocked by what is left of them without a character, and what meets is verified by edit
distance. A rare spelling goes to the nearest, most frequent name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.config import SETTINGS
from quillgraph.sources.tables import materialized


def struck(name: Column, edits: int) -> Column:
    """A name and what is left of it without any one character, or any two for two edits and so
    on. Two names within that many edits have one of these in common."""
    out = F.array(name)
    for _ in range(edits):
        without = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(x))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, without))))
    return out


def near_names(names: DataFrame, edits: int = SETTINGS.alias_edits, letters: int = SETTINGS.entity_letters) -> DataFrame:
    """Pairs of ``names`` (name) of at least ``letters`` letters that differ by at most so many
    inserted, deleted or replaced characters: a, b (a < b) and distance.

    Names meet under what is left of both without a character; under one such key there are no
    more names than places for a character times characters.
    """
    held = names.filter(F.length("name") >= letters).select("name").distinct()
    keyed = materialized(held.select("name", F.explode(struck(F.col("name"), edits)).alias("key")), "struck-names")
    left, right = keyed.select("key", F.col("name").alias("a")), keyed.select("key", F.col("name").alias("b"))
    pairs = left.join(right, "key").filter("a < b").select("a", "b").distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b", edits)).filter(F.col("distance").between(0, edits))


def corrected(counts: DataFrame, edits: int = SETTINGS.alias_edits, times: int = SETTINGS.alias_times) -> DataFrame:
    """``name``, ``alias`` and the alias's n: rare spellings with the name each stands for.

    ``counts``: name, n. A spelling stands for a name within ``edits`` that occurs at least
    ``times`` as often; of several for the nearest, then the most frequent, then the first. A name
    that itself stands for another is followed to that one, so chains end at one name.
    """
    near = near_names(counts.select("name"), edits)
    of = lambda s: counts.select(F.col("name").alias(s), F.col("n").alias(f"n_{s}"))
    both = near.join(of("a"), "a").join(of("b"), "b")
    way = lambda x, y: F.struct(F.col(x).alias("alias"), F.col(f"n_{x}").alias("n"), F.col(y).alias("name"), F.col(f"n_{y}").alias("n_name"), "distance")
    each = both.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("e")).select("e.*").filter(F.col("n_name") >= times * F.col("n"))
    best = F.min(F.struct("distance", (-F.col("n_name")).alias("less"), "name")).alias("best")
    step = materialized(each.groupBy("alias", "n").agg(best).select("alias", "n", "best.name"), "alias-steps")
    # Frequencies grow at least ``times`` fold along a chain, so it has few links.
    while True:
        on = step.select(F.col("alias").alias("name"), F.col("name").alias("next"))
        joined = materialized(step.join(on, "name", "left").select("alias", "n", F.coalesce("next", "name").alias("name"), F.col("next").isNotNull().alias("moved")), "alias-steps")
        step = joined.drop("moved")
        if joined.filter("moved").isEmpty():
            return step.select("name", "alias", "n")


def initialled(names: DataFrame, short: DataFrame, least: int = 2) -> DataFrame:
    """``name`` and ``alias``: initials in ``short`` (alias) of the names of several words in
    ``names`` (name), if only one name has them."""
    words = F.split("name", " ")
    initials = F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))
    many = names.filter(F.size(words) >= least).withColumn("alias", initials)
    one = many.groupBy("alias").agg(F.min("name").alias("name"), F.count_distinct("name").alias("n")).filter("n = 1").drop("n")
    return one.join(short.select("alias").distinct(), "alias").select("name", "alias")
