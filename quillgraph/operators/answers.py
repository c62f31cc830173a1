"""An extractive answer: sentences of several sources by maximal marginal relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.config import SETTINGS
from quillgraph.functions.scalars import tokens
from quillgraph.sources.tables import materialized


def sentences(sections: DataFrame) -> DataFrame:
    """Sentences of sections (_id, content, relevance_score), by stops and white space behind them:
    section_id, nth, sentence, words (distinct), relevance_score. Sentences without a word go."""
    cut = F.posexplode(F.split("content", r"(?<=[.!?])\s+", -1)).alias("nth", "sentence")
    rows = sections.select(F.col("_id").alias("section_id"), "relevance_score", cut)
    return rows.withColumn("words", F.array_distinct(tokens(F.col("sentence")))).filter(F.size("words") > 0)


def _overlap(words: Column, other: Column) -> Column:
    """Jaccard similarity of two arrays of distinct words."""
    both = F.size(F.array_intersect(words, other))
    return both / (F.size(words) + F.size(other) - both)


def marginal_sentences(found: DataFrame, query: str, n: int = SETTINGS.answer_sentences, weight: float = SETTINGS.answer_relevance) -> DataFrame:
    """Up to n of ``sentences``: place (from 1), section_id, nth, sentence and score.

    One by one that sentence is taken whose relevance, times ``weight``, exceeds its likeness to
    the sentence most like it of those taken, times 1 - ``weight``, by most. Relevance is the
    share of the question's words in the sentence, scaled by its section's part of the best
    score; likeness is the Jaccard similarity of words. Of equals (in nine digits) the least
    section and place comes first. Only the sentences taken reach the driver.
    """
    spark, held = found.sparkSession, materialized(found, "sentences")
    asked = F.array_distinct(tokens(F.lit(query)))
    top = held.agg(F.max("relevance_score")).first()[0] or 1.0
    relevance = F.size(F.array_intersect("words", asked)) / F.greatest(F.lit(1), F.size(asked)) * F.col("relevance_score") / F.lit(top)
    rest, taken = held.withColumn("relevance", relevance).withColumn("likeness", F.lit(0.0)), []
    for _ in range(n):
        score = F.round(weight * F.col("relevance") - (1 - weight) * F.col("likeness"), 9)
        best = rest.withColumn("score", score).orderBy(F.desc("score"), "section_id", "nth").first()
        if best is None:
            break
        taken.append((len(taken) + 1, best.section_id, best.nth, best.sentence, best.score))
        chosen = F.array(*map(F.lit, best.words))
        rest = rest.filter((F.col("section_id") != best.section_id) | (F.col("nth") != best.nth)).withColumn("likeness", F.greatest("likeness", _overlap(F.col("words"), chosen)))
    return spark.createDataFrame(taken, "place int, section_id string, nth int, sentence string, score double")
