"""Terms of several words: collocations by log-likelihood, with correction for nested terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.config import SETTINGS
from quillgraph.functions.scalars import tokens
from quillgraph.sources.tables import materialized


#: Sections whose runs of words are counted in one task, on average.
SECTION_BLOCK = 8192


def runs(words: Column, longest: int) -> Column:
    """All runs of 1 to ``longest`` words of an array, each as one string with blanks between."""
    of = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " ")))
    return F.flatten(F.array(*[F.coalesce(of(n), F.array().cast("array<string>")) for n in range(1, longest + 1)]))


def run_counts(sections: DataFrame, longest: int = SETTINGS.term_words, documents: int = SETTINGS.entity_documents) -> DataFrame:
    """gram, times and frequency (documents) of all runs of words in enough documents. A run of
    words is counted by document first, where the documents' sections are, and every part of a run
    that stays, stays too."""
    tasks = max(1, -(-sections.count() // SECTION_BLOCK))
    cut = sections.select("document_id", "content").repartition(tasks, "document_id")
    cut = cut.select("document_id", tokens(F.col("content")).alias("words"))
    each = cut.select("document_id", F.explode(runs(F.col("words"), longest)).alias("gram"))
    by_document = each.groupBy("gram", "document_id").agg(F.count("*").alias("times"))
    counts = by_document.groupBy("gram").agg(F.sum("times").alias("times"), F.count("*").alias("frequency"))
    return counts.filter(F.col("frequency") >= documents)


def log_likelihood(both: Column, first: Column, second: Column, total: Column) -> Column:
    """How far two things that occur ``first`` and ``second`` times of ``total``, and ``both`` times
    together, are from chance; 0 if they meet less often than by chance."""
    weigh = lambda k: F.when(k > 0, k * F.ln(k)).otherwise(0.0)
    rest = F.greatest(total - first - second + both, F.lit(0.0))
    cells = weigh(both) + weigh(first - both) + weigh(second - both) + weigh(rest)
    sums = weigh(first) + weigh(total - first) + weigh(second) + weigh(total - second)
    return F.when(both * total > first * second, 2 * (cells - sums + weigh(total))).otherwise(0.0)


def terms(counts: DataFrame, total: int, least: float = SETTINGS.term_likelihood, value: float = SETTINGS.term_value, letters: int = SETTINGS.term_letters) -> DataFrame:
    """Terms of two words or more: term, n_words, frequency, times, likelihood and value.

    ``counts``: stored ``run_counts``; ``total``: words of the corpus. A run is a term if wherever
    it is split both parts belong together (the least log-likelihood counts), if its words are long
    enough, and if its C-value is: the logarithm of its length times how often it occurs, less how
    often the terms that hold it do on average.
    """
    words = F.split("gram", " ")
    many = counts.filter(F.size(words) > 1).withColumn("n_words", F.size(words)).filter(F.forall(words, lambda w: F.length(w) >= letters))
    cuts = many.select("gram", "n_words", "times", "frequency", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("at"))
    part = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    cuts = cuts.withColumns({"left": part(F.lit(1), F.col("at")), "right": part(F.col("at") + 1, F.col("n_words") - F.col("at"))})
    known = lambda s: counts.select(F.col("gram").alias(s), F.col("times").cast("double").alias(f"n_{s}"))
    scored = cuts.join(known("left"), "left").join(known("right"), "right")
    likelihood = log_likelihood(F.col("times").cast("double"), F.col("n_left"), F.col("n_right"), F.lit(float(total)))
    firm = scored.groupBy("gram", "n_words", "times", "frequency").agg(F.min(likelihood).alias("likelihood")).filter(F.col("likelihood") >= least)
    firm = materialized(firm, "firm-terms")
    inner = firm.filter("n_words > 2").select("times", F.array_distinct(runs(words, SETTINGS.term_words)).alias("parts"), "gram")
    around = inner.select(F.explode("parts").alias("part"), "gram", "times").filter("part != gram")
    around = around.groupBy(F.col("part").alias("gram")).agg(F.avg("times").alias("around"))
    c_value = F.log2(F.col("n_words").cast("double")) * (F.col("times") - F.coalesce("around", F.lit(0.0)))
    out = firm.join(around, "gram", "left").withColumn("value", c_value).filter(F.col("value") >= value)
    return out.select(F.col("gram").alias("term"), "n_words", "frequency", "times", "likelihood", "value")
