"""An inverted index with score bounds, and ranked search by it.

Texts are dealt into ranges. For each term and range the index holds the postings (text, how
often, how long) and the most that the term can add to a score there. A question first scores the
few ranges of highest bound; the k-th score found is a threshold, and of all other ranges only
those whose bound reaches it are read. Results are those of scoring every text.

Many questions leave hardly a range unread, so these are dealt into blocks instead: each block of
questions meets each block of ranges in one task, which returns its best texts for each question
and never a row for a word of a question in a text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.config import SETTINGS
from quillgraph.functions.scalars import tokens
from quillgraph.sources.tables import modest_batches

Store = Callable[[str, Callable[[], DataFrame]], DataFrame]

#: Ranges that are indexed in one task, on average.
RANGE_BLOCK = 8
#: Rows at most, words of questions times ranges, that are broadcast.
FEW = 1 << 18
#: Questions, words of questions, and ranges that meet in one task at most, about; questions scored
#: at a time. Questions are shuffled once for each block of ranges, and ranges once for each block of
#: questions, so blocks are as large as a task can hold.
QUESTION_BLOCK, WORD_BLOCK, MET_RANGES, AT_A_TIME = 1 << 17, 1 << 21, 128, 16
#: Tasks for each core at least, if there are ranges enough; partitions for each task.
TASKS_A_CORE, SPARE = 2, 4
#: Words in more than one text in so many are scored as whole rows.
DENSE = 8


def _damped(tf, length, mean):
    """A term's part of the BM25 score of a text, but for the weight of the term: of columns, or of
    arrays of numbers."""
    k1, b = SETTINGS.bm25_k1, SETTINGS.bm25_b
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def _narrow(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest needs."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0)))).tobytes()


def _numbers(column: pa.ChunkedArray, counts: list[int]) -> np.ndarray:
    """The numbers of all rows of a column of ``_narrow``, so many in each."""
    rows = [np.frombuffer(x, f"<u{len(x) // n}") if n else np.zeros(0, np.uint8) for x, n in zip(column.to_pylist(), counts)]
    return np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)


_PACKED = "range int, names array<string>, lens binary, terms array<string>, held binary, at binary, tf binary"


def _packed(texts: DataFrame) -> DataFrame:
    """``texts`` (_id, range, words), a row for each range: names and lengths of its texts, its terms
    and how many texts hold each, and for each of these the text's number and how often. Texts stand
    there once, terms once a range, and a posting takes a few bytes."""

    def pack(table: pa.Table) -> pa.Table:
        coded, words = table.column("_id").combine_chunks().dictionary_encode(), table.column("words").combine_chunks()
        terms = words.flatten().dictionary_encode()
        text = np.repeat(coded.indices.to_numpy(), words.value_lengths().to_numpy()).astype(np.int64)
        n = len(coded.dictionary)
        key, tf = np.unique(terms.indices.to_numpy().astype(np.int64) * n + text, return_counts=True)
        row = {"names": coded.dictionary, "lens": _narrow(np.bincount(text, minlength=n)), "terms": terms.dictionary, "held": _narrow(np.bincount(key // n, minlength=len(terms.dictionary))), "at": _narrow(key % n), "tf": _narrow(tf)}
        cols = {c: pa.array([x], pa.binary()) if isinstance(x, bytes) else pa.ListArray.from_arrays([0, len(x)], x) for c, x in row.items()}
        return pa.table({"range": table.column("range").slice(0, 1).combine_chunks(), **cols})

    return texts.groupBy("range").applyInArrow(pack, _PACKED)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best scores above 0 in order; of those equal to nine digits the first."""
    width = len(scores) // (16 * k) if k else 0
    # So many parts each hold a score as high as the k-th highest of their maxima.
    floor = np.partition(scores[: 16 * k * width].reshape(16 * k, width).max(1), 15 * k)[15 * k] if width > 1 else 0
    place = np.flatnonzero(scores >= floor - 2e-9) if floor > 2e-9 else np.flatnonzero(scores > 0)
    value = np.round(scores[place], 9)
    return place[np.lexsort((place, -value))[:k]]


def _best_of(asked: pa.Table, held: pa.Table, mean: float, k: int) -> tuple[pa.Array, list[tuple]]:
    """The texts of ``held`` (rows of ``_packed``) in order of their ids, and for some questions of
    ``asked`` (query_id, terms, weights) at a time: rows, texts and scores of the k best of each.
    Common words are added by a matrix product, others where they occur."""
    names, terms, listed = (t.column(c).combine_chunks() for t, c in ((held, "names"), (held, "terms"), (asked, "terms")))
    n_names, n_terms = names.value_lengths().to_numpy(), terms.value_lengths().to_numpy()
    order = pc.array_sort_indices(names.flatten())
    names, rank = names.flatten().take(order), np.empty(len(order), np.int32)
    rank[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
    # Only what some question asks for is spread out.
    asked_terms = listed.flatten().dictionary_encode()
    code = pc.fill_null(pc.index_in(terms.flatten(), asked_terms.dictionary), -1).to_numpy()
    times = _numbers(held.column("held"), n_terms.tolist())
    postings = np.add.reduceat(np.append(times, 0), np.append(0, np.cumsum(n_terms)[:-1])) * (n_terms > 0) if len(n_terms) else np.zeros(0, int)
    wanted = np.repeat(code >= 0, times)
    by = np.repeat(code, times)[wanted]
    at = (_numbers(held.column("at"), postings.tolist()) + np.repeat(np.cumsum(n_names) - n_names, postings))[wanted]
    part = _damped(_numbers(held.column("tf"), postings.tolist())[wanted].astype(float), _numbers(held.column("lens"), n_names.tolist())[at], mean)
    sort = np.argsort(by, kind="stable")
    text, part = rank[at[sort]], part[sort]
    starts = np.searchsorted(by[sort], np.arange(len(asked_terms.dictionary) + 1)).tolist()
    del wanted, by, at, sort
    lengths, word, weight = listed.value_lengths().to_numpy(), asked_terms.indices.to_numpy(), asked.column("weights").combine_chunks().flatten().to_numpy()
    ends = np.append(0, np.cumsum(lengths))
    dense = np.flatnonzero(np.diff(starts) * DENSE > len(names))
    place = np.full(len(asked_terms.dictionary), -1)
    place[dense] = np.arange(len(dense))
    whole = np.zeros((len(dense), len(names)))
    for row, t in enumerate(dense.tolist()):
        whole[row, text[starts[t] : starts[t + 1]]] = part[starts[t] : starts[t + 1]]
    found = []
    for first in range(0, asked.num_rows, AT_A_TIME):
        n = min(AT_A_TIME, asked.num_rows - first)
        some = slice(ends[first], ends[first + n])
        row, w, x = np.repeat(np.arange(n), lengths[first : first + n]), word[some], weight[some]
        common, part_of = place[w] >= 0, np.zeros((n, len(dense)))
        part_of[row[common], place[w[common]]] = x[common]
        scores = part_of @ whole
        for r, t, y in zip(row[~common].tolist(), w[~common].tolist(), x[~common].tolist()):
            a, b = starts[t], starts[t + 1]
            if a < b:
                scores[r][text[a:b]] += y * part[a:b]
        for r in range(n):
            best = _best(scores[r], k)
            found.append((np.full(len(best), first + r), best, scores[r][best]))
    return names, found


@dataclass(frozen=True)
class TextIndex:
    """Stored tables of an index.

    ``about``: one row with the number of texts, their mean length in words and the number of
    ranges. ``terms``: term, df and most, its highest part of any score. ``postings``: term, range,
    n, most and entries, sorted by term within files, so that a search for given terms skips row
    groups. ``packed``: the postings of each range in one row, stored when many questions ask.
    """

    about: DataFrame
    terms: DataFrame
    postings: DataFrame
    build_packed: Callable[[], DataFrame]

    @cached_property
    def packed(self) -> DataFrame:
        return self.build_packed()

    @classmethod
    def of(cls, texts: DataFrame, store: Store, name: str = "section") -> TextIndex:
        """Index ``texts`` (_id, content). Texts without a word count in the statistics only."""
        cut = texts.select("_id", tokens(F.coalesce("content", F.lit(""))).alias("words"))
        ranges = F.greatest(F.lit(1), F.ceil(F.count("*") / SETTINGS.range_sections)).cast("int")
        about = store(f"{name}-index-about", lambda: cut.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size("words")), F.lit(1.0)).alias("mean"), ranges.alias("ranges")))
        # One row, as any aggregate without a key.
        mean, n = (about.first()[c] or 1 for c in ("mean", "ranges"))

        def words() -> DataFrame:
            # Texts are dealt out by range once; what is counted and listed then stays in place.
            near = texts.withColumn("range", F.pmod(F.xxhash64("_id"), F.lit(n)).cast("int")).repartition(-(-n // RANGE_BLOCK), "range")
            return near.select("_id", "range", tokens(F.coalesce("content", F.lit(""))).alias("words"))

        def packed() -> DataFrame:
            modest_batches(texts.sparkSession)
            return _packed(words().filter(F.size("words") > 0))

        def postings() -> DataFrame:
            each = words().select("_id", "range", F.size("words").alias("len"), F.explode("words").alias("term"))
            counts = each.groupBy("_id", "range", "len", "term").agg(F.count("*").alias("tf"))
            part = _damped(F.col("tf"), F.col("len"), F.lit(mean))
            made = counts.groupBy("term", "range").agg(F.count("*").alias("n"), F.max(part).alias("most"), F.collect_list(F.struct("_id", "tf", "len")).alias("entries"))
            return made.sortWithinPartitions("term", "range")

        held = store(f"{name}-index-postings", postings)
        terms = store(f"{name}-index-terms", lambda: held.groupBy("term").agg(F.sum("n").alias("df"), F.max("most").alias("most")))
        return cls(about, terms, held, lambda: store(f"{name}-index-packed", packed))

    def _weighted(self, questions: DataFrame) -> DataFrame:
        """query_id, term and its weight, for every distinct word of a question that some text has."""
        n = self.about.first()["n"]
        asked = questions.select("query_id", F.explode(F.array_distinct(tokens(F.coalesce("query", F.lit(""))))).alias("term")).distinct()
        weight = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return asked.join(self.terms.select("term", "df"), "term").select("query_id", "term", weight.alias("weight"))

    def _few(self, words: DataFrame) -> bool:
        """Whether a row for each of ``words`` and range is few enough to be broadcast, so that the
        postings stay where they are."""
        return words.count() * (self.about.first()["ranges"] or 1) <= FEW

    def _scored(self, wanted: DataFrame) -> DataFrame:
        """query_id, _id, relevance_score of all postings of ``wanted`` (query_id, term, weight and,
        if only some are, range)."""
        mean = self.about.first()["mean"] or 1.0
        on = [c for c in ("term", "range") if c in wanted.columns]
        found = wanted.join(self.postings.select("term", "range", "entries"), on).select("query_id", "weight", F.inline("entries"))
        part = F.col("weight") * _damped(F.col("tf"), F.col("len"), F.lit(mean))
        return found.groupBy("query_id", "_id").agg(F.sum(part).alias("relevance_score"))

    def all_scores(self, questions: DataFrame) -> DataFrame:
        """query_id, _id and relevance_score of every text that holds a word of the question
        (``questions``: query_id, query)."""
        words = self._weighted(questions)
        return self._scored(F.broadcast(words) if self._few(words) else words)

    def _met(self, words: DataFrame, k: int) -> DataFrame:
        """query_id, _id and relevance_score: of each block of ranges the k best texts of each
        question, of equals those of the least _id."""
        modest_batches(words.sparkSession)
        many = words.agg(F.count_distinct("query_id").alias("n"), F.count("*").alias("words")).first()
        ranges, mean = self.about.first()["ranges"], self.about.first()["mean"] or 1.0
        n_asked = max(1, -(-many.n // QUESTION_BLOCK), -(-many.words // WORD_BLOCK))
        cores = words.sparkSession.sparkContext.defaultParallelism
        n_held = max(1, -(-ranges // MET_RANGES), min(ranges, -(-TASKS_A_CORE * cores // n_asked)))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        asked = words.groupBy("query_id").agg(F.collect_list(F.struct("term", "weight")).alias("words"))
        left = asked.select("query_id", F.col("words.term").alias("terms"), F.col("words.weight").alias("weights"), F.pmod(F.xxhash64("query_id"), F.lit(n_asked)).cast("int").alias("i"), every(n_held).alias("j"))
        right = self.packed.withColumns({"i": every(n_asked), "j": F.col("range") % n_held}).drop("range")
        # Blocks are few and large; with more partitions than blocks hardly any two share one.
        left, right = (df.repartition(SPARE * n_asked * n_held, "i", "j") for df in (left, right))

        def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
            names, found = pa.array([], pa.string()), []
            if asked.num_rows and held.num_rows:
                names, found = _best_of(asked, held, mean, k)
            rows, cols, scores = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, t) for c, t in enumerate((np.int64, np.int64, float)))
            return pa.table({"query_id": asked.column("query_id").take(pa.array(rows)), "_id": names.take(pa.array(cols)), "relevance_score": pa.array(scores)})

        kind = dict(words.dtypes)["query_id"]
        return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(meet, f"query_id {kind}, _id string, relevance_score double")

    def top(self, questions: DataFrame, k: int = SETTINGS.max_results, store: Store | None = None) -> DataFrame:
        """The k best texts of each question: query_id, _id, relevance_score and place (from 1).

        Scores that differ in the tenth digit count as equal; of equals the least _id comes first.
        Questions without a word that some text has get no rows. ``store``, if given, keeps the
        words of the questions and their bounds, which are used twice.
        """
        return self.top_weighted(self._weighted(questions), k, store)

    def top_weighted(self, words: DataFrame, k: int = SETTINGS.max_results, store: Store | None = None) -> DataFrame:
        """``top`` for questions given as words with weights of their own: query_id, term, weight,
        all weights positive. Of the ranges scored first only the k best are kept."""
        store, given = store or (lambda _, build: build()), words
        words = store("question-words", lambda: given)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("relevance_score", 9)), "_id"))
        if not self._few(words):
            return self._met(words, k).withColumn("place", place).filter(F.col("place") <= k)
        near = F.broadcast
        bounds = near(words).join(self.postings.select("term", "range", "most"), "term").groupBy("query_id", "range").agg(F.sum(F.col("weight") * F.col("most")).alias("bound"))
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "range"))
        bounds = store("question-bounds", lambda: bounds.withColumn("nth", nth))
        first = self._scored(near(words.join(bounds.filter(F.col("nth") <= SETTINGS.seed_ranges), "query_id").select("query_id", "term", "weight", "range")))
        known = store("question-scores", lambda: first.withColumn("place", place).filter(F.col("place") <= k))
        reached = known.groupBy("query_id").agg(F.count("*").alias("n"), F.min("relevance_score").alias("least"))
        # A range whose bound is the k-th score itself may hold a text of smaller id.
        open_ = F.col("n").isNull() | (F.col("n") < k) | (F.col("bound") >= F.col("least") - 1e-6)
        rest = bounds.filter(F.col("nth") > SETTINGS.seed_ranges).join(reached, "query_id", "left").filter(open_).select("query_id", "range")
        more = self._scored(near(words.join(rest, "query_id").select("query_id", "term", "weight", "range")))
        both = known.drop("place").unionByName(more)
        return both.withColumn("place", place).filter(F.col("place") <= k)
