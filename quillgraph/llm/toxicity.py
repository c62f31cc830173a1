"""Toxic passages: maximal scoring segments over token log-odds with a Dirichlet prior.

Fitting. Labelled texts that may be learned from are thinned to one of each group of near
copies, and the documents that hold a word are counted by label. Log-odds under an informative
Dirichlet prior, divided by their standard deviation, tell which words mark toxic text and which
mark clean text. A token of the former scores the logarithm of its share in a toxic passage over
its share in clean text, one of the latter its negative log-odds; every other token scores a
little below zero, so clean text drifts downwards. The vocabulary is bounded by the bounded
sample of labelled rows and by nothing else; ``MIN_Z`` and ``MIN_DOCS`` say what is significant.

Scoring. One linear scan finds all maximal segments of a document. A segment of score S in n
tokens comes about by chance with an expected number of K n exp(-lambda S). Lambda solves
E[exp(lambda s)] = 1 over the token scores s of the clean texts, and K follows from how many
segments those have. The significant segments of a document add up to one statistic, which a
logistic curve turns into a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, held_out, hinted, slices, stored

_WORD = regex.compile(r"\p{L}+")
#: The fit reads about this many labelled documents of either label.
ROWS_PER_LABEL = 6000
#: Words whose log-odds are so many standard deviations above zero mark toxic text.
MIN_Z = 3.0
MIN_DOCS = 4
#: Weight of the prior against the data, and share of marked words in a toxic passage.
PRIOR = 0.05
PASSAGE_SHARE = 0.1
SIGNIFICANT = 0.05
_DRAWS = 1_000_000
_SKETCHES = 4


@dataclass
class Model:
    score: dict[str, float]
    other: float
    log_k: float
    rate: float
    slope: float
    offset: float


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a score sequence, in linear time.

    Candidates are kept on a stack with the sums before and after them; a new one is merged
    with the nearest candidate that began lower, if that one also ended lower.
    """
    stack: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    lower: list[int] = []  # for each candidate, the nearest before it that began lower
    total = 0.0
    for k, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, left, right = k, before, total
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = lower[j]
            if j < 0 or stack[j][3] >= right:
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:], lower[j:]
        stack.append((start, k + 1, left, right))
        lower.append(j)
    return [(a, b, r - x) for a, b, x, r in stack]


def passages(words: list[str], score: dict[str, float], other: float) -> list[tuple[int, int, float]]:
    """Maximal segments of a text. Runs of unmarked tokens count as one step."""
    get = score.get
    marked = [(k, s) for k, w in enumerate(words) if (s := get(w)) is not None]
    steps: list[float] = []
    places: list[int] = []
    at = 0
    for k, s in marked:
        if k > at:
            steps.append(other * (k - at))
            places.append(at)
        steps.append(s)
        places.append(k)
        at = k + 1
    return [(places[a], places[b - 1] + 1, s) for a, b, s in segments(steps)]


def statistic(found: list[tuple[int, int, float]], n_tokens: int, log_k: float, rate: float) -> float:
    """Sum over significant segments of minus the log of their chance; the best counts anyway."""
    log_n = math.log(max(n_tokens, 1))
    worth = sorted((rate * s - log_k - log_n for _, _, s in found), reverse=True)
    floor = -math.log(SIGNIFICANT)
    return sum(max(0.0, x) for k, x in enumerate(worth) if k == 0 or x >= floor)


def labelled(docs: DataFrame, labels: DataFrame, rows_per_label: int = ROWS_PER_LABEL) -> DataFrame:
    """doc_id, toxic, text of documents that may be learned from, about evenly by label.

    Rows with a null id, text or label teach nothing. Contradicting labels of one id count as
    toxic. Of several texts of one id that of the least hash is taken, so the rows are bounded.
    """
    marks = labels.filter(F.col("toxic").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = marks.groupBy("toxic").count()
    share = stored(counts.select("toxic", (F.lit(float(rows_per_label)) / F.col("count") * _DRAWS).alias("upto")), "label-shares")
    drawn = marks.join(hinted(share, 100), "toxic").filter(F.pmod(F.xxhash64("doc_id"), F.lit(_DRAWS)) < F.col("upto")).select("doc_id", "toxic")
    drawn = stored(drawn, "label-draws")
    texts = docs.filter(~held_out("doc_id") & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    least = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least")
    return texts.join(hinted(drawn), "doc_id").groupBy("doc_id", "toxic").agg(least).select("doc_id", "toxic", "least.text")


def _thinned(rows: DataFrame) -> DataFrame:
    """toxic, words (distinct), n_tokens: one of each group of near copies with the same label.

    Near copies share least hashes of their five-word windows; each of a few hash functions in
    turn lets one row pass for each least hash, that of the least doc_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        turns = np.random.default_rng(7).integers(1, 2**63, _SKETCHES, dtype=np.uint64) | np.uint64(1)
        for batch in slices(batches):
            words, sizes, sketch = [], [], []
            for text in batch.column("text").to_pylist():
                own = tokens(text)
                windows = list(zip(*(own[k:] for k in range(5)))) or [tuple(own)]
                h = np.fromiter((xxhash.xxh64_intdigest(" ".join(w)) for w in windows), np.uint64, len(windows))
                words.append(sorted(set(own)))
                sizes.append(len(own))
                sketch.append([int((h * t).min().view(np.int64)) for t in turns])
            columns = [batch.column("doc_id"), batch.column("toxic"), pa.array(words, pa.list_(pa.string())), pa.array(sizes, pa.int64()), *(pa.array([s[k] for s in sketch], pa.int64()) for k in range(_SKETCHES))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "toxic", "words", "n_tokens", *(f"h{k}" for k in range(_SKETCHES))])

    marks = [f"h{k}" for k in range(_SKETCHES)]
    kind = dict(rows.dtypes)["doc_id"]
    out = rows.mapInArrow(run, f"doc_id {kind}, toxic int, words array<string>, n_tokens long, " + ", ".join(f"{h} long" for h in marks))
    for mark in marks:
        first = F.min(F.struct("doc_id", "words", "n_tokens", *(h for h in marks if h != mark))).alias("first")
        out = out.groupBy("toxic", mark).agg(first).select("toxic", mark, "first.*")
    return out.select("toxic", "words", "n_tokens")


def marked_words(rows: DataFrame) -> tuple[dict[str, float], float]:
    """Scores of the words that mark toxic or clean text, and the score of any other token."""
    thin = stored(_thinned(rows), "toxic-words")
    totals = {r.toxic: (r.docs, r.words) for r in thin.groupBy("toxic").agg(F.count("*").alias("docs"), F.sum(F.size("words")).alias("words")).collect()}
    (docs1, mass1), (docs0, mass0) = totals.get(1, (0, 0)), totals.get(0, (0, 0))
    if not mass1 or not mass0:
        discard(thin)
        return {}, math.log(1 - PASSAGE_SHARE)
    counts = thin.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("y1"), F.sum(1 - F.col("toxic")).alias("y0"))
    counts = counts.filter(F.col("y1") + F.col("y0") >= MIN_DOCS)
    prior = PRIOR * (F.col("y1") + F.col("y0"))
    a1, a0 = F.col("y1") + prior * (mass1 / (mass0 + mass1)) * 2, F.col("y0") + prior * (mass0 / (mass0 + mass1)) * 2
    odds = F.log(a1 / (F.lit(float(mass1)) - F.col("y1"))) - F.log(a0 / (F.lit(float(mass0)) - F.col("y0")))
    z = odds / F.sqrt(1 / a1 + 1 / a0)
    kept = counts.select("word", "y1", a0.alias("a0"), odds.alias("odds"), z.alias("z")).filter((F.abs("z") >= MIN_Z) & ((F.col("z") < 0) | (F.col("y1") >= MIN_DOCS)))
    kept = sorted(kept.collect())  # words of a bounded sample
    discard(thin)
    toxic = [r for r in kept if r.z > 0]
    total = sum(r.y1 for r in toxic)
    score = {r.word: math.log(PASSAGE_SHARE * r.y1 / total) - math.log(r.a0 / mass0) for r in toxic}
    score = {w: s for w, s in score.items() if s > 0}
    chance = min(0.5, sum(r.a0 for r in toxic) / mass0)
    other = math.log(1 - PASSAGE_SHARE) - math.log(1 - chance)
    return score | {r.word: min(r.odds, other) for r in kept if r.z < 0}, other


def decay(hits: list[tuple[float, int]], n_tokens: int, other: float) -> float:
    """The positive root of E[exp(rate * s)] = 1 over token scores: ``hits`` (score, how often)
    and ``other`` for the rest; 1 if no token scores above zero or the mean is not below."""
    rest = n_tokens - sum(n for _, n in hits)
    if not any(s > 0 and n for s, n in hits) or sum(s * n for s, n in hits) + other * rest >= 0:
        return 1.0
    excess = lambda rate: sum(n * math.expm1(min(700.0, rate * s)) for s, n in hits) + rest * math.expm1(rate * other)
    low, high = 0.0, 1.0
    while excess(high) < 0:
        low, high = high, 2 * high
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return high


def _calibrated(rows: DataFrame, score: dict[str, float], other: float) -> Model:
    """Extreme-value and logistic parameters from the same bounded set of labelled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, found, hits = [], [], []
            for text in batch.column("text").to_pylist():
                words = tokens(text)
                sizes.append(len(words))
                found.append([s for _, _, s in passages(words, score, other)])
                hits.append([s for w in words if (s := score.get(w)) is not None])
            lists = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(sizes, pa.int64()), pa.array(found, lists), pa.array(hits, lists)], names=["doc_id", "toxic", "n", "found", "hits"])

    kind = dict(rows.dtypes)["doc_id"]
    table = stored(rows.mapInArrow(run, f"doc_id {kind}, toxic int, n long, found array<double>, hits array<double>"), "toxic-passages")
    sample = table.orderBy("doc_id").drop("hits").collect()  # bounded by the rows per label
    often = table.filter("toxic = 0").select(F.explode("hits").alias("s")).groupBy("s").count().orderBy("s").collect()  # a row a word at most
    discard(table)
    length = sum(r.n for r in sample if not r.toxic)
    rate = decay([(r.s, r["count"]) for r in often], length, other)
    # A clean text of n tokens has K n exp(-rate S) segments over S by chance: K so that the clean
    # texts have the segments they have.
    clean = [s for r in sample if not r.toxic for s in r.found]
    typical = float(np.median([s for s in score.values() if s > 0])) if any(s > 0 for s in score.values()) else 1.0
    log_k = math.log((sum(s >= typical for s in clean) + 0.5) / max(length, 1)) + rate * typical
    x = np.array([statistic([(0, 0, s) for s in r.found], r.n, log_k, rate) for r in sample])
    y = np.array([float(r.toxic) for r in sample])
    slope, offset = _logistic(x, y)
    return Model(score, other, log_k, rate, slope, offset)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """A rising logistic curve by Newton steps with a small ridge; labels weigh alike."""
    if not len(x) or y.min() == y.max() or x.min() == x.max():
        return 1.0, -3.0
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    design, beta = np.stack([x, np.ones(len(x))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + np.array([1e-2 * beta[0], 0])
        hessian = (design * (weight * p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag([1e-2, 1e-9])
        step = np.linalg.solve(hessian, gradient)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 1e-6), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, rows_per_label: int = ROWS_PER_LABEL) -> Model:
    """A model from labelled documents that are not held out, about ``rows_per_label`` of each.

    Null ids, texts and labels teach nothing; an empty text has no words; very long texts count
    whole; of repeated ids one text is used; ties go by word and doc_id, so the layout of the
    tables changes nothing; empty tables give a model that finds nothing; other columns are
    ignored.
    """
    rows = stored(labelled(docs, labels, rows_per_label), "toxic-sample")
    return _calibrated(rows, *marked_words(rows))


def probability(model: Model, stat: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * stat + model.offset))))


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, score, predicted and passages (token start, end, score; significant ones).

    Every row has a score: null and empty texts that of a text without any marked word. Texts of
    any length are read whole; equal texts score alike; repeated rows repeat; an empty table
    gives no rows; other columns are ignored whatever their names.
    """
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    kinds = dict(rows.dtypes)
    floor = -math.log(SIGNIFICANT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score, spans = [], []
            for text in batch.column(len(keep)).to_pylist():
                words = tokens(text)
                found = passages(words, model.score, model.other)
                score.append(probability(model, statistic(found, len(words), model.log_k, model.rate)))
                log_n = math.log(max(len(words), 1))
                spans.append([{"start": a, "end": b, "score": s} for a, b, s in found if model.rate * s - model.log_k - log_n >= floor])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32()), pa.array(spans, kind)], names=[*keep, "score", "predicted", "passages"])

    return rows.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", score double, predicted int, passages array<struct<start: int, end: int, score: double>>")
