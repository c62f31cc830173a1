"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts become arrays of code points; n-grams of one to ``MAX_GRAM`` lower-case letters hash into
``BUCKETS`` cells with array operations. Fitting sums cell counts per language in Spark. The
model, a matrix of log-probabilities whose size is fixed by BUCKETS and ``MAX_LANGUAGES``, goes
to the tasks, and a batch of texts is scored as one product of a sparse matrix (how often each
cell occurs in each text) and the model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, hinted, slices, stored

BUCKETS = 1 << 15
MAX_GRAM = 3
MAX_LANGUAGES = 256
#: The fit reads about this many documents of each language, drawn by a hash of text and id.
ROWS_PER_LANGUAGE = 4000
#: Code points that are scored at a time: several texts, or a part of a very long one.
_WINDOW = 1 << 20
#: Texts in one sparse matrix.
_TOGETHER = 32
#: Evidence beyond so many n-grams does not make a language more certain.
EVIDENCE = 200
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_DRAWS = 1_000_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _points(text: str) -> np.ndarray:
    """Lower-case code points; everything but letters is one separator, runs are one."""
    raw = np.frombuffer(f" {text} ".lower().encode("utf-32-le", "replace"), np.uint32)
    ascii_other = (raw < 128) & ~((raw >= 97) & (raw <= 122))
    gap = ascii_other | ((raw >= 0x80) & (raw < 0xC0)) | ((raw >= 0x2000) & (raw < 0x2070))
    points = np.where(gap, np.uint32(32), raw)
    return points[~(gap & np.concatenate([[False], gap[:-1]]))]


def buckets_of(points: np.ndarray, starts: int | None = None) -> np.ndarray:
    """Cells of all n-grams that begin in the first ``starts`` places; those that are a separator
    alone are left out."""
    x, out = points.astype(np.uint64), []
    h = np.zeros(len(x), np.uint64)
    for n in range(1, MAX_GRAM + 1):
        if len(x) < n:
            break
        h = (h[: len(x) - n + 1] + x[n - 1 :] + np.uint64(1)) * _MIX[n & 1]
        h ^= h >> np.uint64(29)
        cell = (h * _MIX[0]) >> np.uint64(64 - BUCKETS.bit_length() + 1)
        out.append((cell[x != 32] if n == 1 else cell) if starts is None else cell[:starts][x[: min(starts, len(cell))] != 32] if n == 1 else cell[:starts])
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def _windows(points: np.ndarray) -> Iterator[np.ndarray]:
    """Cells of a text of any length, some at a time; every n-gram counts in the window where it
    begins."""
    for at in range(0, max(len(points), 1), _WINDOW):
        yield buckets_of(points[at : at + _WINDOW + MAX_GRAM - 1], _WINDOW)


def product(rows: np.ndarray, cells: np.ndarray, n_rows: int, weights: np.ndarray) -> np.ndarray:
    """A sparse matrix, given by the row and cell of each of its counts of one, times ``weights``."""
    often = np.bincount(rows * BUCKETS + cells, minlength=n_rows * BUCKETS)
    (pair,) = np.nonzero(often)
    row, cell = np.divmod(pair, BUCKETS)
    out = np.zeros((n_rows, weights.shape[1]))
    if len(row):
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[row[first]] = np.add.reduceat(often[pair, None] * weights[cell].astype(np.float64), first)
    return out


def totals_of(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods of texts (rows) under languages (columns), and their numbers of n-grams."""
    total, grams = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts), np.int64)
    for at in range(0, len(texts), _TOGETHER):
        rows: list[np.ndarray] = []
        cells: list[np.ndarray] = []
        held = 0
        some = texts[at : at + _TOGETHER]
        for k, text in enumerate(some):
            for part in _windows(_points(text)):
                rows.append(np.full(len(part), k, np.int64))
                cells.append(part)
                grams[at + k] += len(part)
                held += len(part)
                if held >= _WINDOW:
                    total[at : at + len(some)] += product(np.concatenate(rows), np.concatenate(cells), len(some), weights)
                    rows, cells, held = [], [], 0
        if held:
            total[at : at + len(some)] += product(np.concatenate(rows), np.concatenate(cells), len(some), weights)
    return total, grams


def training_rows(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """text and lang of documents that may be learned from: not held out, both known.

    Beyond ``MAX_LANGUAGES`` the languages with most such documents are learned, of equals those
    that come first by name.
    """
    known = docs.filter(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(_DRAWS)).alias("draw"))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES)
    share = stored(counts.select("lang", (F.lit(float(rows_per_language)) / F.col("count") * _DRAWS).alias("upto")), "language-shares")
    # Few rows, so that texts are not dealt out by language.
    return known.join(hinted(share, MAX_LANGUAGES), "lang").filter("draw < upto").select("lang", "text")


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, prior: float = 0.2) -> tuple[list[str], np.ndarray]:
    """Languages in order and the matrix of log-probabilities, BUCKETS x languages.

    Null texts, languages and ids teach nothing, an empty text nothing either; very long texts
    count whole; repeated rows count as often as they are drawn; without any row to learn from
    there are no languages; at most MAX_LANGUAGES are learned. Each language weighs the same;
    other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                own = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for cells in _windows(_points(text)):
                    own += np.bincount(cells, minlength=BUCKETS)
        for lang, own in sums.items():
            (cell,) = np.nonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cell), pa.string()), pa.array(cell.astype(np.int32)), pa.array(own[cell])], names=["lang", "cell", "n"])

    partial = training_rows(docs, rows_per_language).mapInArrow(count, "lang string, cell int, n long")
    sums = stored(partial.groupBy("lang", "cell").agg(F.sum("n").alias("n")), "language-counts")
    languages = sorted(r.lang for r in sums.select("lang").distinct().collect())
    counts = np.full((BUCKETS, len(languages)), prior)
    # At most BUCKETS x MAX_LANGUAGES small rows, whatever the corpus.
    found = sums.toArrow()
    place = {lang: k for k, lang in enumerate(languages)}
    column = np.array([place[x] for x in found.column("lang").to_pylist()], np.int64)
    np.add.at(counts, (found.column("cell").to_numpy().astype(np.int64), column), found.column("n").to_numpy())
    return languages, np.log(counts / counts.sum(0)).astype(np.float32)


def posterior(total: np.ndarray, grams: int) -> tuple[int, float]:
    """Best language and its probability; long texts count as EVIDENCE n-grams."""
    tempered = total * (min(grams, EVIDENCE) / max(grams, 1))
    odds = np.exp(tempered - tempered.max())
    best = int(np.argmax(total))
    return best, float(odds[best] / odds.sum())


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and score for each row, from the whole text alone.

    Null and empty texts and texts without a letter are ``und`` with score 0, and so is
    everything if there was nothing to learn from. Texts of any length are read whole; of
    languages that tie the first by name is taken; repeated rows repeat; an empty table gives no
    rows; other columns are ignored whatever their names.
    """
    languages, logs = model
    held = docs.sparkSession.sparkContext.broadcast(logs)
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = held.value
        for batch in slices(batches):
            texts = batch.column(len(keep)).to_pylist()
            guess, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            known = [k for k, t in enumerate(texts) if t and languages and _LETTER.search(t)]
            total, grams = totals_of([texts[k] for k in known], weights)
            for k, own, n in zip(known, total, grams.tolist()):
                best, score[k] = posterior(own, n)
                guess[k] = languages[best]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(guess, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    return rows.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", lang_pred string, score double")


def identified(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    return predict(docs, fit(docs, rows_per_language), keep)


def accepted(min_score: float = 0.5) -> Column:
    """What the pipeline keeps: a known language with more than even odds."""
    return (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)
