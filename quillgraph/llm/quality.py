"""Quality rules: robust multivariate outliers of text statistics per language and source.

Every document becomes a short vector of transformed statistics. For each (language, source),
each language and the whole corpus a minimum-covariance-determinant estimate is reached by
concentration steps from three starts: take the share of documents that lie nearest,
re-estimate centre and scatter from them, repeat; the start that ends with the least
determinant wins. One step is one aggregation of the vectors' moments by distance bin, so the
share is cut from at most ``BINS`` partial sums a group and no group meets in one task.
Documents whose Mahalanobis distance exceeds a chi-square quantile are rejected.

Groups with fewer than ``MIN_ROWS`` documents past the base rules are judged by their
language's estimate, small languages by that of the corpus, whatever the size of the corpus.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, hinted, slices, stored

DIMS = 6
#: Distances are binned by eighths of an octave.
BINS, BINS_AN_OCTAVE = 160, 8
#: Share of a group that its estimate rests on, and the concentration steps.
SHARE, STEPS = 0.75, 4
#: Groups with fewer rows are judged by their language, small languages by the corpus.
MIN_ROWS = 200
#: Estimates that may be broadcast (of some 250 bytes); more are joined by a shuffle.
MOST_BROADCAST = 20_000
#: Least scatter of a transformed statistic: below this differences are not worth a rejection.
FLOOR = (0.06, 0.05, 0.20, 0.15, 0.05, 0.05)
#: 30 is near the chi-square quantile of 1 - 4e-5 with six degrees of freedom.
MAX_DISTANCE = 30.0
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[192:] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b"!\"'()+,-./:;=?@[\\]^_`{}~")] = True


def _repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    hit = np.zeros(len(words) + 2, bool)
    at = np.flatnonzero(np.fromiter((counts[w] > 1 for w in windows), bool, len(windows)))
    hit[at] = hit[at + 1] = hit[at + 2] = True
    return int(hit.sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then lines with a word,
    capitals, letters (of the bytes) and punctuation. A null text has none of anything."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    blank = int(seen[32] + seen[9:14].sum())
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    return (
        len(words), len(text) - blank, int(seen[_SYMBOLS].sum()), len(lines) - len(set(lines)), _repeat_words(words),
        len(lines), int(seen[_UPPER].sum()), int(seen[_LETTER].sum()), int(seen[_PUNCT].sum()),
    )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters", "n_punctuation")


def counted(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keep`` columns and the counts of each whole text, one row for each row."""
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([text_counts(t) for t in batch.column(len(keep)).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *map(pa.array, found.T.copy())], names=[*keep, *COUNTS])

    return rows.mapInArrow(run, ", ".join([f"`{k}` {kinds[k]}" for k in keep] + [f"{c} long" for c in COUNTS]))


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics: log of the mean word length, and arcsine roots of shares."""
    share = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(a) / F.greatest(F.col(b), F.lit(1)))))
    return [
        F.log((F.col("word_chars") + 1) / (F.col("n_words") + 1)),
        share("n_symbols", "word_chars"),
        share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"),
        share("n_capitals", "n_letters"),
        share("n_punctuation", "word_chars"),
    ]


_PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]
_ROOT = ", ".join(f"w{i}{j} double" for i, j in _PAIRS)
_FIT = "key string, start int, logdet double, " + ", ".join(f"m{i} double" for i in range(DIMS)) + ", " + _ROOT


def _whitened(i: int) -> Column:
    return sum((F.col(f"w{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0))


def _distance() -> Column:
    """Squared Mahalanobis distance from the fit in the row: the norm of a whitened vector."""
    parts = [_whitened(i) * _whitened(i) for i in range(DIMS)]
    return sum(parts[1:], parts[0])


def _consistency(share: float) -> float:
    """What the scatter of the nearest ``share`` of normal vectors lacks: share / P(chi2(p + 2) <= q)."""
    cdf = lambda x, p: 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))
    lo, hi = 0.0, 200.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid, DIMS) < share else (lo, mid)
    return share / cdf(lo, DIMS + 2)


def _row(key: str, start: int, mean: np.ndarray, scatter: np.ndarray) -> list:
    scatter = scatter + np.diag(np.square(FLOOR))
    root = np.linalg.inv(np.linalg.cholesky(scatter))
    return [key, start, float(np.linalg.slogdet(scatter)[1]), *mean, *(root[i, j] for i, j in _PAIRS)]


def _moments(part: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scatter from sums."""
    mean, scatter = np.array([part[f"s{i}"] for i in range(DIMS)]) / part["n"], np.zeros((DIMS, DIMS))
    for i, j in _PAIRS:
        scatter[i, j] = scatter[j, i] = part[f"q{i}{j}"] / part["n"] - mean[i] * mean[j]
    return mean, scatter


def _starts(key: tuple, sums: pd.DataFrame) -> pd.DataFrame:
    """Three starts of a group: median and quartile range of each statistic, the same with the
    correlations of squashed statistics, and mean and scatter of all rows."""
    part = sums.iloc[0]
    middle = np.array([part[f"m{i}"] for i in range(DIMS)])
    spread = np.array([1 / part[f"w{i}{i}"] for i in range(DIMS)])
    squashed = np.eye(DIMS)
    for i, j in _PAIRS:
        squashed[i, j] = squashed[j, i] = part[f"t{i}{j}"] / part["n"]
    scale = np.sqrt(np.maximum(np.diag(squashed), 1e-12))
    correlation = squashed / np.outer(scale, scale)
    mean, scatter = _moments(part)
    values, axes = np.linalg.eigh(correlation)
    correlation = axes * np.maximum(values, 1e-3) @ axes.T
    rows = [_row(part["key"], 0, middle, np.diag(spread**2)), _row(part["key"], 1, middle, correlation * np.outer(spread, spread)), _row(part["key"], 2, mean, scatter)]
    return pd.DataFrame(rows)


def _fit(share: float):
    """From a group's moments by distance bin to centre and inverse root of its scatter."""
    factor = _consistency(share)

    def fit(key: tuple, bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values("bin")
        total = bins["n"].cumsum().to_numpy()
        upto = int(np.searchsorted(total, share * total[-1])) + 1
        mean, scatter = _moments(bins.iloc[:upto].sum(numeric_only=True))
        return pd.DataFrame([_row(key[0], key[1], mean, factor * scatter)])

    return fit


def _keyed(stats: DataFrame) -> DataFrame:
    """A row for each level that a document takes part in: its group, its language, the corpus."""
    return stats.withColumn("key", F.explode(F.array("key_group", "key_lang", F.lit("all"))))


def robust_fits(stats: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """The estimate of least determinant for every key with at least ``MIN_ROWS`` rows, and for
    the corpus. ``stats``: key_group, key_lang and x0 ...
    """
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(DIMS)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in _PAIRS]
    quartiles = [F.percentile_approx(f"x{i}", F.lit([0.25, 0.5, 0.75]), F.lit(2000)).alias(f"p{i}") for i in range(DIMS)]
    rows = _keyed(stats)
    start = rows.groupBy("key").agg(F.count("*").alias("rows"), *quartiles).filter((F.col("rows") >= MIN_ROWS) | (F.col("key") == "all"))
    spread = lambda i: F.sqrt(F.pow((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349, 2) + FLOOR[i] ** 2)
    middles = stored(start.select("key", *[F.col(f"p{i}")[1].alias(f"m{i}") for i in range(DIMS)], *[(1 / spread(i)).alias(f"w{i}{i}") for i in range(DIMS)]), "quality-fits")
    squash = [F.tanh((F.col(f"x{i}") - F.col(f"m{i}")) * F.col(f"w{i}{i}")) for i in range(DIMS)]
    about = [F.sum(squash[i] * squash[j]).alias(f"t{i}{j}") for i, j in _PAIRS]
    first = rows.join(hinted(middles, MOST_BROADCAST), "key").groupBy("key").agg(F.count("*").cast("double").alias("n"), *sums, *about)
    fits = stored(first.join(hinted(middles, MOST_BROADCAST), "key").groupBy("key").applyInPandas(_starts, _FIT), "quality-fits")
    discard(middles)
    for _ in range(steps):
        at = F.floor(BINS_AN_OCTAVE * F.log2(_distance() + 2.0**-10)).cast("int") + 10 * BINS_AN_OCTAVE
        binned = rows.join(hinted(fits, MOST_BROADCAST), "key").withColumn("bin", F.least(at, F.lit(BINS)))
        moments = binned.groupBy("key", "start", "bin").agg(F.count("*").cast("double").alias("n"), *sums)
        before, fits = fits, stored(moments.groupBy("key", "start").applyInPandas(_fit(share), _FIT), "quality-fits")
        discard(before)
    best = fits.groupBy("key").agg(F.min(F.struct("logdet", "start")).alias("best")).select("key", "best.start")
    out = stored(fits.join(best, ["key", "start"]).select(*fits.columns), "quality-fits")
    discard(fits)
    return out


def _statistics(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns (lang and source among them), counts, base_failed, keys and vector."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    return counted(docs, keep).withColumns({
        "base_failed": base_failed(),
        "key_lang": F.concat(F.lit("lang:"), name("lang")),
        "key_group": F.concat(F.lit("group:"), name("lang"), F.lit("\1"), name("source")),
        **{f"x{i}": v for i, v in enumerate(vector())},
    })


_XS = [f"x{i}" for i in range(DIMS)]


def _judged(stats: DataFrame, fits: DataFrame, keep: tuple[str, ...], max_distance: float) -> DataFrame:
    # The narrowest level that has an estimate.
    level = lambda c, flag: hinted(fits.select(F.col("key").alias(c), F.lit(True).alias(flag)), MOST_BROADCAST)
    out = stats.join(level("key_group", "has_group"), "key_group", "left").join(level("key_lang", "has_lang"), "key_lang", "left")
    key = F.when(F.col("has_group"), F.col("key_group")).when(F.col("has_lang"), F.col("key_lang")).otherwise("all")
    out = out.withColumn("key", key).join(hinted(fits, MOST_BROADCAST), "key", "left").withColumn("distance", F.coalesce(_distance(), F.lit(0.0)))
    return out.select(*keep, *COUNTS, "base_failed", "distance", (~F.col("base_failed") & (F.col("distance") <= max_distance)).alias("kept"))


def judged(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source"), max_distance: float = MAX_DISTANCE) -> DataFrame:
    """``keep`` columns, the counts, base_failed, distance and kept.

    Null languages and sources are groups of their own. Null and empty texts fail the base
    rules. Texts of any length are read whole. Repeated rows and ties are judged alike; an empty
    table gives no rows. Columns other than ``keep`` and text are ignored. Base failures take
    part in no estimate, they are rejected anyway.
    """
    stats = stored(_statistics(docs, keep), "quality-stats")
    fits = robust_fits(stats.filter("not base_failed").select("key_group", "key_lang", *_XS))
    return _judged(stats, fits, keep, max_distance)


def filtered(docs: DataFrame, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, whole and with all their columns.

    The counts are taken twice, once for the estimates and once for the verdicts, so that no
    text is written.
    """
    stats = stored(_statistics(docs.select("lang", "source", "text"), ("lang", "source")).filter("not base_failed").select("key_group", "key_lang", *_XS), "quality-stats")
    fits = robust_fits(stats)
    discard(stats)
    whole = docs.select(F.struct(*docs.columns).alias("__doc"), "lang", "source", "text")
    keep = ("__doc", "lang", "source")
    return _judged(_statistics(whole, keep), fits, keep, max_distance).filter("kept").select("__doc.*")
