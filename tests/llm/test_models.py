"""Language, toxicity, quality, sharding, and the pipeline that joins them."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import langid, packing, pii, quality, queries, sharding, toxicity


@pytest.fixture(scope="session")
def medium() -> str:
    return "/root/testdata/sf0.01"


def _held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


# Language


def test_language_of_held_out_documents(spark, medium):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "lang").collect()}
    found = queries.op5_naive_bayes_language(spark, medium).collect()
    assert len(found) == len(langs) and all(r.held_out == _held(r.doc_id) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_of_hard_rows(spark, documents, hard, nothing):
    model = langid.fit(documents)
    rows = langid.predict(hard, model).collect()
    assert len(rows) == hard.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (1, 2, 3, 10))
    assert langid.identified(nothing).count() == 0
    unlabelled = hard.withColumn("lang", hard["lang"].substr(1, 0).cast("int").cast("string"))
    assert {r.lang_pred for r in langid.predict(unlabelled, ([], np.zeros((langid.BUCKETS, 0), np.float32))).collect()} == {"und"}


def test_windows_cover_the_whole_text(monkeypatch):
    text = "the quick brown fox jumps over das faule Tier " * 50
    whole = Counter(langid.buckets_of(langid._points(text)).tolist())
    monkeypatch.setattr(langid, "_WINDOW", 97)
    cut = Counter()
    for cells in langid._windows(langid._points(text)):
        cut.update(cells.tolist())
    assert cut == whole


def test_batches_equal_naive_bayes_by_hand(monkeypatch):
    """The sparse product against a plain sum over the n-grams of each text, also in windows."""
    monkeypatch.setattr(langid, "_TOGETHER", 3)
    rng = np.random.default_rng(8)
    weights = rng.normal(size=(langid.BUCKETS, 3)).astype(np.float32)
    texts = ["the quick brown fox", "", "über  den Fluß!", "x" * 500, "日本語 text", "ab " * 90, "1 2 3"]
    for window in (1 << 20, 50):
        monkeypatch.setattr(langid, "_WINDOW", window)
        total, grams = langid.totals_of(texts, weights)
        for t, row, n in zip(texts, total, grams):
            cells = langid.buckets_of(langid._points(t))
            assert n == len(cells)
            assert np.allclose(row, sum((weights[c].astype(float) for c in cells), np.zeros(3)), atol=1e-6)


def test_fit_equals_counts_by_hand(spark, monkeypatch):
    """Log-probabilities from plain counts; of too many languages the largest are learned."""
    rows = [(k, lang, text) for k, (lang, text) in enumerate([("aa", "one two"), ("bb", "zwei drei"), ("aa", "three"), ("cc", "quatre"), ("bb", "vier"), ("aa", "five"), ("bb", "acht")] * 3)]
    table = spark.createDataFrame([r for r in rows if not _held(r[0])], "doc_id long, lang string, text string")
    languages, logs = langid.fit(table)
    assert languages == ["aa", "bb", "cc"]
    for k, lang in enumerate(languages):
        counts = np.full(langid.BUCKETS, 0.2)
        for r in table.collect():
            if r.lang == lang:
                np.add.at(counts, langid.buckets_of(langid._points(r.text)), 1)
        assert np.allclose(logs[:, k], np.log(counts / counts.sum()), atol=1e-5)
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    assert langid.fit(table)[0] == ["aa", "bb"]


# Toxicity


def _plain_segments(scores):
    """The definition: take the best segment, then what lies on both sides."""
    best = None
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            s = sum(scores[a:b])
            if s > 0 and (best is None or s > best[2]):
                best = (a, b, s)
    if best is None:
        return []
    a, b, _ = best
    return _plain_segments(scores[:a]) + [best] + [(x + b, y + b, s) for x, y, s in _plain_segments(scores[b:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-64, 64), max_size=14).map(lambda x: [v + 2.0 ** -(k + 8) for k, v in enumerate(x)]))
def test_segments_equal_the_definition(scores):
    # The scores are dyadic, so all sums are exact, and no two segments are equal.
    assert toxicity.segments(scores) == _plain_segments(scores)


def test_toxicity_of_held_out_documents(spark):
    """At the largest of the small scales: the others hold out half a dozen toxic documents."""
    large = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{large}/labels.parquet").collect()}
    found = queries.op6_toxic_segments(spark, large).collect()
    assert all(r.held_out == _held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    held = [(labels[r.doc_id], r.predicted) for r in found if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) >= 0.98 * len(held)
    assert sum(y for y, p in held if p) >= 0.95 * sum(p for _, p in held)
    assert sum(p for y, p in held if y) >= 0.85 * sum(y for y, _ in held)


def test_decay_solves_its_equation():
    hits, n, other = [(2.0, 30), (-1.5, 100), (0.7, 12)], 5000, -0.05
    rate = toxicity.decay(hits, n, other)
    total = sum(k * np.exp(rate * s) for s, k in hits) + (n - 142) * np.exp(rate * other)
    assert rate > 0 and abs(total / n - 1) < 1e-9
    assert toxicity.decay([], n, other) == 1.0 and toxicity.decay([(-1.0, 4)], n, other) == 1.0


def test_model_does_not_depend_on_the_layout(spark, documents, small):
    """Repeated ids, copies of texts, and another order and number of partitions: the same model."""
    labels = spark.read.parquet(f"{small}/labels.parquet")
    again = documents.union(documents.filter("doc_id % 3 = 0"))
    one, other = (toxicity.fit(t, labels) for t in (again.coalesce(1), again.repartition(7, "text")))
    assert one == other and one.rate > 0


def test_words_score_as_by_hand(spark):
    """Log-odds with the Dirichlet prior and their z, from plain counts of documents."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(300):
        toxic = int(k % 3 == 0)
        words = [f"w{''.join(chr(97 + int(c)) for c in str(int(v)))}" for v in rng.integers(0, 400, 30)]
        words += ["vile"] * (toxic and rng.random() < 0.8) + ["kind"] * (not toxic and rng.random() < 0.8)
        rows.append((k, toxic, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id long, toxic int, text string")
    score, other = toxicity.marked_words(table)
    sets = [(t, set(toxicity.tokens(x))) for _, t, x in rows]
    mass = [sum(len(w) for t, w in sets if t == y) for y in (0, 1)]
    for word in {w for _, s in sets for w in s}:
        y = [sum(word in s for t, s in sets if t == k) for k in (0, 1)]
        a = [y[k] + toxicity.PRIOR * sum(y) * 2 * mass[k] / sum(mass) for k in (0, 1)]
        odds = np.log(a[1] / (mass[1] - y[1])) - np.log(a[0] / (mass[0] - y[0]))
        z = odds / np.sqrt(1 / a[0] + 1 / a[1])
        marked = sum(y) >= toxicity.MIN_DOCS and abs(z) >= toxicity.MIN_Z and (z < 0 or y[1] >= toxicity.MIN_DOCS)
        if abs(abs(z) - toxicity.MIN_Z) > 1e-6:
            assert (word in score) == marked
        if marked and z < 0:
            assert abs(score[word] - min(odds, other)) < 1e-9
    assert score["vile"] > 0 > score["kind"]


def test_toxicity_of_hard_rows(spark, documents, hard, nothing, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    model = toxicity.fit(documents, labels)
    rows = toxicity.scored(hard, model).collect()
    assert len(rows) == hard.count() and all(r.predicted == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert toxicity.scored(nothing, model).count() == 0
    blank = toxicity.fit(nothing, labels.filter("false"))
    assert toxicity.scored(hard, blank).count() == hard.count()


# Quality


def plain_counts(text):
    words = [w for w in "".join(" " if c in " \t\n\r\v\f" else c for c in text or "").split(" ") if w]
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    hit = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\v\f")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_query(spark, medium):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{medium}/labels.parquet").collect()}
    found = queries.op7_robust_outliers(spark, medium).collect()
    assert len(found) == len(texts)
    for r in found:
        n = plain_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.kept and r.base_failed)
    judged = [(labels[r.doc_id], r.kept) for r in found if r.doc_id in labels and not r.base_failed]
    assert sum(k for q, k in judged if q) >= 0.99 * sum(q for q, _ in judged)
    assert sum(not k for q, k in judged if not q) >= 0.8 * sum(not q for q, _ in judged)


def test_quality_of_hard_rows(hard, nothing):
    rows = quality.judged(hard).collect()
    assert len(rows) == hard.count()
    assert all(r.base_failed and not r.kept for r in rows if r.doc_id in (1, 2, 3))
    assert quality.judged(nothing).count() == 0


def test_estimate_ignores_outliers(spark):
    """A third of the rows far away don't move centre and scatter much."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, quality.DIMS)) * 0.5
    x[:700] += 9
    rows = [("g", "l", *map(float, v)) for v in x]
    schema = "key_group string, key_lang string, " + ", ".join(f"x{i} double" for i in range(quality.DIMS))
    fit = next(r for r in quality.robust_fits(spark.createDataFrame(rows, schema)).collect() if r.key == "g")
    assert all(abs(fit[f"m{i}"]) < 0.1 for i in range(quality.DIMS))
    assert all(1 / 0.75 < fit[f"w{i}{i}"] < 1 / 0.4 for i in range(quality.DIMS))


def _fast_mcd(x, share, starts=60, seed=3):
    """Centre and scatter of the subset of least determinant, by concentration from random starts."""
    rng, h, best = np.random.default_rng(seed), int(np.ceil(share * len(x))), None
    for _ in range(starts):
        own = x[rng.choice(len(x), quality.DIMS + 2, replace=False)]
        for _ in range(40):
            d = x - own.mean(0)
            own = x[np.argsort(np.einsum("ij,jk,ik->i", d, np.linalg.pinv(np.cov(own.T)), d))[:h]]
        det = np.linalg.det(np.cov(own.T))
        if best is None or det < best[0]:
            best = det, own
    return best[1].mean(0), np.cov(best[1].T)


@pytest.mark.parametrize("shift", [0.0, 3.0])
def test_estimate_is_near_the_exact_one(spark, shift):
    """Correlated statistics with a fifth of outliers, some of which no single statistic shows."""
    rng = np.random.default_rng(5)
    root = rng.normal(size=(quality.DIMS, quality.DIMS)) * 0.4 + np.eye(quality.DIMS)
    x = rng.normal(size=(2000, quality.DIMS)) @ root.T
    x[:400] = rng.normal(size=(400, quality.DIMS)) * 0.3 + shift * np.resize([1, -1], quality.DIMS)
    rows = [("g", "l", *map(float, v)) for v in x]
    schema = "key_group string, key_lang string, " + ", ".join(f"x{i} double" for i in range(quality.DIMS))
    fit = next(r for r in quality.robust_fits(spark.createDataFrame(rows, schema), steps=12).collect() if r.key == "g")
    centre = np.array([fit[f"m{i}"] for i in range(quality.DIMS)])
    w = np.zeros((quality.DIMS, quality.DIMS))
    for i, j in quality._PAIRS:
        w[i, j] = fit[f"w{i}{j}"]
    scatter = np.linalg.inv(w.T @ w) - np.diag(np.square(quality.FLOOR))
    mean, cov = _fast_mcd(x, quality.SHARE)
    assert np.abs(centre - mean).max() < 0.1
    # Both hold three quarters of the rows; binning by distance moves the border a little.
    assert abs(np.linalg.slogdet(scatter / quality._consistency(quality.SHARE))[1] - np.linalg.slogdet(cov)[1]) < 0.35


def test_repeated_short_lines_are_outliers(spark, small):
    """Documents of 60 to 75 % repeated lines that pass the base rules lie far out."""
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abdeghilmnoprstu"), int(rng.integers(3, 9))))
    rows = []
    for k in range(400):
        lines = [" ".join(word() for _ in range(9)) + "." for _ in range(20)]
        if k < 12:
            share = 0.6 + 0.15 * k / 12
            again = int(20 * share / (1 - share)) + 1
            lines += [f"{word()} {word()}"] * again
        rows.append((k, "\n".join(lines), "en", "s"))
    found = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(found[k].kept for k in range(12)) and not all(found[k].base_failed for k in range(12))
    assert sum(found[k].kept for k in range(12, 400)) >= 0.99 * 388


# Sharding


def test_sharding_query(spark, small, documents):
    texts = {r.doc_id: r.text.encode() for r in documents.collect()}
    rows = queries.op8_virtual_slots(spark, small).collect()
    assert len(rows) == len(texts)
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]))
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= max(r.size for r in rows)


def test_sharding_of_hard_rows(hard, nothing):
    assert sharding.shard_documents(hard).count() == hard.count()
    assert sharding.shard_documents(nothing).count() == 0


def test_copies_of_a_row_are_spread(spark):
    """Twenty thousand copies of one row and some others: shards stay near equal, places gapless."""
    from pyspark.sql import functions as F

    one = spark.range(0, 20_000, 1, 4).select(F.lit(7).cast("long").alias("doc_id"), F.lit("word " * 120).alias("text"))
    others = spark.range(100, 3100).select(F.col("id").alias("doc_id"), F.expr("repeat('ab ', cast(id % 50 as int))").alias("text"))
    rows = sharding.shard_documents(one.union(others).union(spark.createDataFrame([(None, None)] * 40, "doc_id long, text string"))).collect()
    assert len(rows) == 23_040
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert max(sizes.values()) <= 1.02 * min(sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_edited_maps_move_little():
    rng = np.random.default_rng(2)
    sizes = {k: int(v) for k, v in enumerate(rng.integers(1, 1000, 4000))}
    before = sharding.assign(sizes, 8)
    after = sharding.assign(sizes, 9, before)
    moved = sum(sizes[k] for k in sizes if before[k] != after[k])
    assert moved <= 1.1 * sum(sizes.values()) / 9
    load = Counter()
    for k, s in after.items():
        load[s] += sizes[k]
    assert max(load.values()) <= 1.02 * min(load.values())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_parts_equal_sql(spark, small, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    found = queries.queries()[name](spark, small)
    listed = ", ".join(sorted(found.columns))
    assert sorted(map(tuple, found.select(*sorted(found.columns)).collect())) == sorted(c.sql(f"SELECT {listed} FROM ({queries.oracle_sql()[name]})").fetchall())


# Pipeline


def test_pipeline(spark, small, documents):
    import corpus_pipeline

    numbers = [n for _, n in (("quality", 7), ("language", 5), ("near_duplicates", 1), ("personal_data", 2), ("packing", 9))]
    assert len(corpus_pipeline.STAGES) == len(numbers)
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == documents.columns and out.count() <= docs.count()
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert not any(pii.base_spans(r.text) for r in docs.collect())
    packed = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    assert sum(r.length for r in packed) == sum(n.n for n in packing.pieces(docs, queries.tokenizer_file("word_bpe_49k.json"), 0, 2048).selectExpr("sum(length) n").collect())


def test_stages_equal_brute_force(spark, small, documents):
    """What each filtering stage keeps of its own input, worked out row by row."""
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r for r in documents.collect()}
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    base = {k for k, r in rows.items() if (n := plain_counts(r.text))[0] >= 50 and 100 * n[4] <= 50 * n[0]}
    kept = ids(stage["quality"](spark, documents, small))
    assert kept <= base and kept == {r.doc_id for r in quality.judged(documents).filter("kept").collect()}
    languages, logs = langid.fit(documents)
    wanted = set()
    for k, r in rows.items():
        cells = langid.buckets_of(langid._points(r.text))
        if any(c.isalpha() for c in r.text) and langid.posterior(np.sum(logs[cells].astype(float), axis=0), len(cells))[1] >= 0.5:
            wanted.add(k)
    assert ids(stage["language"](spark, documents, small)) == wanted
    sets = {}
    for k, r in rows.items():
        w = [x for x in "".join(" " if c in " \t\n\r\v\f" else c.lower() if c.isascii() else c for c in r.text).split(" ") if x]
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    root = {k: k for k in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in rows:
        for b in rows:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                root[max(find(a), find(b))] = min(find(a), find(b))
    gone = set(rows) - ids(stage["near_duplicates"](spark, documents, small))
    same = {k for k in rows if find(k) != k}
    assert gone <= same and len(gone) >= 0.95 * len(same)
    clean = {r.doc_id: r.text for r in stage["personal_data"](spark, documents, small).collect()}
    assert set(clean) == set(rows) and all(clean[k] == r.text for k, r in rows.items() if not pii.base_spans(r.text) and not pii.candidates(r.text, []))


def test_pipeline_of_hard_rows(spark, hard, nothing, small):
    import corpus_pipeline

    for table in (hard, nothing):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, small)
            assert docs.columns == hard.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, small).count()
