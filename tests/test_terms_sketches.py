"""Collocations against plain counts, sketches against exact frequencies, and the timer."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quillgraph.operators import retrieval, sketches, terms
from quillgraph.plans.views import Graph
from quillgraph.sources.tables import materialized


def plain_terms(rows, least, value, letters, documents):
    """(document, text) rows to term: (times, frequency, likelihood, value)."""
    times, where, total = Counter(), defaultdict(set), 0
    for d, text in rows:
        w = re.findall(r"[^\W_]+", text.lower())
        total += len(w)
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                gram = tuple(w[i : i + n])
                times[gram] += 1
                where[gram].add(d)
    x = lambda k: k * math.log(k) if k > 0 else 0.0
    firm = {}
    for gram in [g for g in times if len(g) > 1 and len(where[g]) >= documents and min(map(len, g)) >= letters]:
        llr = []
        for at in range(1, len(gram)):
            k, a, b = times[gram], times[gram[:at]], times[gram[at:]]
            own = 2 * (x(k) + x(a - k) + x(b - k) + x(total - a - b + k) - x(a) - x(total - a) - x(b) - x(total - b) + x(total))
            llr.append(own if k * total > a * b else 0.0)
        if min(llr) >= least:
            firm[gram] = min(llr)
    out = {}
    for gram, llr in firm.items():
        around = [times[g] for g in firm if len(g) == 3 and len(gram) == 2 and gram in (g[:2], g[1:])]
        c = math.log2(len(gram)) * (times[gram] - (sum(around) / len(around) if around else 0))
        if c >= value:
            out[" ".join(gram)] = (times[gram], len(where[gram]), llr, c)
    return out, total


def test_terms_equal_plain_counts(spark):
    rnd = random.Random(8)
    filler = ["alpha", "beta", "gamma", "delta", "of", "in", "epsilon", "zeta"]
    rows = []
    for k in range(60):
        words = [rnd.choice(filler) for _ in range(30)]
        words[5:5] = ["support", "vector", "machine"] if k % 2 else ["random", "forest"]
        words[12:12] = ["support", "vector"] if k % 3 == 0 else []
        rows += [(str(k), " ".join(words) + "."), (str(k), "the end of it")]
    rows += [("99", ""), ("99", "one"), ("99", "... !")]
    sections = spark.createDataFrame(rows, "document_id string, content string")
    want, total = plain_terms(rows, 10.83, 5.0, 3, 5)
    counts = materialized(terms.run_counts(sections), "runs")
    found = {r.term: (r.times, r.frequency, r.likelihood, r.value) for r in terms.terms(counts, total).collect()}
    assert set(found) == set(want) and {"support vector machine", "random forest", "support vector"} <= set(found) and "vector machine" not in found
    assert all(f[:2] == w[:2] and abs(f[2] - w[2]) < 1e-6 and abs(f[3] - w[3]) < 1e-9 for f, w in ((found[t], want[t]) for t in want))
    none = materialized(terms.run_counts(sections.filter("false")), "runs")
    assert terms.terms(none, 0).count() == 0


def test_sketches_of_batches(spark):
    """Merged batches count a document once, whichever batches hold it; few documents exactly."""
    rows = [(f"n{k % 7}", str(k)) for k in range(30_000)] + [("rare", str(k)) for k in range(12)] + [("seldom", "1")]
    table = spark.createDataFrame(rows, "name string, document_id string")
    parts = [table.filter(F.crc32(F.col("document_id").cast("binary")) % 3 == k) for k in range(3)]
    again = table.filter("document_id < '2'")
    held = sketches.batch_sketches(parts[0])
    for p in (*parts[1:], again):
        held = sketches.merged(held, sketches.batch_sketches(p))
    found = {r.name: r for r in sketches.frequencies(held).collect()}
    exact = Counter(n for n, _ in set(rows))
    assert "seldom" not in found and found["rare"].frequency == 12
    assert all(abs(found[n].frequency - exact[n]) <= 4 * 1.04 / 64 * exact[n] for n in found)
    assert found["rare"].n_sections == 12 + again.filter("name = 'rare'").count()


def test_sketched_query_is_near_the_counts(spark):
    from quillgraph.queries import REGISTRY

    medium = "/root/testdata/sf0.01"
    exact = {r.name: r for r in Graph(spark, medium).entities.collect()}
    found = {r.name: r for r in REGISTRY["entity_frequency_sketched"](spark, medium).collect()}
    assert len(set(exact) ^ set(found)) <= 0.01 * len(exact)
    assert all(abs(found[n].frequency - exact[n].frequency) <= max(1, 0.065 * exact[n].frequency) and found[n].n_sections == exact[n].n_sections for n in set(exact) & set(found))


def test_timer(spark):
    row = retrieval.timed(lambda: spark.range(3).withColumn("x", F.col("id") * 2)).collect()
    assert [r.x for r in sorted(row)] == [0, 2, 4] and len({r.processing_time for r in row}) == 1 and row[0].processing_time > 0


def test_runs_are_shuffled_once(spark, monkeypatch):
    """What is counted by document stays where the document's sections are."""
    monkeypatch.setattr(terms, "SECTION_BLOCK", 4, raising=False)
    sections = spark.createDataFrame([(str(k % 7), "one two three") for k in range(35)], "document_id string, content string")
    counts = terms.run_counts(sections)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(gram") == 1
    assert {(r.gram, r.times, r.frequency) for r in counts.collect()} == {(g, 35, 7) for g in ("one", "two", "three", "one two", "two three", "one two three")}
