from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillgraph.llm import queries, simhash

BLANK = " \t\n\r\v\f"


def _words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in BLANK:
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def plain_fingerprint(text, size=3):
    words = _words(text)
    shingles = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, max_bits=3):
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= max_bits:
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(ids)):
        groups[find(k)].append(ids[k])
    return {find(k): min(groups[find(k)]) for k in range(len(ids))}, [find(k) for k in range(len(ids))]


@pytest.mark.parametrize("hot", [64, 2])
def test_query_equals_brute_force(spark, small, documents, monkeypatch, hot):
    """Also when nearly every segment counts as crowded and goes through blocks."""
    monkeypatch.setattr(simhash, "HOT_SEGMENT", hot)
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rows = documents.select("doc_id", "text").orderBy("doc_id").collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    least, where = plain_components([r.doc_id for r in rows], prints)
    expected = {r.doc_id: (f"{p:016x}", least[w]) for r, p, w in zip(rows, prints, where)}
    found = queries.op1_simhash_near_dedup(spark, small).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == expected


@pytest.mark.parametrize("max_bits", [3, 7])
def test_links_of_planted_neighbours(spark, max_bits):
    """Chains and clouds of fingerprints at every distance up to the limit and one beyond."""
    rng = np.random.default_rng(5)
    made = []
    for _ in range(12):
        centre = int(rng.integers(0, 2**63))
        made.append(centre)
        for bits in range(1, max_bits + 2):
            made.append(centre ^ sum(1 << int(b) for b in rng.choice(64, bits, replace=False)))
    made += [0] * 5
    least, where = plain_components(list(range(len(made))), made, max_bits)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    prints = spark.createDataFrame([(k, signed(p), 0) for k, p in enumerate(made)], "doc_id long, fp long, check_fp long")
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(prints, max_bits).collect()}
    assert found == {k: least[w] for k, w in enumerate(where)}


def test_variants_are_never_broadcast(spark):
    """Spark sizes them as if explode made no rows: they would all go through the driver."""
    nodes = spark.range(500).select(F.xxhash64("id").alias("fp"), F.lit(0).cast("long").alias("check_fp"))
    plan = simhash.links(simhash.stored(nodes, "nodes"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin(\(\w+=\w+\))? \[tag#\d+, part#\d+L\], \[tag#\d+, part#\d+L\], Inner", plan)
    # What is broadcast are crowded keys alone.
    assert not re.search(r"BroadcastHashJoin [^\n]*BuildLeft", plan)
    assert len(re.findall("BroadcastHashJoin", plan)) == len(re.findall(r"BroadcastHashJoin \[tag#\d+, part#\d+L\], \[tag#\d+, part#\d+L\], (?:LeftAnti|Inner), BuildRight", plan))
    several = simhash.hinted(simhash.stored(nodes, "nodes"), most=10)
    assert "SortMergeJoin" in nodes.join(several, "fp")._jdf.queryExecution().executedPlan().toString()


def test_hard_rows(hard, nothing):
    prints = simhash.fingerprints(hard, 3)
    found = simhash.near_duplicates(prints).collect()
    assert len(found) == hard.count()
    assert {r.component_id for r in found if r.fp == 0} == {1}
    assert simhash.near_duplicates(simhash.fingerprints(nothing, 3)).count() == 0


def _jaccard(a, b, size=5):
    cut = lambda w: {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))}
    a, b = cut(_words(a)), cut(_words(b))
    return len(a & b) / len(a | b)


def test_one_of_each_group_stays(spark, documents):
    texts = [r.text for r in documents.orderBy("doc_id").limit(12).collect()]
    rows = [(k, t) for k, t in enumerate(texts)]
    for k, t in enumerate(texts):
        words = t.split(" ")
        for turn, step in enumerate((90, 8)):  # near copies, and copies changed too much
            changed = [f"changed{n}" if n % step == step - 1 else w for n, w in enumerate(words)]
            rows.append((100 * (turn + 1) + k, " ".join(changed)))
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    out = simhash.deduplicated(table)
    assert out.columns == table.columns
    kept = {r.doc_id for r in out.collect()}
    by_id = dict(rows)
    assert set(range(12)) <= kept
    for k, t in by_id.items():
        near = k >= 100 and any(_jaccard(t, by_id[o]) >= 0.8 for o in kept if o != k)
        assert near != (k in kept) or k < 100 or _jaccard(t, by_id[k % 100]) < 0.8


def test_dedup_of_hard_rows(hard, nothing):
    out = simhash.deduplicated(hard)
    assert out.columns == hard.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(5) == 1 and 6 not in ids and 1 in ids and 2 not in ids
    assert simhash.deduplicated(nothing).count() == 0
    many = hard.filter("doc_id = 5").select("doc_id", F.explode(F.array_repeat("text", 300)).alias("text"))
    assert simhash.deduplicated(many).count() == 1


def _kept_by_brute_force(by_id, similarity=0.8):
    """The least id of each component of all pairs."""
    sets = {}
    for k, t in by_id.items():
        w = _words(t)
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    root = {k: k for k in by_id}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in by_id:
        for b in by_id:
            if a < b and (both := len(sets[a] & sets[b])) >= similarity * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k for k in by_id if find(k) == k}


def _prose(rng, n):
    return [f"w{k}" for k in rng.zipf(1.3, n) % 5000]


def test_runs_of_words_appended_cut_or_replaced(spark):
    rng = np.random.default_rng(11)
    by_id = {}
    for k in range(30):
        base = _prose(rng, int(rng.integers(100, 400)))
        n = len(base)
        run = int(n * rng.uniform(0.08, 0.25))
        at = int(rng.integers(0, n - run))
        by_id[10 * k] = base
        by_id[10 * k + 1] = base + _prose(rng, run)
        by_id[10 * k + 2] = base[run:]
        by_id[10 * k + 3] = base[:at] + _prose(rng, run // 2) + base[at + run // 2 :]
    by_id = {k: " ".join(w) for k, w in by_id.items()}
    table = spark.createDataFrame(list(by_id.items()), "doc_id long, text string")
    gone = set(by_id) - {r.doc_id for r in simhash.deduplicated(table).collect()}
    wanted = set(by_id) - _kept_by_brute_force(by_id)
    assert gone <= wanted and len(gone) >= 0.9 * len(wanted)


def test_recall_of_links_at_scale_of_texts():
    """Share of pairs at 0.8 or more that share a key: runs of words, and words here and there."""
    rng = np.random.default_rng(3)
    keys = lambda w: {(i, v & ~bit) for i, v in enumerate(simhash.word_segments([x.encode() for x in w])) for bit in [0, *(1 << b for b in range(simhash.SEGMENT_BITS) if v >> b & 1)]}
    hits = {"runs": [], "scattered": []}
    for k in range(200):
        base = _prose(rng, int(rng.integers(100, 400)))
        n, run = len(base), int(len(base) * rng.uniform(0.05, 0.2))
        at = int(rng.integers(0, n - run))
        other = list(base)
        for w in rng.choice(n, max(1, int(n * rng.uniform(0.005, 0.02))), replace=False):
            other[w] = f"new{w}"
        for kind, o in (("runs", base + _prose(rng, run)), ("runs", base[run:]), ("runs", base[:at] + _prose(rng, run // 2) + base[at + run // 2 :]), ("scattered", other)):
            if _jaccard(" ".join(base), " ".join(o)) >= 0.8:
                hits[kind].append(bool(keys(base) & keys(o)))
    assert np.mean(hits["runs"]) >= 0.9 and np.mean(hits["scattered"]) >= 0.98


def test_crowd_at_the_edge_of_similarity(spark, monkeypatch):
    """Many variants of one text, whose pairs lie on both sides of 0.8: no link is replaced by another that fails."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(7)
    base, by_id = _prose(rng, 300), {}
    for k in range(90):
        words = list(base)
        for at in rng.choice(300, int(rng.integers(3, 6)), replace=False):
            words[at] = f"own{k}x{at}" if rng.random() < 0.5 else f"other{at}"
        by_id[k] = " ".join(words)
    table = spark.createDataFrame(list(by_id.items()), "doc_id long, text string")
    assert {r.doc_id for r in simhash.deduplicated(table).collect()} == _kept_by_brute_force(by_id)


def test_crowded_neighbours_meet_in_blocks(spark, monkeypatch):
    """Texts on both sides of 0.8, all their segments taken as crowded: no pair of them is written,
    and the links are those of all pairs."""
    rng = np.random.default_rng(5)
    base, by_id = _prose(rng, 300), {}
    for k in range(120):
        words = list(base)
        for at in rng.choice(300, int(rng.integers(3, 6)), replace=False):
            words[at] = f"own{k}x{at}"
        by_id[k] = " ".join(words)
    table = spark.createDataFrame(list(by_id.items()), "doc_id long, text string")
    written, stored = [], simhash.stored

    def counted(df, name, *more):
        out = stored(df, name, *more)
        written.extend([out.count()] if name == "dedup-pairs" else [])
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    monkeypatch.setattr(simhash, "CROWDED_PAIRS", 0, raising=False)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 16)
    assert {r.doc_id for r in simhash.deduplicated(table).collect()} == _kept_by_brute_force(by_id)
    assert written == [0]
