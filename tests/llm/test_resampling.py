"""Importance resampling against plain counts, and chunks against whole texts."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import queries, resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def runs(text, words):
    found = WORD.findall(lowered(text))
    return [" ".join(found[i : i + k]) for k in range(1, words + 1) for i in range(len(found) - k + 1)]


def brute(docs, target, words=1):
    """doc rows (doc_id, text) to (doc_id, n_features, weight, score, rank), all in plain Python."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, runs(text, words)))
    for text in target:
        t.update(map(bucket, runs(text, words)))
    s_all, t_all, rows = sum(s.values()), sum(t.values()), []
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    for doc_id, text in docs:
        found = runs(text, words)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(WORD.findall(lowered(text))), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(order[: 10 * len(order) // 100])}
    return sorted(((r[0], *r[2:], rank.get(id(r))) for r in rows), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aB9é .\n-"), max_size=120), st.integers(1, 4), st.integers(1, 30))
def test_chunks_own_each_feature_once(text, words, size):
    data = text.encode().lower()
    whole, parts = Counter(resampling.features(data, len(data), words, 997)[1].tolist()), Counter()
    n = 0
    for chunk, own in resampling.cut(data, words, size):
        mine, cells = resampling.features(chunk, own, words, 997)
        parts.update(cells.tolist())
        n += mine
    assert parts == whole == Counter(zlib.crc32(f.encode()) % 997 for f in runs(text, words))
    assert n == len(WORD.findall(lowered(text)))


@pytest.mark.parametrize("words", [1, 3])
def test_hard_rows_equal_plain_counts(spark, small, hard, nothing, monkeypatch, words):
    """Long texts are cut here; repeated rows, nulls and ties have results of their own."""
    monkeypatch.setattr(resampling, "CHUNK", 2000)
    target = spark.read.parquet(f"{small}/benchmark.parquet")
    docs = hard.unionByName(hard.filter("doc_id in (4, 8)"))
    found = rows_of(resampling.resampled(docs, target, words))
    assert found == brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], words)
    assert resampling.resampled(nothing, target).count() == 0
    assert rows_of(resampling.resampled(hard, target.filter("false"))) == brute([(r.doc_id, r.text) for r in hard.collect()], [])


def test_query_equals_plain_counts_and_sql(spark):
    medium = "/root/testdata/sf0.01"
    found = rows_of(queries.op11_importance_resampling(spark, medium))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{medium}/{t}.parquet'")
    sql = con.sql(f"SELECT doc_id, n_features, weight, score, rank FROM ({queries.oracle_sql()['op11_importance_resampling']})").fetchall()
    assert found == sorted(sql, key=str)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{medium}/documents.parquet").collect()]
    assert found == brute(docs, [r.text for r in spark.read.parquet(f"{medium}/benchmark.parquet").collect()])
    assert {r[4] for r in found} >= set(range(1, max(r[4] or 0 for r in found) + 1))


def test_gains_of_empty_counts():
    assert (resampling.gains(np.zeros(10, np.int64), np.zeros(10, np.int64)) == 0).all()
