"""Token alignment against byte-by-byte brute force over the libraries' own ids."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillgraph.llm import alignment, queries
from quillgraph.llm.queries import tokenizer_file

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
PATHS = (tokenizer_file(A), tokenizer_file(B))
LIB = Tokenizer.from_file(PATHS[0])
LIB.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
TEXTS = st.text(st.one_of(st.sampled_from("abehilnorst ,.\n'!%é▁"), st.characters(codec="utf-8")), max_size=60)
ODD = ["", None, " ", "  ", "a  b", " a", "a ", "▁x", "<|endoftext|> x", "<s> y </s>", "<0x41>", "日本 語", "ﬁ é", "\x00a", "x\n\ny", "don't  stop\r\n", "½ ²", "word " * 40]


def piece_bytes(k):
    return bytes([int(PIECES.id_to_piece(k)[3:5], 16)]) if PIECES.is_byte(k) else PIECES.id_to_piece(k).replace("▁", " ").encode()


def byte_of():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in keep)}


BYTES = byte_of()


def tokens(text):
    whole = b" " + (text or "").encode()
    a, b = LIB.encode(" " + (text or ""), add_special_tokens=False).ids, PIECES.encode(text or "")
    of_a, of_b = [bytes(BYTES[c] for c in LIB.id_to_token(k)) for k in a], [piece_bytes(k) for k in b]
    if not text or b"".join(of_a) != whole or b"".join(of_b) != whole:
        return [], []
    spans = lambda ids, parts: [(i, sum(map(len, parts[:k])), sum(map(len, parts[: k + 1]))) for k, (i, _) in enumerate(zip(ids, parts))]
    return spans(a, of_a), spans(b, of_b)


def brute(rows):
    """rows of (doc_id, text) to the query's rows."""
    held, count = [], Counter()
    for doc_id, text in rows:
        a, b = tokens(text)
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        stops = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, low = [], 0
        for hi in stops:
            groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= hi) for side in (a, b)))
            low = hi
        count.update(links)
        held.append((doc_id, a, b, links, groups))
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    digest = lambda groups: hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
    return sorted(((d, len(a), len(b), len(g), len(x), sum(count[p] == most[p[1]] for p in x), sum(count[p] for p in x), digest(g)) for d, a, b, x, g in held), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_tokens_equal_libraries(texts):
    texts = texts + ODD
    found = alignment.tokens_of(texts, *PATHS)
    assert [(a.tolist(), b.tolist()) for a, b in found] == [tuple([t[0] for t in side] for side in tokens(x)) for x in texts]


@pytest.mark.parametrize("window", [1 << 19, 7])
def test_parts_equal_whole_texts(window, monkeypatch):
    """Also where texts are cut into parts of a few tokens."""
    monkeypatch.setattr(alignment, "WINDOW", window)
    way = alignment.Alignment(*(alignment.encoders(*PATHS)[k] for k in (1, 3)))
    texts = [*ODD, "Tokenizers disagree about internationalisation, naïveté and 12345 ☃ snowmen."]
    for text, r in zip(texts, way.described(alignment.tokens_of(texts, *PATHS))):
        a, b = tokens(text)
        links = Counter(x[0] * way.n_b + y[0] for x in a for y in b if x[1] < y[2] and y[1] < x[2])
        whole = brute([(1, text)])[0]
        assert (r[0], r[1], r[2], r[3], r[4]) == (*whole[1:5], whole[7])
        assert dict(zip(np.frombuffer(r[5], "<i8").tolist(), np.frombuffer(r[6], "<i4").tolist())) == links


@pytest.mark.parametrize("share", [1 << 19, 50, 0])
def test_hard_rows_equal_brute_force(spark, hard, documents, nothing, monkeypatch, share):
    """Pairs looked up and pairs joined, in all proportions."""
    monkeypatch.setattr(alignment, "HOT_SHARE", share)
    docs = hard.filter("doc_id is null or doc_id not in (4, 8)").select("doc_id", "text", "fp", "row")
    odd = spark.createDataFrame(list(enumerate(ODD, 100)), "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True).unionByName(documents.filter("doc_id < 12").select("doc_id", "text"), allowMissingColumns=True)
    docs = docs.filter("length(text) < 4000 or text is null")
    assert rows_of(alignment.aligned(docs, *PATHS)) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert alignment.aligned(nothing, *PATHS).count() == 0
    long = rows_of(alignment.aligned(hard.filter("doc_id in (4, 8)"), *PATHS))
    assert len(long) == 2 and all(r[1] and r[2] and r[4] >= max(r[1], r[2]) for r in long)


def test_query(spark, small):
    """Whole table: sums over documents agree with the pairs' counts, and every row is there."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = rows_of(queries.op12_token_alignment(spark, small))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(found) == len(rows)
    count, most = Counter(), defaultdict(int)
    links = {}
    for doc_id, text in rows:
        a, b = (alignment.tokens_of([text], *PATHS)[0])
        sizes = alignment.encoders(*PATHS)
        ea, eb = np.cumsum([len(sizes[1][k]) for k in a]), np.cumsum([len(sizes[3][k]) for k in b])
        i = j = 0
        out = []
        while i < len(a) and j < len(b):  # a merge of both sides
            out.append((int(a[i]), int(b[j])))
            i, j = i + (ea[i] <= eb[j]), j + (eb[j] <= ea[i])
        links[doc_id] = out
        count.update(out)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    for r in found:
        x = links[r[0]]
        assert r[4:7] == (len(x), sum(count[p] == most[p[1]] for p in x), sum(count[p] for p in x))
