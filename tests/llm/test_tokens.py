"""Encoders, token-id shards and packing against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillgraph.llm import bitplanes, bpe, packing, queries
from quillgraph.llm.queries import tokenizer_file
from quillgraph.llm.token_cache import library_encoder

NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def library(name):
    model = Tokenizer.from_file(tokenizer_file(name))
    model.no_truncation()
    model.no_padding()
    return model


MODELS = {name: library(name) for name in NAMES}
TEXTS = st.text(st.one_of(st.sampled_from("abcdehilnorst ,.\n'!%é"), st.characters(codec="utf-8")), max_size=80)
ODD = ["", " ", "\n", "a\n b", "  two", "x <|endoftext|> y", "İstanbul ß ﬁ", "it's we're a\n\nb", "t\tx y z", "end ", "end\n", "\nstart", "<|startoftext|>a", "b" * 5000 + ", c", "q\r\nr", "x\x1cy \x85 z", "½ ² ٣", "é ö,"]


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(TEXTS, max_size=4))
def test_chunks_equal_whole_texts(name, texts):
    texts = texts + ODD
    whole = [np.array(e.ids, "<u4").tobytes() for e in MODELS[name].encode_batch(texts, add_special_tokens=False)]
    assert library_encoder(tokenizer_file(name)).encode(texts) == whole


@pytest.mark.parametrize("name", NAMES)
def test_every_letter_before_every_mark(name):
    """Letters that become a letter and a mark when normalised, and all others, before ASCII marks."""
    letters = [chr(k) for k in range(0x80, 0x2FA20) if chr(k).isalpha() and not 0xD800 <= k < 0xE000 and not 0x3400 <= k < 0x9FF0 and not 0xAC00 <= k < 0xD7A0]
    letters += [chr(k) for k in (0x3400, 0x4E00, 0x9FEF, 0xAC00, 0xAC01, 0xD7A3)]
    marks, rnd = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", random.Random(1)
    cases = [c + rnd.choice(marks) for c in letters] + ["a" + c + rnd.choice(marks) * 2 for c in letters]
    cases += [c + m for c in "İŉǰΐẖẗẘẙẚՙক়খড়ঢ়য়שׁשּאַיִﭏ" + "".join(map(chr, [*range(0x958, 0x960), *range(0x9DC, 0x9E0), *range(0xFB1D, 0xFB4F)])) for m in marks]
    whole = [np.array(e.ids, "<u4").tobytes() for e in MODELS[name].encode_batch(cases, add_special_tokens=False)]
    found = library_encoder(tokenizer_file(name)).encode(cases)
    assert [c for c, a, b in zip(cases, found, whole) if a != b] == []
    together = " ".join(cases)
    assert library_encoder(tokenizer_file(name)).encode([together]) == [np.array(MODELS[name].encode(together, add_special_tokens=False).ids, "<u4").tobytes()]


def test_other_kinds_of_models_get_whole_texts(tmp_path):
    """A cased word-level model: ids equal those of the library."""
    from tokenizers import models, pre_tokenizers

    model = Tokenizer(models.WordLevel({"[UNK]": 0, "Hello": 1, "hello": 2, "World": 3, "world": 4}, unk_token="[UNK]"))
    model.pre_tokenizer = pre_tokenizers.Whitespace()
    model.save(f"{tmp_path}/words.json")
    texts = ["Hello World", "hello  world", "", "World, Hello"]
    assert library_encoder(f"{tmp_path}/words.json").encode(texts) == [np.array(model.encode(t).ids, "<u4").tobytes() for t in texts]


BPE = bpe.BacktrackingBpe(tokenizer_file(NAMES[0]))


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_backtracking_equals_library(text):
    ids = MODELS[NAMES[0]].encode(text, add_special_tokens=False).ids
    assert BPE.encode(text) == ids
    assert BPE.decode(np.array(ids, np.uint32)) == MODELS[NAMES[0]].decode(ids, skip_special_tokens=False)


def test_backtracking_on_one_long_word():
    rnd = random.Random(2)
    text = "".join(rnd.choice("abenrst") for _ in range(20_000))
    assert BPE.encode(text) == MODELS[NAMES[0]].encode(text, add_special_tokens=False).ids


def test_round_trip_query(spark, small, documents, hard, nothing):
    model, rows = MODELS[NAMES[0]], {r.doc_id: r.text for r in documents.collect()}
    for r in queries.op10_bpe_backtracking(spark, small).collect():
        ids = model.encode(rows[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(hard, tokenizer_file(NAMES[0])).count() == hard.count()
    assert bpe.round_trip(nothing, tokenizer_file(NAMES[0])).count() == 0


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_planes(planes):
    rng = np.random.default_rng(4)
    runs = [rng.integers(0, 2**32 if k % 3 else 500, n, dtype=np.uint32) for k, n in enumerate((0, 1, 7, 40_000, 16_384, 5))]
    part = bitplanes.Section(bitplanes.pack_section([3, None, 5, 6, 7, 8], [r.astype("<u4").tobytes() for r in runs], planes))
    assert part.doc_ids == [3, None, 5, 6, 7, 8]
    whole = np.concatenate(runs)
    for a, b in ((0, len(whole)), (16_000, 16_800), (40_000, 40_000), (5, 6)):
        assert (part.ids(a, b) == whole[a:b]).all()


def test_shards_query(spark, small, documents):
    model, start = MODELS[NAMES[0]], 0
    found = {r.doc_id: r for r in queries.op4_bitplane_tokens(spark, small).collect()}
    rows = documents.orderBy("doc_id").collect()
    assert len(found) == len(rows)
    for r in rows:
        ids = np.array([*model.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        f = found[r.doc_id]
        assert (f.start, f.n_tokens, f.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_shards_of_hard_rows(hard, nothing, monkeypatch):
    path = tokenizer_file(NAMES[0])
    rows = bitplanes.read_token_shards(bitplanes.write_token_shards(hard, path, 2)).orderBy("start").collect()
    assert len(rows) == hard.count()
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    assert [r.doc_id or 0 for r in rows] == sorted(r.doc_id or 0 for r in rows)
    assert bitplanes.read_token_shards(bitplanes.write_token_shards(nothing, path, 2)).count() == 0


def check_packing(rows, capacity):
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_packing_query(spark, small, documents):
    model, pieces = MODELS[NAMES[1]], {}
    for r in documents.collect():
        ids = np.array([*model.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            pieces[r.doc_id, k // 2048] = (k, len(part), zlib.crc32(part.tobytes()))
    rows = queries.op9_genetic_packing(spark, small).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == pieces and len(rows) == len(pieces)
    used = check_packing(rows, 2048)
    lengths = Counter(n for _, n, _ in pieces.values())
    assert used <= sum(packing.best_fit(lengths, 2048).values())
    assert used <= packing.lower_bound(lengths, 2048) + 1


def test_packing_of_hard_rows(hard, nothing):
    path = tokenizer_file(NAMES[1])
    rows = packing.pack_documents(hard, path).collect()
    assert check_packing(rows, 2048) and sum(r.piece == 0 for r in rows) == hard.count()
    assert packing.pack_documents(nothing, path).count() == 0


def test_many_copies_are_packed_whole(spark):
    """Copies of a document meet in no one bucket and each has a place of its own."""
    from pyspark.sql import functions as F

    many = spark.range(0, 3000, 1, 4).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same words again").alias("text"))
    rows = packing.pack_documents(many, tokenizer_file(NAMES[1])).collect()
    assert len(rows) == 3000 and len({(r.sequence_id, r.offset) for r in rows}) == 3000
    check_packing(rows, 2048)


def test_evolution_beats_best_fit():
    """Triplets that fill bins exactly: best fit opens more bins than crossover needs."""
    rng = random.Random(12)
    lengths = Counter()
    for _ in range(120):
        a, b = rng.randint(260, 450), rng.randint(260, 450)
        for k in (a, b, 1000 - a - b):
            lengths[k] += 1
    first = packing.best_fit(lengths, 1000)
    best = packing.evolve(lengths, 1000, [first], 60, 8, 3)[0]
    held = Counter()
    for b, n in best.items():
        assert sum(b) <= 1000
        for k in b:
            held[k] += n
    assert held == lengths
    assert packing.lower_bound(lengths, 1000) <= sum(best.values()) < sum(first.values())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=8), st.integers(0, 99))
def test_plans_keep_every_length(lengths, seed):
    lengths, rng = Counter(lengths), random.Random(seed)
    first = packing.best_fit(lengths, 40)
    other = packing.best_fit(Counter({k: n for k, n in lengths.items() if k < 20}), 40, packing.best_fit(Counter({k: n for k, n in lengths.items() if k >= 20}), 40))
    plans = [first, other, packing.crossover(first, other, 40, rng), packing.mutate(other, 40, rng)] + packing.evolve(lengths, 40, [first], 3, 4, seed)
    for plan in plans:
        held = Counter()
        for b, n in plan.items():
            assert n > 0 and sum(b) <= 40
            for k in b:
                held[k] += n
        assert held == lengths
    assert sum(plans[4].values()) <= sum(first.values())


def test_best_fit_gathers_its_bins_in_one_go(monkeypatch):
    """Hundreds of kinds of bins are not copied once for each room that bins have left."""
    copies = []

    class Counted(Counter):
        def __add__(self, other):
            copies.append(len(self))
            return Counter.__add__(self, other)

    monkeypatch.setattr(packing, "Counter", Counted)
    monkeypatch.setattr(packing, "defaultdict", lambda kind: defaultdict(Counted))
    lengths = Counter({k: 3 for k in range(400, 1000)})
    plan = packing.best_fit(lengths, 1000)
    held = Counter()
    for b, n in plan.items():
        for k in b:
            held[k] += n
    assert held == lengths and all(sum(b) <= 1000 for b in plan) and not copies


def test_chunks_that_come_again_outlive_a_full_cache(monkeypatch):
    """A full cache drops what came once; what came again is not encoded anew, and ids stay right."""
    from quillgraph.llm import token_cache

    asked = []

    def encode_many(strings):
        asked.extend(strings)
        return [[sum(map(ord, s))] for s in strings]

    monkeypatch.setattr(token_cache, "CACHE_ENTRIES", 6)
    coder = token_cache.ChunkEncoder(encode_many, False)
    wanted = lambda text: token_cache.pack([sum(map(ord, w)) for w in text.split(" ")])
    for text in ("der hund", "der hund a b c d e", "der hund f"):
        assert coder.encode([text]) == [wanted(text)]
    assert asked.count("der") == asked.count("hund") == 1
    assert len(coder.known) <= 6
