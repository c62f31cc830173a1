"""Alignment of the tokens of two tokenizers over the bytes of the same text.

The tokens of B form a static index of byte intervals; for each token of A two bisections give the
first and the last token of B that it overlaps. Gaps between bytes that no token spans are where
tokens of both end, and cut both sequences into groups. How often two ids are linked is counted
over the whole corpus, and each document is then described by the counts of its own links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _letters_of_bytes
from .common import discard, slices, stored
from .token_cache import ChunkEncoder, library_encoder, pack

#: Tokens of both kinds that are aligned at a time; longer texts are cut where groups end.
WINDOW = 1 << 19
#: Texts that are encoded at a time.
_TEXTS = 128
#: A pair of ids with more than one link in so many is looked up in a table of fewer rows than
#: this, whatever the corpus; other pairs are joined.
HOT_SHARE = 1 << 19
#: Pairs that a task holds before it adds them up.
_HELD = 1 << 21

Tokens = tuple[np.ndarray, np.ndarray]


class PieceEncoder(ChunkEncoder):
    """Ids of whole texts by way of their words, for a piece model none of whose pieces crosses a
    blank: ids of a text with single blanks between words are the ids of its words in a row."""

    def __init__(self, model):
        names = [model.id_to_piece(k) for k in range(model.get_piece_size())]
        crossing = any("▁" in p[1:] and p.strip("▁") for p in names)
        super().__init__(lambda strings: model.encode(strings, num_threads=1), None if crossing else False)

    def _prepared(self, text: str) -> str | None:
        plain = self.blanks_count is not None and text and "  " not in text and "▁" not in text and text[0] != " " and text[-1] != " "
        return text if plain else None

    def _learn(self, new: list[str], lead: str, key: str) -> None:
        self.known.update(zip(new, map(pack, self.encode_many(new))))


def byte_table(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; those of special tokens are their names."""
    from tokenizers import Tokenizer

    byte_of, spelled = _letters_of_bytes(), Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(spelled.values()) + 1)
    for token, k in spelled.items():
        out[k] = bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode()
    return out


@lru_cache(1)
def encoders(path_a: str, path_b: str) -> tuple[ChunkEncoder, list[bytes], ChunkEncoder, list[bytes]]:
    """Encoders of both models and the bytes of their ids, kept for later tasks of the worker."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path_b)
    pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    spelled = [bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
    return library_encoder(path_a, plain=True), byte_table(path_a), PieceEncoder(model), spelled


def tokens_of(texts: list[str | None], path_a: str, path_b: str) -> list[Tokens]:
    """Ids of A over a blank and the text, and of B over the text. Both are empty for a null or
    empty text, and where the bytes of either are not those of the blank and the text."""
    of_a, bytes_a, of_b, bytes_b = encoders(path_a, path_b)
    out: list[Tokens] = []
    found = zip(texts, of_a.encode([" " + (t or "") for t in texts]), of_b.encode([t or "" for t in texts]))
    for text, *packed in found:
        a, b = (np.frombuffer(p, np.uint32).astype(np.int64) for p in packed)
        whole = b" " + (text or "").encode()
        same = text and all(b"".join(map(table.__getitem__, ids.tolist())) == whole for table, ids in ((bytes_a, a), (bytes_b, b)))
        out.append((a, b) if same else (a[:0], b[:0]))
    return out


class Alignment:
    """Alignment of documents' tokens, given the lengths of both kinds of tokens in bytes."""

    def __init__(self, bytes_a: list[bytes], bytes_b: list[bytes]):
        self.size_a, self.size_b = (np.array([len(x) for x in table], np.int64) for table in (bytes_a, bytes_b))
        self.n_a, self.n_b = len(bytes_a), len(bytes_b)
        # Ids as text with what stands behind them: within a side, between sides, between groups.
        self.names = [b"%d%s" % (k, end) for n, ends in ((self.n_a, (b",", b"|")), (self.n_b, (b",", b";"))) for end in ends for k in range(n)]

    def cut(self, a: np.ndarray, b: np.ndarray) -> list[Tokens]:
        """The tokens of a text in parts of about WINDOW tokens, cut where a group ends."""
        if len(a) + len(b) <= WINDOW:
            return [(a, b)]
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        shared, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        stops = np.unique(np.searchsorted(at_a + at_b, np.arange(WINDOW, len(a) + len(b), WINDOW)))
        stops = np.unique(np.append(stops[stops < len(shared)], len(shared) - 1))
        edges = [(0, 0), *((int(at_a[k]) + 1, int(at_b[k]) + 1) for k in stops)]
        return [(a[i:j], b[k:m]) for (i, k), (j, m) in zip(edges, edges[1:])]

    def aligned(self, parts: list[Tokens]) -> list[tuple[int, int, bytes, np.ndarray, np.ndarray]]:
        """For each part the number of groups and of links, its groups as text (each with a
        semicolon behind it), and its distinct pairs (a * n_b + b, ascending) with their links."""
        a, b = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        if not len(a):
            return [(0, 0, b"", a, a)] * len(parts)
        many_a, many_b = (np.array([len(p[k]) for p in parts]) for k in (0, 1))
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        starts_a, starts_b = ends_a - self.size_a[a], ends_b - self.size_b[b]
        # Stabbing the intervals of B with both ends of each token of A.
        first = np.searchsorted(ends_b, starts_a, "right")
        many = np.searchsorted(starts_b, ends_a, "left") - first
        links = np.cumsum(many)
        link_b = np.arange(links[-1]) + np.repeat(first - (links - many), many)
        # A token of A that ends where one of B does ends a group, and so does that of B.
        last_b = first + many - 1
        stop_a = ends_b[last_b] == ends_a
        stop_b = np.zeros(len(b), bool)
        stop_b[last_b[stop_a]] = True
        group_a, group_b = np.cumsum(stop_a) - stop_a, np.cumsum(stop_b) - stop_b
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = a + self.n_a * stop_a
        order[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = 2 * self.n_a + b + self.n_b * stop_b
        part = np.repeat(np.arange(len(parts)), many_a)
        n_groups, n_links = np.bincount(part, stop_a, len(parts)).astype(int), np.bincount(part, many, len(parts)).astype(int)
        span = self.n_a * self.n_b
        keys, n = np.unique(np.repeat(part * span + a * self.n_b, many) + b[link_b], return_counts=True)
        at = np.searchsorted(keys, np.arange(len(parts) + 1) * span)
        ends, out = np.cumsum(many_a + many_b), []
        for k, hi in enumerate(ends.tolist()):
            text = b"".join(map(self.names.__getitem__, order[hi - many_a[k] - many_b[k] : hi].tolist()))
            out.append((int(n_groups[k]), int(n_links[k]), text, keys[at[k] : at[k + 1]] - k * span, n[at[k] : at[k + 1]]))
        return out

    def described(self, tokens: list[Tokens]) -> Iterator[tuple[int, int, int, int, str, bytes, bytes]]:
        """For each text n_a, n_b, n_groups, n_links, groups_sha256, and its pairs and their links
        as packed 64-bit and 32-bit integers. Short texts are aligned many at a time."""
        held: list[tuple[int, Tokens]] = []
        state: dict[int, list] = {k: [0, 0, hashlib.sha256(), []] for k in range(len(tokens))}

        def flush():
            for (k, _), (groups, links, text, codes, n) in zip(held, self.aligned([p for _, p in held]) if held else ()):
                s = state[k]
                if s[0] and groups:
                    s[2].update(b";")
                s[2].update(text[:-1])
                s[0], s[1] = s[0] + groups, s[1] + links
                s[3].append((codes, n))
            held.clear()

        room = WINDOW
        for k, whole in enumerate(tokens):
            for p in self.cut(*whole):
                if held and room < len(p[0]) + len(p[1]):
                    flush()
                    room = WINDOW
                held.append((k, p))
                room -= len(p[0]) + len(p[1])
        flush()
        for k, (a, b) in enumerate(tokens):
            groups, links, digest, found = state[k]
            codes, n = added(*(np.concatenate([f[i] for f in found]) for i in (0, 1))) if len(found) > 1 else found[0]
            yield len(a), len(b), groups, links, digest.hexdigest() if len(a) else "", codes.astype("<i8").tobytes(), n.astype("<i4").tobytes()


def added(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sum of ``n`` of each."""
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(n, first) if len(first) else n


def _documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """What ``Alignment.described`` gives of every row, which has a number of its own; stored."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "links"]
    kinds = [*[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, bytes_a, _, bytes_b = encoders(path_a, path_b)
        way = Alignment(bytes_a, bytes_b)
        for batch in slices(batches, _TEXTS):
            cols = zip(*way.described(tokens_of(batch.column(2).to_pylist(), path_a, path_b)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=names)

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, links binary"
    return stored(rows.mapInArrow(run, schema), "alignments", "zstd")


def _packed(batch: pa.RecordBatch, codes: str = "codes", links: str = "links") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All codes of a batch, their links, and the row of each within the batch."""
    c, n = batch.column(codes).to_pylist(), batch.column(links).to_pylist()
    return np.frombuffer(b"".join(c), "<i8"), np.frombuffer(b"".join(n), "<i4").astype(np.int64), np.repeat(np.arange(len(c)), [len(x) >> 3 for x in c])


def pair_counts(found: DataFrame) -> DataFrame:
    """code and count: the links of each pair of ids, summed in the tasks before any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in chain(slices(batches, 64), [None]):
            if batch is not None:
                codes, n, _ = _packed(batch)
                held.append(added(codes, n))
                size += len(held[-1][0])
            if held and (batch is None or size > _HELD):
                codes, n = added(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], names=["code", "n"])
                held, size = [], 0

    parts = found.select("codes", "links").mapInArrow(run, "code long, n long")
    return parts.groupBy("code").agg(F.sum("n").alias("count"))


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    ``path_a`` is a byte-level file of the tokenizers library, ``path_b`` a sentencepiece model.
    A null or empty text, and one that either of the two does not give back byte by byte, has no
    tokens, zeros and an empty groups_sha256; very long texts are aligned in parts; repeated rows
    all count and all come back; among pairs that tie for the highest count of a B id each is
    best; an empty table gives no rows; other columns are ignored whatever their names.

    Pairs with more than one link in ``HOT_SHARE`` are looked up in a table that this number
    bounds; rarer ones are joined. Of each id of B one number reaches the driver.
    """
    spark, (_, bytes_a, _, bytes_b) = docs.sparkSession, encoders(path_a, path_b)
    n_b = len(bytes_b)
    found = _documents(docs, path_a, path_b)
    counts = stored(pair_counts(found), "pair-counts")
    total = counts.agg(F.sum("count")).first()[0] or 0
    best = np.zeros(n_b, np.int64)
    for r in counts.groupBy(F.expr(f"cast(code % {n_b} as int)").alias("b")).agg(F.max("count").alias("most")).collect():
        best[r.b] = r.most
    often = F.col("count") * HOT_SHARE > total
    table = counts.filter(often).toArrow()
    order = np.argsort(table.column("code").to_numpy())
    hot = spark.sparkContext.broadcast((table.column("code").to_numpy()[order], table.column("count").to_numpy()[order], best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, most = hot.value
        for batch in slices(batches, 64):
            codes, n, row = _packed(batch)
            at = np.searchsorted(known, codes).clip(max=max(len(known) - 1, 0))
            hit = known[at] == codes if len(known) else np.zeros(len(codes), bool)
            held, k = count[at[hit]], row[hit]
            # Weights of bincount are doubles: sums of whole numbers are taken with integers.
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], k, n[hit] * (held == most[codes[hit] % n_b]))
            np.add.at(sums[1], k, n[hit] * held)
            edges = np.concatenate([[0], np.cumsum(np.bincount(row[~hit], minlength=batch.num_rows))]).astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays([pa.array(codes[~hit]), pa.array(n[~hit])], ["code", "n"]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], *map(pa.array, sums), rest], names=[*batch.schema.names[:7], "n_best", "count_sum", "rest"])

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rest array<struct<code: long, n: long>>"
    summed = stored(found.mapInArrow(run, schema), "alignments", "zstd")
    discard(found)
    seldom = summed.select("row", F.inline("rest")).join(counts.filter(~often), "code")
    top = spark.createDataFrame([(k, v) for k, v in enumerate(best.tolist()) if v], "b int, most long")
    marked = seldom.join(F.broadcast(top), F.expr(f"cast(code % {n_b} as int)") == F.col("b"))
    more = marked.groupBy("row").agg(F.sum(F.when(F.col("count") == F.col("most"), F.col("n")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("count")).alias("more_sum"))
    both = summed.drop("rest").join(more, "row", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return both.select("doc_id", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "more_best"), plus("count_sum", "more_sum"), "groups_sha256")
