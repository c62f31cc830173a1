"""Token-id shards: fixed-size id blocks as byte or bit planes, each compressed, with an index.

A *section* is a self-contained run of whole documents:

    magic, ids per block, plane kind, counts | document ids | document lengths
    | block index (byte offset of each block) | blocks

A block holds, for each plane, its compressed length and the zstandard frame; planes that are
all zero take four bytes. The index lets a reader decompress only the blocks that a document
touches. Sections travel as binary cells of a Parquet table, one table row for each section,
so Spark's commit protocol covers lost executors and any file system that Spark can write.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored, texts
from .token_cache import library_encoder

MAGIC = b"QGTB"
BLOCK_IDS = 16_384
SECTION_IDS = 1 << 20
_HEAD = struct.Struct("<4sIBxxxQQ")


def pack_block(ids: np.ndarray, planes: str, zip_level: int = 1) -> bytes:
    """One block of unsigned 32-bit ids as compressed planes."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T
    if planes == "bit":
        raw = [np.packbits(b >> k & 1) for b in raw for k in range(8)]
    z = zstandard.ZstdCompressor(level=zip_level)
    out = []
    for plane in raw:
        body = z.compress(np.ascontiguousarray(plane).tobytes()) if plane.any() else b""
        out += [struct.pack("<I", len(body)), body]
    return b"".join(out)


def unpack_block(data: memoryview, n: int, planes: str) -> np.ndarray:
    z = zstandard.ZstdDecompressor()
    ids, at = np.zeros(n, np.uint32), 0
    for k in range(32 if planes == "bit" else 4):
        (size,) = struct.unpack_from("<I", data, at)
        at += 4
        if size:
            plane = np.frombuffer(z.decompress(data[at : at + size]), np.uint8)
            if planes == "bit":
                ids |= np.unpackbits(plane, count=n).astype(np.uint32) << np.uint32(k)
            else:
                ids |= plane.astype(np.uint32) << np.uint32(8 * k)
            at += size
    return ids


def pack_section(doc_ids: list[int | None], runs: list[bytes], planes: str = "byte") -> bytes:
    """Whole documents in order; ``runs``: their ids, little-endian and 32 bits wide."""
    ids = np.frombuffer(b"".join(runs), "<u4")
    blocks = [pack_block(ids[k : k + BLOCK_IDS], planes) for k in range(0, len(ids), BLOCK_IDS)]
    known = np.array([d is not None for d in doc_ids], np.uint8)
    head = _HEAD.pack(MAGIC, BLOCK_IDS, planes == "bit", len(doc_ids), len(ids))
    parts = [head, known.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([len(r) // 4 for r in runs], "<u8").tobytes()]
    parts.append(np.cumsum([0, *map(len, blocks)]).astype("<u8").tobytes())
    return b"".join(parts + blocks)


class Section:
    """Reads a packed section; ``ids(a, b)`` touches only the blocks of that range."""

    def __init__(self, data: bytes):
        magic, self.block, bits, n_docs, self.n_ids = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token-id section")
        self.planes, at = "bit" if bits else "byte", _HEAD.size
        known = np.frombuffer(data, np.uint8, n_docs, at)
        raw = np.frombuffer(data, "<i8", n_docs, at + n_docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(raw, known)]
        self.lengths = np.frombuffer(data, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
        n_blocks = -(-self.n_ids // self.block)
        self.index = np.frombuffer(data, "<u8", n_blocks + 1, at + 17 * n_docs).astype(np.int64)
        self.body = memoryview(data)[at + 17 * n_docs + 8 * (n_blocks + 1) :]
        self._held: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def _block(self, k: int) -> np.ndarray:
        if self._held[0] != k:
            n = min(self.block, self.n_ids - k * self.block)
            self._held = (k, unpack_block(self.body[self.index[k] : self.index[k + 1]], n, self.planes))
        return self._held[1]

    def ids(self, start: int, stop: int) -> np.ndarray:
        first, last = start // self.block, -(-stop // self.block)
        parts = [self._block(k)[max(0, start - k * self.block) : stop - k * self.block] for k in range(first, last)]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


SHARD_SCHEMA = "shard int, section int, shard_start long, n_docs long, n_ids long, payload binary"


def write_token_shards(docs: DataFrame, tokenizer_path: str, end_id: int, planes: str = "byte") -> DataFrame:
    """Encode every text and store the ids in ascending doc_id order; returns the shard table.

    Range partitioning by (doc_id, place in the input) makes shard k precede shard k + 1, also
    where one id has very many rows; its bounds need no text. Null ids come first, null texts
    are empty (the end id alone), repeated rows are all kept, equal ids keep the order of the
    input; columns other than doc_id and text are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("tie"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = library_encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        shard, section, start, held = TaskContext.get().partitionId(), 0, 0, 0
        ids: list[int | None] = []
        runs: list[bytes] = []

        def flush() -> pa.RecordBatch:
            row = ([shard], [section], [start], [len(ids)], [held], [pack_section(ids, runs, planes)])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["shard", "section", "shard_start", "n_docs", "n_ids", "payload"])

        for batch in slices(batches, 1000):
            for doc_id, run in zip(batch.column("doc_id").to_pylist(), coder.encode(texts(batch))):
                ids.append(doc_id)
                runs.append(run + end)
                held += len(run) // 4 + 1
                if held >= SECTION_IDS:
                    yield flush()
                    section, start, held, ids, runs = section + 1, start + held, 0, [], []
        if ids:
            yield flush()

    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return stored(ordered.mapInArrow(encode, SHARD_SCHEMA), "token-shards")


def read_token_shards(shards: DataFrame) -> DataFrame:
    """A row for each stored document: doc_id, start, n_tokens, ids_crc32, read from the shards.

    The only thing gathered in one place is a total for each shard.
    """
    totals = shards.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    placed = shards.join(base, "shard").select((F.col("base") + F.col("shard_start")).alias("start"), "payload")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data in zip(batch.column("start").to_pylist(), batch.column("payload")):
                part = Section(data.as_py())
                ends = np.cumsum(part.lengths)
                starts = ends - part.lengths
                crcs = [zlib.crc32(part.ids(a, b).astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(part.doc_ids, pa.int64()), pa.array(starts + first, pa.int64()), pa.array(part.lengths, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
