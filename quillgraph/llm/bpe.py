"""Byte-level BPE by backtracking over longest tokens.

An automaton over all tokens gives the longest token at each byte. The encoder takes the
longest token that is compatible with the one before; if none is, it backs up and takes a
shorter one there. Two neighbours are compatible if merging them alone would keep the border
between them, which holds for every neighbouring pair of a merge result and for no other
tokenization. Each byte position is given up at most once, so time is linear.

Decoding looks tokens up in one byte string by an offset table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts
from .token_cache import ChunkEncoder

#: Unicode white space, and the byte-level pattern that splits a text first.
_SPACE = r"\t-\r \x85\xa0  -     　"
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def _letters_of_bytes() -> dict[str, int]:
    """Printable bytes stand for themselves; the others follow from code point 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class BacktrackingBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = _letters_of_bytes(), spec["model"]
        spelled = {t: bytes(letters[c] for c in t) for t in model["vocab"]}
        vocab = {b: model["vocab"][t] for t, b in spelled.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._pretoken = regex.compile(PRETOKEN)
        # Tokens are numbered by age here: bytes first, then the result of each merge.
        single = [b for b in vocab if len(b) == 1]
        self.spell: list[bytes] = sorted(single)
        age = {b: k for k, b in enumerate(self.spell)}
        self.left, self.right = list(range(len(single))), list(range(len(single)))
        self.merge: dict[tuple[int, int], int] = {}
        for rule in model["merges"]:
            a, b = (spelled[x] for x in (rule if isinstance(rule, list) else rule.split(" ")))
            if a + b in age:
                raise ValueError("two merges make the same token")
            age[a + b] = self.merge[age[a], age[b]] = len(self.spell)
            self.left.append(age[a])
            self.right.append(age[b])
            self.spell.append(a + b)
        self.size = [len(b) for b in self.spell]
        self.id_of = [vocab[b] for b in self.spell]
        automaton = ahocorasick.Automaton()
        for b, k in age.items():
            automaton.add_word(b.decode("latin-1"), k)
        automaton.make_automaton()
        self.matches = automaton.iter
        #: The longest token that is a proper prefix of a token; -1: none.
        self.shorter = [next((age[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in age), -1) for b in self.spell]
        self._fits: dict[int, bool] = {}
        tokens = {v: k for k, v in vocab.items()} | {v: k.encode() for k, v in self.special.items()}
        sizes = np.array([len(tokens.get(k, b"")) for k in range(max(tokens) + 1)])
        self.blob = np.frombuffer(b"".join(tokens.get(k, b"") for k in range(len(sizes))), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum(sizes)])

    def fits(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay apart when only their bytes are merged.

        Walk the border back through the merges that made both sides, youngest first: the
        border falls if an older merge joins the tokens that meet there at that time.
        """
        key = a << 20 | b
        if (known := self._fits.get(key)) is not None:
            return known
        x, y, before = a, b, len(self.spell)
        while True:
            made = self.merge.get((x, y))
            if made is not None and made < before:
                ok = False
                break
            split_x = self.right[x] != x and (x > y or self.left[y] == y)
            if split_x:
                before, x = x, self.right[x]
            elif self.left[y] != y:
                before, y = y + 1, self.left[y]
            else:
                ok = True
                break
        if len(self._fits) > 1_000_000:
            self._fits.clear()
        self._fits[key] = ok
        return ok

    def encode_pretoken(self, word: bytes) -> list[int]:
        n, size, fits, shorter = len(word), self.size, self.fits, self.shorter
        longest = [-1] * n
        for end, token in self.matches(word.decode("latin-1")):
            longest[end + 1 - size[token]] = token  # longer ones end later
        usable = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0] if n else -1
        while at < n:
            while token >= 0 and not (usable[at + size[token]] and (not out or fits(out[-1], token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                token = longest[at] if at < n else -1
            else:
                usable[at] = 0
                token = out.pop()
                at -= size[token]
                token = shorter[token]
        return [self.id_of[t] for t in out]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, with the strings of special tokens recognised."""
        out: list[int] = []
        for part in self._split_special.split(text) if self._split_special else [text]:
            if part in self.special:
                out.append(self.special[part])
            else:
                for word in self._pretoken.findall(part):
                    out += self.encode_pretoken(word.encode())
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Bytes of all ids in a row, gathered by the offset table."""
        first, sizes = self.offset[ids], self.offset[ids + np.uint32(1)] - self.offset[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return b""
        return self.blob[np.arange(ends[-1]) + np.repeat(first - (ends - sizes), sizes)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(2)
def _coder(path: str) -> tuple[BacktrackingBpe, ChunkEncoder]:
    """Kept for the later tasks of the same worker."""
    bpe = BacktrackingBpe(path)
    return bpe, ChunkEncoder(lambda strings: [bpe.encode(s) for s in strings], True)


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text is empty (no ids); repeated rows give repeated results; other columns are
    ignored. There is no shuffle: a worker keeps a bounded cache of the chunks it has seen.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, coder = _coder(tokenizer_path)
        decimal = [str(k) for k in range(len(bpe.offset))]
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in slices(batches, 1000):
            ids = [np.frombuffer(r, "<u4") for r in coder.encode(texts(batch))]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                pa.array([len(r) for r in ids], pa.int64()),
                pa.array([sha(",".join(map(decimal.__getitem__, r.tolist())).encode()) for r in ids], pa.string()),
                pa.array([sha(bpe.decode(r).encode()) for r in ids], pa.string()),
            ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
