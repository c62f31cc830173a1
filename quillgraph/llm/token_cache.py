"""Whole-text token ids from a per-worker cache of chunks between blanks and line ends.

A blank before a non-blank always starts a new pre-token of the byte-level pattern, a line end
between non-blanks is a token of its own, and the word tokenizer drops white space; so the ids
of a text are the ids of its chunks in a row. Texts in which white space follows white space are
encoded in one go. The chunks of a batch are told apart by Arrow's dictionary encoding, each is
looked up once, and the ids of the texts are gathered by index. New chunks of letters alone are
encoded together in one string, whose ids are cut where a token starts (or ends) a word. Models
of any other kind than these two, told by their normalizer, pre-tokenizer and vocabulary, get
whole texts.
"""

from __future__ import annotations

import string
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space in a row. White space of other kinds shows at the ends of chunks.
_GAPS = ("  ", " \n", "\n ", "\n\n")
#: Stands before the first chunk of a line, which has no blank before it.
_HEAD = "\0"
CACHE_ENTRIES = 300_000
#: Words that are encoded in one string; the library takes longer a word for longer strings.
WORDS_TOGETHER = 256
LONGEST_CACHED = 64
Ids = bytes


def pack(ids: list[int]) -> Ids:
    """Ids as little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes()


class ChunkEncoder:
    """``encode_many`` maps strings to lists of ids and is asked about each new chunk once.

    ``blanks_count``: the blank before a chunk belongs to its first token (byte-level models);
    None: chunks tell nothing, texts are encoded whole.
    ``encode_words``, if given, encodes many words of letters at once: it takes the words and
    what stands between them, and returns their packed ids, or None if they can't be told apart.
    ``normalized`` is what the model makes of a string first: a letter may become a letter and a
    mark, and the mark goes with the punctuation behind it.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[list[int]]], blanks_count: bool | None, encode_words: Callable[[list[str], str], list[Ids] | None] | None = None, normalized: Callable[[str], str] = str):
        self.encode_many, self.encode_words, self.normalized = encode_many, encode_words, normalized
        self.blanks_count = blanks_count
        self.known: dict[str, Ids | None] = {}
        self.marks: dict[str, Ids] = {}

    def _coded(self, chunks: list[str], lead: str) -> list[Ids]:
        if self.encode_words and chunks and (found := self.encode_words(chunks, lead or ("\n" if self.blanks_count else " "))) is not None:
            return found
        return list(map(pack, self.encode_many([lead + c for c in chunks])))

    def _learn(self, new: list[str], lead: str, key: str) -> None:
        """Add new chunks under ``key`` and the chunk; punctuation after letters is set apart."""
        known, words, others, marked = self.known, [], [], []
        for c in new:
            if c.isalpha():
                words.append(c)
            elif (stem := c.rstrip(string.punctuation)).isalpha() and (stem.isascii() or self.normalized(stem).isalpha()):
                marked.append((c, stem, c[len(stem) :]))
            elif c and (c[0].isspace() or c[-1].isspace()):
                known[key + c] = None  # its text is encoded whole
            else:
                others.append(c)
        words += [s for s in {stem for _, stem, _ in marked}.difference(words) if key + s not in known]
        known.update(zip([key + w for w in words] if key else words, self._coded(words, lead)))
        for m in {m for _, _, m in marked}.difference(self.marks):
            self.marks[m] = pack(self.encode_many([m])[0])
        for c, stem, m in marked:
            known[key + c] = known[key + stem] + self.marks[m]
        if others:
            known.update(zip([key + c for c in others], map(pack, self.encode_many([lead + c for c in others]))))

    def _prepared(self, text: str) -> str | None:
        """The text with its chunks between blanks; None if it must be encoded whole."""
        if self.blanks_count is None:
            return None
        if not self.blanks_count:
            if text.isascii() and "<|" not in text:
                text = text.lower()
            return text.replace("\n", " ")
        if _HEAD in text or any(g in text for g in _GAPS):
            return None
        return _HEAD + text.replace("\n", " \n " + _HEAD)

    def encode(self, texts: list[str]) -> list[Ids]:
        """Packed ids of each text."""
        ready = [self._prepared(t) for t in texts]
        out: list[Ids | None] = [None] * len(texts)
        place = [k for k, r in enumerate(ready) if r is not None]
        if place:
            for k, ids in zip(place, self._gathered([ready[k] for k in place])):
                out[k] = ids
        left = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(left, self.encode_many([texts[k] for k in left]) if left else ()):
            out[k] = pack(ids)
        return out

    def _gathered(self, ready: list[str]) -> list[Ids | None]:
        """Packed ids of prepared texts; None for one with a chunk that has no ids of its own."""
        chunks = pc.split_pattern(pa.array(ready, pa.large_string()), " ")
        coded = chunks.flatten().dictionary_encode()
        distinct, which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        known = self.known
        found = list(map(known.get, distinct))
        missed = [k for k, f in enumerate(found) if f is None]
        fresh = [distinct[k] for k in missed]
        if self.blanks_count:
            heads = [c[1:] for c in fresh if c[:1] == _HEAD]
            self._learn([c for c in fresh if c[:1] != _HEAD and c != "\n"], " ", "")
            if "\n" in fresh:
                known["\n"] = pack(self.encode_many(["\n"])[0])
            if _HEAD in fresh:
                known[_HEAD] = b""
            self._learn([c for c in heads if c], "", _HEAD)
        else:
            if "" in fresh:
                known[""] = b""
            self._learn([c for c in fresh if c], "", "")
        for k, c in zip(missed, fresh):
            found[k] = known[c]
        unsure = None
        if any(found[k] is None for k in missed):
            unsure = np.array([f is None for f in found])
            found = [f or b"" for f in found]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        starts = np.cumsum(sizes) - sizes
        blob = np.frombuffer(b"".join(found), np.uint32)
        many = sizes[which]
        ends = np.cumsum(many)
        ids = blob[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[which] - (ends - many), many)]
        edges = np.concatenate([[0], ends])[chunks.offsets.to_numpy()]
        data = ids.tobytes()
        out: list[Ids | None] = [data[a:b] for a, b in zip((4 * edges[:-1]).tolist(), (4 * edges[1:]).tolist())]
        if unsure is not None:
            hit = np.concatenate([[0], np.cumsum(unsure[which])])[chunks.offsets.to_numpy()]
            for k in np.flatnonzero(hit[1:] > hit[:-1]):
                out[k] = None
        for c in fresh:
            if len(c) > LONGEST_CACHED:
                known.pop(c, None)
                known.pop(c.rstrip(string.punctuation), None)
        if len(known) > CACHE_ENTRIES:
            # What was known before this batch and came again is likely to come once more.
            new = set(missed)
            again = {c: f for k, (c, f) in enumerate(zip(distinct, found)) if k not in new}
            known.clear()
            if len(again) <= CACHE_ENTRIES // 2:
                known.update(again)
        if len(self.marks) > 10_000:
            self.marks.clear()
        return out


@lru_cache(2)
def library_encoder(path: str, plain: bool = False) -> ChunkEncoder:
    """A ChunkEncoder over a file of the tokenizers library, truncation and padding unused.
    ``plain``: names of special tokens within a text are text as any other.

    It is kept for the later tasks of the same worker.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    model.encode_special_tokens = plain
    byte_level = "ByteLevel" in str(model.pre_tokenizer) and model.normalizer is None
    spelled = model.get_vocab(with_added_tokens=True)
    suffix = getattr(model.model, "end_of_word_suffix", None)
    lower = not byte_level and suffix == "</w>" and model.normalizer is not None and model.normalizer.normalize_str("A B\nÉ") == "a b é"
    if not byte_level and not lower:
        return ChunkEncoder(lambda strings: [e.ids for e in model.encode_batch_fast(strings, add_special_tokens=False)], None)
    edge = np.zeros(max(spelled.values()) + 1, bool)
    edge[[k for t, k in spelled.items() if (t.startswith("Ġ") if byte_level else t.endswith("</w>"))]] = True
    line_end = model.encode("\n", add_special_tokens=False).ids

    def encode_many(strings: list[str]) -> list[list[int]]:
        return [e.ids for e in model.encode_batch_fast(strings, add_special_tokens=False)]

    def encode_words(words: list[str], between: str) -> list[Ids] | None:
        out: list[Ids] = []
        for at in range(0, len(words), WORDS_TOGETHER):
            part = words[at : at + WORDS_TOGETHER]
            lead = between if between == " " and byte_level else ""
            ids = np.array(model.encode_batch_fast([lead + between.join(part)], add_special_tokens=False)[0].ids, np.uint32)
            if byte_level and between == "\n":
                stops = np.flatnonzero(ids == line_end[0])
                starts, ends = np.concatenate([[0], stops + 1]), np.concatenate([stops, [len(ids)]])
            elif byte_level:
                starts = np.flatnonzero(edge[ids])
                ends = np.concatenate([starts[1:], [len(ids)]])
            else:
                ends = np.flatnonzero(edge[ids]) + 1
                starts = np.concatenate([[0], ends[:-1]])
            if len(starts) != len(part):
                return None
            blob = ids.tobytes()
            out += [blob[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist())]
        return out

    return ChunkEncoder(encode_many, byte_level, encode_words, str if byte_level else model.normalizer.normalize_str)
