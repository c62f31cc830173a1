"""Personal data: patterns for known kinds, and contextual extraction bootstrapped from them.

What the patterns of the four kinds find are the seed instances. They induce lexical patterns:
the two words before an instance, the one before with what stands between, the one after, both
neighbours, and the shape of its own characters. Spark scores the graph of patterns and
instances in turns: a pattern is as good for a kind as the share of its distinct instances that
are known for it, an instance as good as the best pattern it occurs in. Patterns of high
confidence that have enough distinct instances then mark identifiers that no base pattern
matches.

Bounds of the added spans, whatever the size of the corpus: context is looked for up to
``_REACH`` code points away on the same line, a number needs ``MIN_DIGITS`` digits, and an
identifier has at most about ``_LONGEST`` code points. Base spans have no such bounds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, hinted, slices, stored

KINDS = ("email", "ip", "card", "phone")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
_BEFORE = re.compile(r"(\w+)\W*\s\W*(\w+)\W+$")
_ALONE = re.compile(r"^\W*(\w+)\W+$")
_LAST = re.compile(r"(\w+)(\W{1,4})$")
_NEXT = re.compile(r"(\W{1,4})(\w+)")
#: A label that stands before an identifier without a blank.
_LABEL = re.compile(r"[^\W\d]+[:=#]+(?=[\w(+])")
#: Groups of digits that a blank may join, and what may stand at their head.
_GROUP = re.compile(r"[0-9][0-9().\-/]*")
_HEAD = re.compile(r"\+?(?:[A-Za-z]{1,4})?[0-9][0-9().\-/]*")
#: Forms of addresses besides those of the base pattern.
_ADDRESS = re.compile(r"(?<![\w.+-])[\w.+-]{1,64}@[\w-][\w.-]{0,62}(?![\w@-])")
_AT = re.compile(r"[(\[{] ?at ?[)\]}]", re.I)
_LOCAL_END = re.compile(r"(?<![\w.+-])[\w.+-]{1,64} ?$")
_HOST = re.compile(r" ?[\w-]{1,62}(?:(?: ?[(\[{] ?dot ?[)\]}] ?| dot |\.)[\w-]{1,62}| (?:com|org|net|edu|gov|int|info|io|eu|de|fr|es|it|nl|uk|us)(?!\w))*", re.I)
#: How far before an instance its pattern may begin, and the digits that make a number.
_REACH = 80
MIN_DIGITS = 5
_LONGEST = 64
#: Turns of scoring; what a pattern needs to be trusted: confidence and distinct instances.
ROUNDS = 3
MIN_CONFIDENCE = 0.8
MIN_INSTANCES = 4
#: Trusted patterns that are sent to the tasks (of some 20 bytes); more are joined by a shuffle.
MOST_PATTERNS = 1_000_000
#: A pattern counts as if it had one more instance that is unknown.
DOUBT = 1.0


def emails(text: str) -> list[tuple[int, int]]:
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every base match, by kind and start; code points, end exclusive."""
    out = [(0, a, b) for a, b in emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(d := _digits(m.group())) <= 19 and _luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def pattern_before(text: str, start: int) -> str | None:
    """The two words before a place, in lower case, if they are on its line; a word that begins
    the line stands alone, after a ``^``."""
    near = text[max(0, start - _REACH) : start]
    line = near[near.rfind("\n") + 1 :]
    if m := _BEFORE.search(line):
        return f"{m[1]} {m[2]}".lower()
    if (len(line) < len(near) or start <= _REACH) and (m := _ALONE.match(line)):
        return f"^ {m[1]}".lower()
    return None


def addresses(text: str) -> list[tuple[int, int]]:
    """Words joined by an @ or by a bracketed "at", whatever the form of the host."""
    out = [(m.start(), m.end() - len(m[0]) + len(m[0].rstrip(".-"))) for m in _ADDRESS.finditer(text)] if "@" in text else []
    for m in _AT.finditer(text):
        local, host = _LOCAL_END.search(text, max(0, m.start() - 66), m.start()), _HOST.match(text, m.end())
        if local and host:
            out.append((local.start(), host.end()))
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What may be an identifier and no base span touches: addresses, and words or groups of
    digits joined by single blanks with MIN_DIGITS digits or more, without outer punctuation."""
    spans = sorted((a, b) for _, a, b in taken)
    if "@" in text or _AT.search(text):
        named = []
        for a, b in addresses(text):
            if not any(x < b and a < y for x, y in spans) and not (named and a < named[-1][1]):
                named.append((a, b))
        spans = sorted([*spans, *named])
    else:
        named = []
    out, at, k = list(named), 0, 0
    chain: tuple[int, int, int] | None = None  # start, end, end with what follows the last group

    def close() -> None:
        if chain and sum("0" <= c <= "9" for c in text[chain[0] : chain[1]]) >= MIN_DIGITS:
            out.append(chain[:2])

    while m := _DIGIT.search(text, at):
        start = end = m.start()
        low = max(at, start - _LONGEST)
        while start > low and not text[start - 1].isspace():
            start -= 1
        high = min(len(text), end + _LONGEST)
        while end < high and not text[end].isspace():
            end += 1
        at = end
        if end == high < len(text) or start == low and low > 0 and not text[low - 1].isspace():
            close()
            chain = None
            continue  # longer than any identifier
        first, stop = start, end
        while start < end and not text[start].isalnum():
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        if start > first and text[start - 1] == "+":
            start -= 1
        if label := _LABEL.match(text, start, end):
            start = first = label.end()
            while start < end and not text[start].isalnum():
                start += 1
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        if k < len(spans) and spans[k][0] < end:
            close()
            chain = None
            continue
        if text[first:start] == "(" and ")" in text[start:stop]:
            start = first  # an area code in brackets
        numeric = _GROUP.fullmatch(text, start + (text[start] in "(+"), end)
        if chain and numeric and text[start] != "+" and first == chain[2] + 1 and text[chain[2]] in " \xa0" and start in (first, first + 1) and end - chain[0] <= _LONGEST:
            chain = (chain[0], end, stop)
        else:
            close()
            chain = (start, end, stop)
        if text[end:stop] not in ("", ")") or not (numeric or _HEAD.fullmatch(text, start + (text[start] == "("), end)):
            close()  # the next group is not joined to this one
            chain = None
    close()
    return sorted(out)


def shape(identifier: str) -> str | None:
    """Its characters with digits as 9 and letters as a; None for a bare run of either."""
    out = "".join("9" if "0" <= c <= "9" else "a" if c.isalpha() else c for c in identifier)
    return None if len(set(out)) == 1 or out.isalnum() else out


def patterns_of(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a place: contexts on its line, and its own shape."""
    out = [f"2 {two}"] if (two := pattern_before(text, start)) else []
    near, far = text[max(0, start - _REACH) : start], text[end : end + _REACH]
    last, after = _LAST.search(near[near.rfind("\n") + 1 :]), _NEXT.match(far.split("\n", 1)[0])
    if last:
        out.append(f"< {last[1]}{last[2]}".lower())
    if after:
        out.append(f"> {after[1]}{after[2]}".lower())
    if last and after:
        out.append(f"= {last[1]}{last[2]}{after[1]}{after[2]}".lower())
    if own := shape(text[start:end]):
        out.append(f"~ {own}")
    return out


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def places_of(text: str) -> list[tuple[int, int, int, list[int], int]]:
    """(kind, start, end, hashes of patterns, hash of the instance): base spans, then candidates
    (kind -1) of the whole text."""
    base = base_spans(text)
    both = [*base, *((-1, a, b) for a, b in candidates(text, base))]
    return [(kind, a, b, list(map(_hash, patterns_of(text, a, b))), _hash(text[a:b].lower())) for kind, a, b in both]


def pattern_links(docs: DataFrame) -> DataFrame:
    """Distinct pattern, instance and kind (-1: not known) over all texts, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            seen = list({(p, own, kind) for text in batch.column(0).to_pylist() if text for kind, _, _, found, own in places_of(text) for p in found})
            cols = [pa.array([x[k] for x in seen], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["pattern", "instance", "kind"])

    seen = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "pattern long, instance long, kind int")
    return stored(seen.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "pii-links")


def trusted_patterns(links: DataFrame, rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE, min_instances: int = MIN_INSTANCES) -> DataFrame:
    """pattern, kind, confidence, stored: contexts whose distinct instances are nearly all of one
    kind. Works on distinct (pattern, instance) links; sums are taken before anything is joined.
    """
    size = links.groupBy("pattern").agg(F.count("*").alias("instances"), F.max("kind").alias("best")).filter((F.col("instances") >= min_instances) & (F.col("best") >= 0))
    size = stored(size.select("pattern", "instances"), "pii-sizes")  # contexts that no seed has are out
    links = stored(links.join(hinted(size), "pattern"), "pii-likely")
    seeds = links.filter("kind >= 0").select("instance", "kind", F.lit(1.0).alias("belief")).distinct()
    known, scores = seeds, None
    for _ in range(rounds):
        # Patterns from what is believed of their instances ...
        reached = links.select("pattern", "instance", "instances").join(known, "instance").groupBy("pattern", "kind").agg(F.sum("belief").alias("belief"), F.first("instances").alias("instances"))
        before, scores = scores, reached.select("pattern", "kind", (F.col("belief") / (F.col("instances") + DOUBT)).alias("confidence"))
        scores = stored(scores.filter(F.col("confidence") >= 0.1), "pii-patterns")
        # ... and instances from the best pattern they occur in, if that is any good.
        told = links.filter("kind < 0").select("pattern", "instance").join(hinted(scores).filter(F.col("confidence") >= 0.5), "pattern")
        known = seeds.union(told.groupBy("instance", "kind").agg(F.max("confidence").alias("belief")))
        if before is not None:
            discard(before)
    best = F.max(F.struct("confidence", (-F.col("kind")).alias("less"))).alias("best")
    out = scores.filter(F.col("confidence") >= min_confidence).groupBy("pattern").agg(best)
    out = stored(out.select("pattern", (-F.col("best.less")).cast("int").alias("kind"), "best.confidence"), "pii-trusted")
    discard(size, links, scores)
    return out


class Patterns:
    """Trusted patterns as sorted arrays."""

    def __init__(self, rows: pa.Table):
        order = np.argsort(rows.column("pattern").to_numpy(), kind="stable")
        self.key, self.kind, self.confidence = (rows.column(c).to_numpy()[order] for c in ("pattern", "kind", "confidence"))

    def kind_of(self, found: list[int]) -> int | None:
        """The kind that the best of some patterns speaks for."""
        wanted = np.array(found, np.int64)
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        hit = at[self.key[at] == wanted]
        return int(min((-self.confidence[k], self.kind[k]) for k in hit)[1]) if len(hit) else None

    def spans(self, text: str) -> list[tuple[int, int, int, bool]]:
        """(kind, start, end, added) by kind and start."""
        if not len(self.key):
            return [(kind, a, b, False) for kind, a, b in base_spans(text)]
        out = []
        for kind, a, b, found, _ in places_of(text):
            if kind >= 0:
                out.append((kind, a, b, False))
            elif found and (told := self.kind_of(found)) is not None:
                out.append((told, a, b, True))
        return sorted(out)


_SPANS = "array<struct<kind: int, start: int, end: int, added: boolean>>"
_SPAN_KIND = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())]))


def _listed(found: list[tuple[int, int, int, bool]]) -> list[dict]:
    return [{"kind": k, "start": a, "end": b, "added": new} for k, a, b, new in found]


def _sent(trusted: DataFrame, most: int) -> Patterns | None:
    """The patterns, if they are few enough to go to every task."""
    return Patterns(trusted.toArrow()) if trusted.limit(most + 1).count() <= most else None


def personal_data(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), most_patterns: int = MOST_PATTERNS) -> DataFrame:
    """``keep`` columns and ``spans``: array of (kind, start, end, added) by kind and start.

    Null and empty texts and rows without any personal data have an empty array; texts of any
    length are read whole; repeated rows repeat; an empty table gives no rows; other columns are
    ignored whatever their names. All texts are read twice: to learn the patterns, and to apply
    them. Beyond ``most_patterns`` the second pass is a join.
    """
    links = pattern_links(docs)
    trusted = trusted_patterns(links)
    discard(links)
    patterns = _sent(trusted, most_patterns)
    if patterns is None:
        return _by_join(docs, trusted, keep)
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [_listed(patterns.spans(t or "")) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, _SPAN_KIND)], names=[*keep, "spans"])

    return rows.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), f"spans {_SPANS}"]))


def _by_join(docs: DataFrame, trusted: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The same spans for any number of patterns: places are stored with a number for each row,
    and their patterns joined."""
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("__row"))
    kinds = dict(rows.dtypes)
    place = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("patterns", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [[{"kind": k, "start": a, "end": b, "patterns": p} for k, a, b, p, _ in places_of(t or "")] for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], batch.column(len(keep) + 1), pa.array(found, place)], names=[*keep, "__row", "found"])

    schema = [*(f"`{k}` {kinds[k]}" for k in keep), "__row long", "found array<struct<kind: int, start: int, end: int, patterns: array<long>>>"]
    found = stored(rows.mapInArrow(run, ", ".join(schema)), "pii-places")
    loose = found.select("__row", F.explode("found").alias("o")).filter("o.kind < 0").select("__row", "o.start", "o.end", F.explode("o.patterns").alias("pattern"))
    told = loose.join(trusted, "pattern").groupBy("__row", "start", "end").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("less"))).alias("best"))
    one = F.struct((-F.col("best.less")).cast("int").alias("kind"), "start", "end", F.lit(True).alias("added"))
    added = told.groupBy("__row").agg(F.collect_list(one).alias("more"))
    base = F.transform(F.filter("found", lambda o: o["kind"] >= 0), lambda o: F.struct(o["kind"].alias("kind"), o["start"].alias("start"), o["end"].alias("end"), F.lit(False).alias("added")))
    both = F.array_sort(F.concat(base, F.coalesce("more", F.array().cast(_SPANS))))
    return found.join(added, "__row", "left").select(*keep, both.alias("spans"))


def _joined(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def digests(found: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts of base spans by kind, the digest of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: ~s["added"])
    of = lambda k: F.filter(base, lambda s: s["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(*keep, *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _without(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    parts, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], s[0])):
        if a >= at:
            parts += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def redacted(docs: DataFrame, most_patterns: int = MOST_PATTERNS) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets, and n_chars brought up
    to date if there is such a column.

    Overlapping spans are replaced as one, by the first kind. Null texts stay null, empty ones
    empty; texts of any length are read whole; repeated rows repeat; an empty table stays empty;
    the columns stay as they are. Texts are read twice and never written.
    """
    links = pattern_links(docs)
    trusted = trusted_patterns(links)
    discard(links)
    patterns = _sent(trusted, most_patterns)
    names, kinds = list(docs.columns), dict(docs.dtypes)
    place = names.index("text")
    rows = docs.withColumn("text", F.col("text").cast("string"))
    if patterns is None:
        whole = docs.select(F.struct(*names).alias("__doc"), "text")
        found, free = _by_join(whole, trusted, ("__doc",)), "__spans"
        while free in map(str.lower, names):
            free += "_"
        rows = found.select("__doc.*", F.col("spans").alias(free)).withColumn("text", F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(place).to_pylist()
            if patterns is None:
                found = [[(s["kind"], s["start"], s["end"], s["added"]) for s in x] for x in batch.column(len(names)).to_pylist()]
            else:
                found = [patterns.spans(t) if t else [] for t in texts]
            columns = batch.columns[: len(names)]
            columns[place] = pa.array([_without(t, f) if f else t for t, f in zip(texts, found)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = rows.mapInArrow(run, ", ".join(f"`{c}` {'string' if c == 'text' else kinds[c]}" for c in names))
    return out.withColumn("n_chars", F.length("text").cast(kinds["n_chars"])) if "n_chars" in kinds else out
