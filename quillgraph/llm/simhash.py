"""SimHash near-duplicates through one-wildcard segment variants.

Fingerprints within ``max_bits`` bits of each other, cut into ``max_bits // 2 + 1`` segments,
agree in some segment but for one bit at most. So each distinct fingerprint is indexed under
every segment as it is and under every segment with one bit struck out; an equality join of
the sides with a 0 and a 1 at that bit finds all candidates, and counting bits verifies them.

Only distinct fingerprints take part, so a group of copies costs one row. Segments shared by
more than ``HOT_SEGMENT`` fingerprints go another way, exact as well: their members are dealt
into blocks, each pair of blocks is one task, and what a task returns is a spanning forest of
the links that it sees, never the pairs. Components come from contracting the link graph.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, hinted, slices, stored

SEED = 42
#: Segments with more distinct fingerprints than this are handled in blocks.
HOT_SEGMENT = 64
#: Fingerprints of one side of a block.
BLOCK = 1024
_WAY = 100_000


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, as UTF-8."""
    return (text or "").encode().lower().split()


def fingerprint(words: list[bytes], size: int, distinct: bool = False) -> int:
    """64 bits: bit k is set if it is set in over half of the shingle hashes; no words: 0."""
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    elif size == 1:
        shingles = words
    else:
        shingles = list(map(b" ".join, zip(*(words[k:] for k in range(size)))))
    if distinct:
        shingles = list(set(shingles))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(shingles), _WAY):
        part = shingles[at : at + _WAY]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), np.uint64, len(part))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(shingles), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, distinct: bool = False, verify_words: int = 0, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``fp`` and ``check_fp`` (a second fingerprint, 0 if not asked for).

    Null and empty texts have fingerprint 0. Rows are never merged.
    """
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cut = [words_of(t) for t in batch.column(len(keep)).to_pylist()]
            fp = np.array([fingerprint(w, words, distinct) for w in cut], np.uint64).view(np.int64)
            check = np.array([fingerprint(w, verify_words) if verify_words else 0 for w in cut], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(fp), pa.array(check)], names=[*keep, "fp", "check_fp"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", fp long, check_fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(max_bits: int) -> tuple[list[int], list[int]]:
    """For each tag the bits that its key keeps: tags 0-63 strike out one bit, the others none."""
    n = max_bits // 2 + 1
    cuts = [64 * k // n for k in range(n + 1)]
    whole = [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:])]
    return [m & ~(1 << bit) for m, (a, b) in zip(whole, zip(cuts, cuts[1:])) for bit in range(a, b)], whole


def _near(max_bits: int, check_bits: int) -> Column:
    far = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
    return (far("l.fp", "r.fp") <= max_bits) & (far("l.check_fp", "r.check_fp") <= check_bits)


def _forest(left: np.ndarray, right: np.ndarray, max_bits: int, check_bits: int) -> list[tuple[int, int]]:
    """Links of a spanning forest between rows of two (n, 2) arrays, as positions in a row.

    Of all spanning forests it is the one of closest links by the second fingerprint: each
    round every component takes its closest link to another one.
    """
    n, m = len(left), len(right)
    if not n or not m:
        return []
    check = np.bitwise_count(left[:, None, 1] ^ right[None, :, 1])
    near = (np.bitwise_count(left[:, None, 0] ^ right[None, :, 0]) <= max_bits) & (check <= check_bits)
    none = np.iinfo(np.int64).max
    key = np.where(near, check.astype(np.int64) * (n * m) + np.arange(n * m).reshape(n, m), none)
    label, out = np.arange(n + m), []
    while True:
        best = np.full(n + m, none)
        np.minimum.at(best, label[:n], key.min(1))
        np.minimum.at(best, label[n:], key.min(0))
        picks = np.unique(best[best < none]) % (n * m)
        if not len(picks):
            return out
        a, b = picks // m, n + picks % m
        out += zip(a.tolist(), b.tolist())
        x, y = label[a], label[b]
        while True:  # components joined by the picks take the least label
            low = np.arange(n + m)
            np.minimum.at(low, x, y)
            np.minimum.at(low, y, x)
            if (low[x] == x).all() and (low[y] == y).all():
                break
            label, x, y = low[label], low[x], low[y]
        key[label[:n][:, None] == label[n:][None, :]] = none


def links(nodes: DataFrame, max_bits: int = 3, check_bits: int = 64) -> DataFrame:
    """Links between distinct fingerprints whose closure is that of all pairs in reach.

    ``nodes``: fp, check_fp, without repeats. Returns columns a and b (structs of both).
    """
    struck, whole = _masks(max_bits)
    mask = F.lit(np.array([_signed(m) for m in struck + whole], np.int64).tolist())
    tags = F.sequence(F.lit(0), F.lit(len(struck + whole) - 1))
    variants = nodes.select("fp", "check_fp", F.explode(tags).alias("tag")).select(
        "tag",
        F.col("fp").bitwiseAND(F.element_at(mask, F.col("tag") + 1)).alias("part"),
        F.when(F.col("tag") < 64, F.expr("cast(shiftright(fp, tag) & 1L as int)")).otherwise(2).alias("side"),
        "fp",
        "check_fp",
    )

    # A key with a wildcard holds the members of two segments, so segments tell all hot keys.
    crowded = variants.filter("tag >= 64").groupBy("tag", "part").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_SEGMENT)
    spread = crowded.select("n", F.col("part").alias("fp"), F.explode(tags).alias("tag"), F.col("tag").alias("segment"))
    segment_of = F.lit([64 + k for k, m in enumerate(whole) for _ in range(m.bit_count())] + [64 + k for k in range(len(whole))])
    hot = spread.filter(F.element_at(segment_of, F.col("tag") + 1) == F.col("segment"))
    hot = hot.select("tag", F.col("fp").bitwiseAND(F.element_at(mask, F.col("tag") + 1)).alias("part"), "n")
    hot = hinted(stored(hot.groupBy("tag", "part").agg(F.ceil((F.sum("n") + HOT_SEGMENT) / BLOCK).cast("int").alias("blocks")), "hot-segments"))

    # Spark sizes variants as if explode made no rows, a seventieth of what they are, and would
    # broadcast them through the driver.
    cold = variants.join(hot, ["tag", "part"], "left_anti")
    ordered = (F.col("l.tag") < 64) | (F.struct("l.fp", "l.check_fp") < F.struct("r.fp", "r.check_fp"))
    sides = (F.col("l.tag") == F.col("r.tag")) & (F.col("l.part") == F.col("r.part"))
    found = cold.filter("side != 1").alias("l").join(cold.filter("side != 0").alias("r").hint("merge"), sides & ordered & _near(max_bits, check_bits))
    found = found.select(F.struct("l.fp", "l.check_fp").alias("a"), F.struct("r.fp", "r.check_fp").alias("b"))

    # Blocks of hot keys: a left row meets all right blocks, and the other way round.
    dealt = variants.join(hot, ["tag", "part"]).withColumn("own", F.expr("cast(pmod(xxhash64(fp, check_fp), blocks) as int)"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    one = dealt.filter("side != 1").withColumn("i", F.col("own")).withColumn("j", every).filter("tag < 64 or j >= i").withColumn("right", F.lit(False))
    two = dealt.filter("side != 0").withColumn("j", F.col("own")).withColumn("i", every).filter("tag < 64 or j >= i").withColumn("right", F.lit(True))
    cols = ["tag", "part", "i", "j", "right", "fp", "check_fp"]

    def meet(table: pa.Table) -> pa.Table:
        both = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("fp", "check_fp")], 1)
        on_right = np.asarray(table.column("right").to_pylist(), bool)
        rows = np.concatenate([both[~on_right], both[on_right]])
        pairs = np.array(_forest(both[~on_right].view(np.uint64), both[on_right].view(np.uint64), max_bits, check_bits), np.int64).reshape(-1, 2)
        a, b = rows[pairs[:, 0]], rows[pairs[:, 1]]
        return pa.table({"a_fp": a[:, 0], "a_check": a[:, 1], "b_fp": b[:, 0], "b_check": b[:, 1]})

    blocked = one.select(cols).unionByName(two.select(cols)).groupBy("tag", "part", "i", "j").applyInArrow(meet, "a_fp long, a_check long, b_fp long, b_check long")
    pair = lambda s: F.struct(F.col(f"{s}_fp").alias("fp"), F.col(f"{s}_check").alias("check_fp")).alias(s)
    return found.union(blocked.select(pair("a"), pair("b"))).filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of an edge table (a, b): one root for each component.

    Each round every node moves to the neighbour (or itself) of least hash, another hash each
    round, and the graph contracts; the expected number of rounds is logarithmic.
    """
    edges, moves, used = stored(edges.select("a", "b"), "edges"), [], []
    while not edges.isEmpty():
        rank = F.min(F.struct(F.xxhash64(F.lit(len(moves)), "to").alias("h"), "to")).alias("least")
        ways = [("a", "b"), ("b", "a"), ("a", "a"), ("b", "b")]
        near = edges.select(F.explode(F.array(*[F.struct(F.col(x).alias("node"), F.col(y).alias("to")) for x, y in ways])).alias("e")).select("e.*")
        move = stored(near.groupBy("node").agg(rank).select("node", F.col("least.to").alias("root")), "moves")
        moves.append(move)
        at = lambda s: move.select(F.col("node").alias(s), F.col("root").alias(f"{s}_root"))  # noqa: E731, B023
        before = edges
        edges = edges.join(at("a"), "a").join(at("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
        used.append(before)
        edges = stored(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    out = moves[0] if moves else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for move in moves[1:]:
        step = move.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = out.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    out = stored(out, "roots")
    discard(edges, *used, *moves)
    return out


#: A fingerprint with more than one row in so many is joined by broadcast: there are fewer of
#: these than this number, whatever the table.
HOT_SHARE = 10_000


def near_duplicates(prints: DataFrame, max_bits: int = 3, check_bits: int = 64) -> DataFrame:
    """``prints`` (doc_id, fp, check_fp, any more) with component_id: the least doc_id that is
    reachable over links of at most ``max_bits`` (and ``check_bits``) differing bits.

    Rows without a doc_id get the least id of their component, null if it has none. Equal
    fingerprints always link, those of null and empty texts (0) too; repeated rows and ties all
    stay and share a component; an empty table gives no rows; more columns pass through. Very
    common fingerprints are joined by broadcast, so their rows stay where they are.
    """
    key = ["fp", "check_fp"]
    nodes = stored(prints.groupBy(key).agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "fingerprints")
    found = links(nodes.select(key), max_bits, check_bits)
    roots = components(found)
    placed = roots.select("node.fp", "node.check_fp", "root").join(nodes, key)
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = stored(placed.join(least, "root").select("fp", "check_fp", "component_id"), "components")
    named = stored(nodes.join(moved, key, "left").select("fp", "check_fp", "copies", F.coalesce("component_id", "least").alias("component_id")), "components")
    discard(moved, nodes, roots)
    total = named.agg(F.sum("copies")).first()[0] or 0
    hot = F.col("copies") * HOT_SHARE > total
    common = F.broadcast(named.filter(hot).drop("copies"))
    rare = prints.join(common.select(key), key, "left_anti").join(named.filter(~hot).drop("copies"), key)
    return prints.join(common, key).unionByName(rare)


#: The near-duplicate stage: segments of a wide fingerprint over distinct words, and their bits.
SEGMENTS, SEGMENT_BITS = 10, 30
#: Words of the second fingerprint, over the shingles. Of the 64 bits of its first word, nine or ten
#: differ between texts with a similarity of 0.8, in one case of a hundred thousand more than
#: CHECK_BITS; of all 1,024 some 155 do, and seldom more than WIDE_BITS, four standard deviations
#: above that, if the sets aren't small. Of texts that share nothing half of the bits do.
CHECK_WORDS, CHECK_BITS, WIDE_BITS, SMALL_SET = 16, 22, 201, 40
#: Rounds of links to one member of each key before the pairs left are held against each other in
#: blocks of at most so many texts and shingles.
STAR_ROUNDS, BLOCK_ROWS, BLOCK_SHINGLES = 2, 256, 1 << 21
#: Pairs for each text of a segment and its neighbours beyond which these meet in blocks.
CROWDED_PAIRS = 16
_GOLDEN, _MIX = 0x9E3779B97F4A7C15, np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
_BITS_OF_BYTE = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.float32)
_HASH = "__simhash_text"


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Distinct 64-bit hashes of word shingles in order; a shorter text is one shingle."""
    shingles = list(map(b" ".join, zip(*(words[k:] for k in range(size))))) if len(words) >= size else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles)))


def _majority(hashes: np.ndarray, ways: int) -> np.ndarray:
    """For each of 64 * ways bits whether it is set in over half of the hashes; every 64 bits
    come from another mixing of the hashes. Bits are counted by way of the values of each byte."""
    counts, turns = np.zeros((ways * 8, 8)), np.array([_GOLDEN * k & (1 << 64) - 1 for k in range(ways)], np.uint64)
    for at in range(0, len(hashes), _WAY):
        z = hashes[at : at + _WAY, None] + turns
        z = (z ^ z >> np.uint64(30)) * _MIX[0]
        z = (z ^ z >> np.uint64(27)) * _MIX[1]
        z ^= z >> np.uint64(31)
        cells = z.view(np.uint8).reshape(-1, ways * 8) + 256 * np.arange(ways * 8)
        counts += np.bincount(cells.ravel(), minlength=ways * 2048).reshape(-1, 256).astype(np.float32) @ _BITS_OF_BYTE
    return (2 * counts > len(hashes)).ravel()


def word_segments(words: list[bytes], segments: int = SEGMENTS, bits: int = SEGMENT_BITS) -> list[int]:
    """A fingerprint over the distinct words, cut into segments of at most 54 bits."""
    distinct = set(words)
    set_ = _majority(np.fromiter(map(xxhash.xxh64_intdigest, distinct, repeat(SEED)), np.uint64, len(distinct)), -(-segments * bits // 64))
    return (set_[: segments * bits].reshape(segments, bits) @ (1 << np.arange(bits, dtype=np.int64))).tolist()


def _prints(rows: DataFrame, words: int, segments: int, bits: int) -> DataFrame:
    """doc_id and text hash of each row; identity (two hashes) and size of its shingle set, the
    segments of its fingerprint and a second, wide fingerprint over the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cut = [words_of(t) for t in batch.column(2).to_pylist()]
            sets = [shingle_hashes(w, words) for w in cut]
            same = np.array([[xxhash.xxh64_intdigest(h.tobytes(), seed) for seed in (0, 1)] for h in sets], np.uint64).reshape(-1, 2).view(np.int64)
            check = [np.packbits(_majority(h, CHECK_WORDS), bitorder="little").view(np.int64) for h in sets]
            arrays = [pa.array(same[:, 0].copy()), pa.array(same[:, 1].copy()), pa.array([len(h) for h in sets], pa.int64()), pa.array(check, pa.list_(pa.int64())), pa.array([word_segments(w, segments, bits) for w in cut], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["doc_id", "hash", "id_a", "id_b", "size", "check", "segments"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, hash long, id_a long, id_b long, size long, check array<long>, segments array<long>")


def _whole(nodes: DataFrame) -> DataFrame:
    """Every node (with size, check and label) under each of its whole segments, ``value``."""
    cut = nodes.select("node", "size", "check", "label", "segments", F.posexplode("segments").alias("segment", "bits"))
    value = F.expr("shiftleft(cast(segment as bigint), 56)").bitwiseOR(F.col("bits"))
    return cut.select(value.alias("value"), "node", "size", "check", "label", "segments")


def _neighbours(cut: DataFrame, bits: int) -> DataFrame:
    """Pairs of whole segments (small, large, by their numbers of texts, and these, n_small and
    n_large) that differ in a bit, or in one bit each from what both are without it, and that hold
    texts of different labels.

    ``cut``: texts under their whole segments. Each distinct segment stands under its own value
    and under it with each set bit struck out. Of two that differ in one bit, one holds 0 there
    and stands under its own value, and the other one with its 1 struck out gives that value too.
    A crowd of texts under one segment is one row here.
    """
    held = stored(cut.groupBy("value").agg(F.count("*").alias("n"), F.min("label").alias("x"), F.max("label").alias("y")), "dedup-segments")
    struck = held.withColumn("bit", F.explode(F.sequence(F.lit(-1), F.lit(bits - 1)))).filter("bit < 0 or (shiftright(value, bit) & 1) = 1")
    keyed = struck.select(F.expr("if(bit < 0, value, value & ~shiftleft(1L, bit))").alias("key"), "value", "n", "x", "y")
    several = keyed.groupBy("key").agg(F.min("value").alias("v"), F.max("value").alias("w"), F.min("x").alias("x"), F.max("y").alias("y"))
    several = stored(several.filter("v != w and x != y").select("key"), "dedup-keys")
    shared = stored(keyed.join(hinted(several), "key"), "dedup-variants")
    # A key has at most one value for each bit and its own.
    order = (F.struct("l.n", "l.value") < F.struct("r.n", "r.value")) & (F.least("l.x", "r.x") != F.greatest("l.y", "r.y"))
    pairs = shared.alias("l").join(shared.alias("r"), (F.col("l.key") == F.col("r.key")) & order)
    out = stored(pairs.select(F.col("l.value").alias("small"), F.col("r.value").alias("large"), F.col("l.n").alias("n_small"), F.col("r.n").alias("n_large")).distinct(), "dedup-neighbours")
    discard(held, several, shared)
    return out


def _crowded(near: DataFrame) -> DataFrame:
    """The large segments (``large``) that have far more pairs of texts with their neighbours than
    texts, stored."""
    of = near.groupBy("large").agg(F.sum(F.col("n_small") * F.col("n_large")).alias("pairs"), (F.sum("n_small") + F.max("n_large")).alias("texts"))
    return stored(of.filter(F.col("pairs") > CROWDED_PAIRS * F.col("texts")).select("large"), "dedup-crowded")


def _likely(cut: DataFrame, near: DataFrame, similarity: float) -> DataFrame:
    """Pairs (left and right: structs of node and label) of texts in neighbouring segments
    (``near``) that have no whole segment in common, lie in different groups and are alike by size
    and second fingerprint. Large segments are met in blocks."""
    blocks = F.ceil(F.col("n_large") / BLOCK_ROWS).cast("int")
    asked = stored(near.select("small", "large", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block")), "dedup-neighbours")
    wanted = stored(near.select("large", blocks.alias("blocks")).distinct(), "dedup-neighbours")
    small = cut.select(F.col("value").alias("small"), "node", "size", "check", "label", "segments").join(hinted(asked), "small")
    large = cut.select(F.col("value").alias("large"), "node", "size", "check", "label", "segments").join(hinted(wanted), "large").withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    # A pair that meets in several segments counts in the first; one with a whole segment in common
    # has been tested.
    here = F.shiftright("l.small", 56).cast("int")
    meets = lambda x, y: (F.bit_count(x.bitwiseXOR(y)) == 1) | ((F.bit_count(x.bitwiseXOR(y)) == 2) & (F.bit_count(x) == F.bit_count(y)))
    both = lambda f: F.zip_with("l.segments", "r.segments", f)
    once = ~F.exists(both(lambda x, y: x == y), lambda x: x) & ~F.exists(F.slice(both(meets), F.lit(1), here), lambda x: x)
    met = small.alias("l").join(large.alias("r"), (F.col("l.large") == F.col("r.large")) & (F.col("l.block") == F.col("r.block")) & _in_reach(similarity) & once)
    ends = [F.struct(F.col(f"{s}.node").alias("node"), F.col(f"{s}.label").alias("label")) for s in ("l", "r")]
    out = stored(met.select(F.least(*ends).alias("left"), F.greatest(*ends).alias("right")).distinct(), "dedup-pairs")
    discard(asked, wanted)
    return out


def _sets(docs: DataFrame, wanted: DataFrame, words: int, repeats: bool) -> DataFrame:
    """node and the shingle hashes of the texts of ``wanted`` (node, doc_id, hash), stored."""
    asked = hinted(wanted.select("node", F.col("doc_id").alias("__id"), F.col("hash").alias("__of")))
    found = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col(_HASH) == F.col("__of"))).select("node", "text")
    if repeats:
        found = found.dropDuplicates(["node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            hashed = [shingle_hashes(words_of(t), words).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashed, pa.list_(pa.int64()))], names=["node", "shingles"])

    return stored(found.mapInArrow(run, "node long, shingles array<long>"), "dedup-sets")


def _in_reach(similarity: float) -> Column:
    """What two texts of different groups and that similarity fulfil by the sizes of their sets and
    by fingerprint."""
    fits = F.least("l.size", "r.size") >= similarity * F.greatest("l.size", "r.size") - 1e-9
    apart = [F.bit_count(F.get("l.check", F.lit(k)).bitwiseXOR(F.get("r.check", F.lit(k)))) for k in range(CHECK_WORDS)]
    wide = (F.least("l.size", "r.size") < SMALL_SET) | (sum(apart[1:], apart[0]) <= WIDE_BITS)
    return (F.col("l.label") != F.col("r.label")) & fits & (apart[0] <= CHECK_BITS) & wide


def _holding(pairs: DataFrame, sets_of, similarity: float) -> DataFrame:
    """The labels (a, b) of the pairs (left and right: structs of node and label) whose whole
    shingle sets are that similar, stored."""
    likely = stored(pairs.distinct(), "dedup-likely")
    sets = sets_of(likely.select(F.explode(F.array("left.node", "right.node")).alias("node")).distinct())
    side = lambda s: sets.select(F.col("node").alias(f"{s}_node"), F.col("shingles").alias(f"{s}_set"))
    shared = F.size(F.array_intersect("left_set", "right_set"))
    both = likely.select(*[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("left", "right") for c in ("node", "label")]).join(side("left"), "left_node").join(side("right"), "right_node")
    held = both.filter(shared >= similarity * (F.size("left_set") + F.size("right_set") - shared) - 1e-9)
    found = stored(held.select(F.col("left_label").alias("a"), F.col("right_label").alias("b")).distinct(), "dedup-links")
    discard(likely, sets)
    return found


def _meeting(similarity: float):
    """A function of the rows of one pair of blocks (key, i, j, own, node, label, size, check,
    shingles and, of neighbouring segments, segments): a spanning forest of the links of their
    labels, found on whole sets, never the pairs. Rows of one block meet each other, rows of two
    blocks those of the other one."""

    def once(mine: np.ndarray, others: np.ndarray, here: int) -> np.ndarray:
        """What ``_likely`` asks for: no whole segment in common, none met in before this one."""
        apart = np.bitwise_count(mine ^ others)
        meets = (apart == 1) | ((apart == 2) & (np.bitwise_count(mine) == np.bitwise_count(others)))
        return ~(apart == 0).any(1) & ~meets[:, :here].any(1)

    def meet(table: pa.Table) -> pa.Table:
        col = lambda c: table.column(c).to_numpy()
        wide = lambda c: np.ascontiguousarray(table.column(c).combine_chunks().flatten().to_numpy()).view(np.uint64).reshape(len(table), -1)
        own, size, check = col("own"), col("size"), wide("check")
        segments = wide("segments") if "segments" in table.column_names else None
        sets = [np.asarray(x.values, np.int64) for x in table.column("shingles")]
        group = {x: x for x in col("label").tolist()}

        def root(x):
            while group[x] != x:
                group[x] = x = group[group[x]]
            return x

        label, out = col("label").tolist(), []
        apart, here = table.column("i")[0].as_py() != table.column("j")[0].as_py(), table.column("key")[0].as_py() >> 56
        for a in range(len(label)):
            bits = np.bitwise_count(check[a] ^ check)
            near = (bits[:, 0] <= CHECK_BITS) & ((np.minimum(size[a], size) < SMALL_SET) | (bits.sum(1, dtype=np.int64) <= WIDE_BITS))
            near &= np.minimum(size[a], size) >= similarity * np.maximum(size[a], size) - 1e-9
            near &= (own > own[a]) if apart else (np.arange(len(label)) > a)
            found = np.flatnonzero(near)
            if segments is not None and len(found):
                found = found[once(segments[a], segments[found], here)]
            for b in found.tolist():
                if root(label[a]) == root(label[b]):
                    continue
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if both >= similarity * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                    out.append((label[a], label[b]))
                    group[root(label[a])] = root(label[b])
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return meet


def _blocks() -> Column:
    return F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks")


def _met_in_blocks(members: DataFrame, sets_of, similarity: float) -> DataFrame:
    """Links (of labels) within crowded keys: members are dealt into blocks, each pair of blocks is a
    task that returns a forest of the links it finds."""
    blocks = stored(members.groupBy("key").agg(_blocks()), "dedup-blocks")
    sets = sets_of(members.select("node").distinct())
    dealt = members.join(blocks, "key").withColumn("own", F.expr("cast(pmod(xxhash64(node), blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label", "size", "check").join(sets, "node")
    found = stored(dealt.groupBy("key", "i", "j").applyInArrow(_meeting(similarity), "a long, b long"), "dedup-links")
    discard(blocks, sets)
    return found


def _met_across(cut: DataFrame, near: DataFrame, crowded: DataFrame, sets_of, similarity: float) -> DataFrame:
    """Links (of labels) between the texts of crowded segments and those of their neighbours: the
    texts of either side are dealt into blocks, each block of one side and of the other is a task
    that returns a forest of the links it finds. So a text is read as often as the other side has
    blocks, and the pairs are written nowhere."""
    rows = lambda to, side: cut.join(hinted(to), "value").select("key", F.lit(side).alias("own"), "node", "label", "size", "check", "segments")
    asked = stored(near.join(hinted(crowded), "large").select(F.col("small").alias("value"), F.col("large").alias("key")), "dedup-neighbours")
    wanted = crowded.select(F.col("large").alias("value"), F.col("large").alias("key"))
    members = stored(rows(asked, 0).unionByName(rows(wanted, 1)), "dedup-members")
    blocks = members.groupBy("key", "own").agg(_blocks())
    here, there = blocks.select("key", "own", "blocks"), blocks.select("key", (1 - F.col("own")).alias("own"), F.col("blocks").alias("others"))
    blocks = stored(here.join(there, ["key", "own"]), "dedup-blocks")
    sets = sets_of(members.select("node").distinct())
    dealt = members.join(blocks, ["key", "own"]).withColumn("at", F.expr("cast(pmod(xxhash64(node), blocks) as int)")).withColumn("to", F.explode(F.expr("sequence(0, others - 1)")))
    # Blocks of the second side have numbers below 0.
    i, j = (F.when(F.col("own") == own, F.col(near)).otherwise(F.col(far)) for own, near, far in ((0, "at", "to"), (1, "at", "to")))
    dealt = dealt.select("key", i.alias("i"), (-1 - j).alias("j"), "own", "node", "label", "size", "check", "segments").join(sets, "node")
    found = stored(dealt.groupBy("key", "i", "j").applyInArrow(_meeting(similarity), "a long, b long"), "dedup-links")
    discard(asked, members, blocks, sets)
    return found


def _members(cut: DataFrame) -> DataFrame:
    """Members (key, node, size, check, label) of the segments that several texts share, stored;
    of segments with the same members one."""
    keyed = cut.withColumnRenamed("value", "key").drop("segments")
    several = stored(keyed.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y").select("key"), "dedup-keys")
    held = stored(keyed.join(hinted(several), "key"), "dedup-members")
    alike = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"s{k}") for k in (0, 1)]
    one = stored(held.groupBy("key").agg(F.count("*").alias("n"), *alike).groupBy("n", "s0", "s1").agg(F.min("key").alias("key")).select("key"), "dedup-keys")
    members = stored(held.join(hinted(one), "key"), "dedup-members")
    discard(several, held, one)
    return members


def _relabelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the root of each label in its place."""
    step = hinted(roots.select(F.col("node").alias("label"), "root"))
    return rows.join(step, "label", "left").withColumn("label", F.coalesce("root", "label")).select(*rows.columns)


def _stars(members: DataFrame, maps: list[DataFrame], sets_of, similarity: float, rounds: int) -> DataFrame:
    """Holds every member of a key against one of them, some rounds; what labels become by each
    round is added to ``maps``. Members of the keys that are still open come back."""
    for _ in range(rounds):
        if members.isEmpty():
            break
        first = F.min(F.struct(F.xxhash64("node").alias("h"), "node", "size", "check", "label")).alias("c")
        centre = stored(members.groupBy("key").agg(first).select("key", "c.node", "c.size", "c.check", "c.label"), "dedup-centres")
        ends = [F.struct(F.col(f"{s}.node").alias("node"), F.col(f"{s}.label").alias("label")) for s in ("l", "r")]
        pairs = members.alias("l").join(centre.alias("r"), (F.col("l.key") == F.col("r.key")) & _in_reach(similarity)).select(F.least(*ends).alias("left"), F.greatest(*ends).alias("right"))
        links = _holding(pairs, sets_of, similarity)
        roots = components(links)
        maps.append(roots)
        # The centres have been held against all others of their keys.
        left = stored(_relabelled(members.join(centre.select("key", "node"), ["key", "node"], "left_anti"), roots), "dedup-members")
        open_ = stored(left.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y").select("key"), "dedup-keys")
        discard(members, centre, links)
        members = stored(left.join(hinted(open_), "key"), "dedup-members")
        discard(left, open_)
    return members


def similar_roots(nodes: DataFrame, sets_of, similarity: float, bits: int) -> DataFrame:
    """``node, root`` for every text with another in its component of candidate pairs of at least
    that Jaccard similarity. Candidates share a key, one segment that differs in a bit at most.

    Whole segments come first. Of each, every member is held against one other, which joins large
    groups of copies, and what is left of crowded ones after some rounds is compared in blocks;
    then no pair that shares a whole segment is open. Then come segments struck by one bit: these
    are paired by value, so a crowd under a segment counts once, and only pairs of values with
    texts of different groups are looked into: of crowded values in blocks, too, of the others pair
    by pair, at most ``CROWDED_PAIRS`` for each text of a value and its neighbours. No candidate is dropped, every link is verified,
    and pairs that links found before join need no test. Each round links groups found before, so
    components are taken of ever smaller graphs.
    """
    maps: list[DataFrame] = []
    start = nodes.withColumn("label", F.col("node"))
    members = _stars(_members(_whole(start)), maps, sets_of, similarity, STAR_ROUNDS)
    if not members.isEmpty():
        links = _met_in_blocks(members, sets_of, similarity)
        maps.append(components(links))
        discard(links)
    joined = stored(reduce(_relabelled, maps, start), "dedup-nodes")
    near = _neighbours(_whole(joined).select("value", "label"), bits)
    crowded = _crowded(near)
    if not crowded.isEmpty():
        links = _met_across(_whole(joined), near, crowded, sets_of, similarity)
        maps.append(components(links))
        before, joined = joined, stored(_relabelled(joined, maps[-1]), "dedup-nodes")
        discard(before, links)
    pairs = _likely(_whole(joined), near.join(hinted(crowded), "large", "left_anti"), similarity)
    links = _holding(pairs, sets_of, similarity)
    last = components(links)
    moved = stored(_relabelled(joined.select("node", "label"), last).filter("node != label"), "dedup-moved")
    roots = stored(moved.select("node", F.col("label").alias("root")).union(moved.select("label", "label").distinct()), "roots")
    discard(members, joined, near, crowded, pairs, links, last, moved, *maps)
    return roots


def deduplicated(docs: DataFrame, words: int = 5, similarity: float = 0.8, segments: int = SEGMENTS, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the least doc_id.

    Texts link if some segment of their fingerprints differs by at most one bit and the Jaccard
    similarity of their word shingles is at least ``similarity`` on whole texts of any length.
    Texts that are equal but for case and white space always link, empty and null ones with each
    other. Rows without a doc_id are kept only if their group has no other; of rows that tie in
    doc_id that with the least text hash stays, of repeated rows one. An empty table gives no
    rows; other columns pass through whatever their names.

    ``docs`` is read several times and never written; small tables of numbers are.
    """
    rows = docs.select(F.col("doc_id"), F.xxhash64(F.col("text").cast("string")).alias(_HASH), F.struct(*docs.columns).alias("__row"))
    narrow = rows.select("doc_id", _HASH, F.col("__row.text").cast("string").alias("text"))
    prints = stored(_prints(narrow, words, segments, segment_bits), "dedup-prints")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    like = F.first(F.struct("size", "check", "segments")).alias("like")
    classes = prints.groupBy("id_a", "id_b").agg(F.min(row).alias("first"), F.count("*").alias("n"), like)
    classes = stored(classes.select(F.monotonically_increasing_id().alias("node"), "id_a", "id_b", "first", "n", "like.*"), "dedup-nodes")
    repeated = stored(prints.groupBy("doc_id", "hash").count().filter("count > 1").select("doc_id", "hash"), "dedup-repeated")
    repeats = not repeated.isEmpty()

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = stored(classes.select("node", "first.doc_id", "first.hash").join(hinted(ids), "node"), "dedup-wanted")
        found = _sets(narrow, wanted, words, repeats)
        discard(wanted)
        return found

    roots = similar_roots(classes.select("node", "size", "check", "segments"), sets_of, similarity, segment_bits)
    placed = stored(classes.select("node", "id_a", "id_b", "first", "n").join(hinted(roots), "node", "left").filter("root is not null or n > 1").withColumn("root", F.coalesce("root", "node")), "dedup-placed")
    kept = placed.groupBy("root").agg(F.min("first").alias("keep"))
    groups = stored(placed.join(kept, "root").select("id_a", "id_b", F.col("keep.doc_id").alias("keep_id"), F.col("keep.hash").alias("keep_hash")), "dedup-groups")
    gone = prints.join(hinted(groups), ["id_a", "id_b"]).filter(~(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("hash") == F.col("keep_hash"))))
    removed = stored(gone.select("doc_id", "hash").distinct(), "dedup-removed")
    discard(prints, classes, roots, placed, groups)
    named = lambda t: hinted(t.select(F.col("doc_id").alias("__id"), F.col("hash").alias("__of")))
    at = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col(_HASH) == F.col("__of"))
    out = rows.join(named(removed), at, "left_anti")
    if repeats:
        again = named(repeated)
        once = out.join(again, at, "left_semi").groupBy("doc_id", _HASH).agg(F.first("__row").alias("__row"))
        return out.join(again, at, "left_anti").select("__row.*").unionByName(once.select("__row.*"))
    return out.select("__row.*")
