"""What tells the kind of an entity or a relationship: endings, cue words, names within names.

The lists are choices of this engine; the same ones stand in the SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of names by entity type; the first type that fits counts, ``other`` if none does.
TYPE_ENDINGS: dict[str, tuple[str, ...]] = {
    "disease": ("itis", "osis", "emia", "oma", "pathy"),
    "drug": ("mycin", "azole", "statin", "cillin"),
    "organism": ("aceae", "bacter", "virus", "coccus", "us"),
    "protein": ("globin", "kinase", "ase"),
    "gene": ("gene", "genes"),
    "dataset": ("dataset", "corpus", "bank"),
    "metric": ("ity", "ness", "score", "rate", "heit", "keit", "dad"),
    "technique": ("ing", "ung", "graphy", "metry"),
    "tool": ("tor", "meter", "scope", "ware"),
    "method": ("tion", "ción", "sion", "ment", "logy"),
}
CATEGORY_OF: dict[str, str] = {
    "method": "methods_and_approaches",
    "dataset": "data_and_materials",
    "organism": "biological_entities",
    "gene": "biological_entities",
    "protein": "biological_entities",
    "metric": "measurements_and_metrics",
    "disease": "diseases_and_conditions",
    "drug": "drugs_and_compounds",
    "technique": "techniques_and_tools",
    "tool": "techniques_and_tools",
}
#: Words of a section that speak for a kind of relationship between what it mentions.
CUES: dict[str, tuple[str, ...]] = {
    "uses": ("use", "uses", "used", "using"),
    "evaluated_by": ("evaluated", "measured", "benchmarked"),
    "improves": ("improves", "improved", "outperforms"),
    "supports": ("supports", "supported", "confirms"),
    "contradicts": ("contradicts", "contradicted", "refutes"),
    "causes": ("causes", "caused", "induces"),
    "treats": ("treats", "treated"),
    "interacts_with": ("interacts", "interacting", "binds"),
}


def entity_type(name: Column) -> Column:
    out = F.lit("other")
    for kind, endings in reversed(TYPE_ENDINGS.items()):
        fits = F.lit(False)
        for e in endings:
            fits = fits | name.endswith(e)
        out = F.when(fits, kind).otherwise(out)
    return out


def category(kind: Column) -> Column:
    out = F.lit("other")
    for k, c in CATEGORY_OF.items():
        out = F.when(kind == k, c).otherwise(out)
    return out


def told(words: Column) -> Column:
    """The cue words among the words of a section."""
    return F.array_intersect(words, F.array(*[F.lit(w) for ws in CUES.values() for w in ws]))


def cue_bits(told: Column) -> Column:
    """Bit k is set if a section's cue words (``told``) hold one of the k-th kind."""
    bit = lambda k, ws: F.when(F.arrays_overlap(told, F.array(*map(F.lit, ws))), 1 << k).otherwise(0)
    return sum((bit(k, ws) for k, ws in enumerate(CUES.values())), F.lit(0))


def relationship_type(counts: list[Column], source: Column, target: Column) -> Column:
    """The kind with cues in most of the pair's sections, the first of equals; without any cue,
    whether one name holds the other; else mere association."""
    most = F.greatest(*counts)
    out = F.when(F.contains(source, target), "contains").when(F.contains(target, source), "part_of").otherwise("associated_with")
    for kind, n in reversed(list(zip(CUES, counts))):
        out = F.when((most > 0) & (n == most), kind).otherwise(out)
    return out
