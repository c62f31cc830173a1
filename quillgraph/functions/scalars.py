"""Scalar expressions of the engine, all within code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"([\p{L}\p{N}]+)"


def or_default(value: Column, default: str) -> Column:
    """The default for null and for the empty string."""
    return F.when(value.isNull() | (value == ""), F.lit(default)).otherwise(value)


def iso_time(when: Column) -> Column:
    return F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def percent_done(step: Column, steps: int) -> Column:
    """Whole percent after the step of this number (from 0), cut off, not rounded."""
    return F.floor((step + 1) / F.lit(steps) * 100).cast("int")


def has_suffix(name: Column, suffixes: tuple[str, ...]) -> Column:
    """Case counts: ``.PDF`` is not ``.pdf``. Null names have no suffix."""
    found = F.lit(False)
    for s in suffixes:
        found = found | F.coalesce(name.endswith(s), F.lit(False))
    return found


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def arrow_path(path: Column) -> Column:
    return F.array_join(path, " → ")


def display_percent(share: Column) -> Column:
    return F.round(share * 100, 1)


def display_megabytes(size: Column) -> Column:
    return F.round(size / 1024 / 1024, 2)


def stable_id(*parts: Column) -> Column:
    """An id that follows from the contents, so that a retried task makes the same one."""
    return F.md5(F.concat_ws("\x1f", *parts).cast("binary"))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for vectors of no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)
