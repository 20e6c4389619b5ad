"""Names, paths and patterns of files as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder(path: Column) -> Column:
    """Empty for files at the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(name(path), r"\.([^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), r"\.[^.]*$", "")


def note_of_chunk(chunk: Column) -> Column:
    """The path of a chunk id, before its last #."""
    return F.regexp_replace(chunk, "#[^#]*$", "")


def in_folder(path: Column, wanted: Column) -> Column:
    """Whether some part of the path is the wanted name, in any case."""
    return F.array_contains(F.split(F.lower(path), "/"), F.lower(wanted))


def holds_parts(path: Column, wanted: Column) -> Column:
    """Whether the parts of ``wanted`` are parts of the path in that order, in any case; the root holds all paths.

    A part that is wanted twice in a row is met by one part of the path.
    """
    parts = F.split(F.regexp_replace(F.lower(wanted), "^/|/$", ""), "/")
    have = F.split(F.lower(path), "/")
    # The place from which the next part is looked for: at the part met last, or 0 once one is missing.
    step = lambda at, part: F.when(at > 0, F.coalesce(F.nullif(F.array_position(F.slice(have, F.greatest(at, F.lit(1)), F.size(have)), part), F.lit(0)) + at - 1, F.lit(0))).otherwise(F.lit(0))
    return (wanted == "/") | (F.aggregate(parts, F.lit(1).cast("long"), lambda at, p: step(at, p).cast("long")) > 0)


def safe(path: Column) -> Column:
    """Neither absolute nor with a part .. in it."""
    return (path != "") & ~F.startswith(path, F.lit("/")) & ~path.rlike(r"(^|/)\.\.(/|$)")


def cache_key(path: Column, size: Column, changed: Column) -> Column:
    return F.md5(F.concat_ws(":", path, size.cast("string"), changed.cast("string")))


def decoded_patterns(setting: Column) -> Column:
    """The patterns of a setting, URI-encoded between commas; empty ones are dropped. A plus sign is a plus sign."""
    parts = F.transform(F.split(setting, ","), lambda p: F.try_url_decode(F.replace(F.trim(p), F.lit("+"), F.lit("%2B"))))
    return F.filter(parts, lambda p: p != "")


def encoded_patterns(patterns: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.transform(patterns, lambda p: F.trim(p)), lambda p: p != ""), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))), ",")


def pattern_kind(pattern: Column) -> Column:
    """tag (#a), extension (*.a), note ([[a]]) or folder."""
    return F.when(F.startswith(pattern, F.lit("#")), "tag").when(F.startswith(pattern, F.lit("*.")), "extension").when(pattern.rlike(r"^\[\[.*\]\]$"), "note").otherwise("folder")


def partition_of(key: Column, partitions: int) -> Column:
    """A rolling hash over the characters' codes, 31 a step with the shift in 32 bits, modulo ``partitions``.

    The shift alone wraps to 32 bits, so the sum can pass them. Characters beyond the basic plane count by their code point.
    """
    codes = F.transform(F.filter(F.split(key, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    wrap = lambda x: F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    total = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: wrap(wrap(h) * 32) - h + c)
    return (F.abs(total) % partitions).cast("int")
