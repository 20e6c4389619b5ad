"""Chunks of notes for lexical search: whole small notes, sections by heading, and split sections with tiny pieces joined.

Sizes are characters. Null and blank notes have no chunks; notes that repeat a path are chunked one by one.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import paths as P
from corpusloom.sources.markdown import headings, split_frontmatter

#: Where a text is split, the first that it holds; the last one splits anywhere.
SEPARATORS = ["\n\n", "\n", ". ", " ", ""]


def split_text(text: str, size: int, separators: list[str] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters: parts between the first separator that occurs, joined again as far as they fit; larger parts are split by the next."""
    at = next(i for i, s in enumerate(separators) if s == "" or s in text)
    separator = separators[at]
    out: list[str] = []
    held: list[str] = []

    def settle() -> None:
        if held:
            out.extend(_packed(held, separator, size))
            held.clear()

    for part in text.split(separator) if separator else list(text):
        if len(part) < size or not separator:
            held.append(part)
        else:
            settle()
            out.extend(split_text(part, size, separators[at + 1 :]))
    settle()
    return out


def _packed(parts: list[str], separator: str, size: int) -> list[str]:
    """Neighbours joined by the separator as long as they fit; blank pieces go, the others are trimmed."""
    groups: list[list[str]] = []
    length = 0
    for p in parts:
        if not p:
            continue
        more = len(p) + (len(separator) if groups and groups[-1] else 0)
        if not groups or length + more > size:
            groups.append([])
            length, more = 0, len(p)
        groups[-1].append(p)
        length += more
    return [x for g in groups if (x := separator.join(g).strip())]


def _slight(body: str) -> bool:
    """Blank, or a heading and nothing else."""
    lines = [x.strip() for x in body.split("\n") if x.strip()]
    return not lines or len(lines) == 1 and bool(re.match(r"#{1,6}\s+\S", lines[0]))


def join_slight(bodies: list[str], size: int) -> list[str]:
    """Slight pieces become the start of the next one, or the end of the one before if they come last, where the result fits ``size``."""
    out: list[str] = []
    rest = list(bodies)
    while rest:
        now = rest.pop(0)
        if rest and _slight(now):
            both = "\n\n".join(x for x in (now.rstrip(), rest[0].lstrip()) if x)
            if len(both) <= size:
                rest[0] = both
                continue
        out.append(now)
    if len(out) > 1 and _slight(out[-1]):
        both = "\n\n".join(x for x in (out[-2].rstrip(), out[-1].lstrip()) if x)
        if len(both) <= size:
            out[-2:] = [both]
    return out


def note_chunks(title: str, text: str | None, most: int = 6000) -> list[tuple[str, str]]:
    """(heading, content) of a note's chunks; each content starts with the note's title.

    A note that fits with its title is one chunk under its first heading. Otherwise each heading's section is, what precedes the first heading
    being part of it; a section that doesn't fit is split.
    """
    if not text or not text.strip():
        return []
    head = f"\n\nNOTE TITLE: [[{title}]]\n\nNOTE BLOCK CONTENT:\n\n"
    body = split_frontmatter(text)[0]
    lines = body.split("\n")
    found = headings(lines)
    if len(head) + len(body) <= most:
        return [(found[0][2] if found else "", head + body)]
    starts = [0, *(i for i, _, _ in found[1:]), len(lines)]
    sections = [(found[k][2] if found else "", "\n".join(lines[a:b]) + ("\n" if b < len(lines) else "")) for k, (a, b) in enumerate(zip(starts, starts[1:], strict=False))]
    out = []
    for heading, section in sections:
        if len(head) + len(section) <= most:
            out.append((heading, head + section))
        else:
            out += [(heading, head + piece) for piece in join_slight(split_text(section, most), most - len(head))]
    return out


def _chunked(most: int, characters: int = 1_000_000):
    """Chunks of batches of notes (path, title, body): few notes are unpacked at a time, and a batch of chunks ends at about ``characters``, however many notes came in one."""

    def chunked(batches):
        held: list[tuple] = []
        size = 0
        for whole in batches:
            for first in range(0, whole.num_rows, 32):
                b = whole.slice(first, 32)
                for p, t, x in zip(*(b.column(c).to_pylist() for c in ("path", "title", "body")), strict=True):
                    for i, (heading, content) in enumerate(note_chunks(t, x, most)):
                        held.append((p, i, heading, content))
                        size += len(content)
                        if size >= characters:
                            yield _batch(held)
                            held, size = [], 0
        if held:
            yield _batch(held)

    return chunked


def _batch(rows: list[tuple]):
    import pyarrow as pa

    types = {"path": pa.string(), "chunk": pa.int32(), "heading": pa.string(), "content": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], list(types))


def lexical_chunks(notes: DataFrame, most: int = 6000) -> DataFrame:
    """(id, path, chunk, title, heading, content, content_hash) of notes (path, body); ids are path#number, hashes md5. Unsafe paths are left out."""
    named = notes.where(P.safe(F.col("path"))).select("path", P.stem(F.col("path")).alias("title"), "body")
    out = named.mapInArrow(_chunked(most), "path string, chunk int, heading string, content string")
    return out.select(F.concat_ws("#", "path", F.col("chunk").cast("string")).alias("id"), "path", "chunk", P.stem(F.col("path")).alias("title"), "heading", "content", F.md5("content").alias("content_hash"))
