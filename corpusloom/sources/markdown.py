"""Notes in markdown: sections, windows of words and of lines, headings, frontmatter."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_SCHEMA = "path string, chunk int, heading string, start_line int, end_line int, content string, content_hash string"


def split_frontmatter(text: str) -> tuple[str, int]:
    """(body, lines before it)"""
    m = re.match(r"\A---\r?\n(.*?\r?\n)?---[^\S\n]*(?:\r?\n|\Z)", text, re.S)
    return (text[m.end() :], text[: m.end()].count("\n")) if m else (text, 0)


def headings(lines: list[str]) -> list[tuple[int, int, str]]:
    """(line, level, text) of headings outside fences."""
    out, fence = [], None
    for i, line in enumerate(lines):
        f = re.match(r"\s*(```|~~~)", line)
        if f:
            fence = None if fence == f[1] else fence or f[1]
        elif not fence and (m := re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line)):
            out.append((i, len(m[1]), m[2]))
    return out


def windows(text: str, most_words: int, overlap: int) -> list[str]:
    """Paragraphs packed up to ``most_words``; longer ones by sentences; the last ``overlap`` sentences come again."""
    units = []
    for p in re.split(r"\n\s*\n", text):
        if p.strip():
            units += [p.strip()] if len(p.split()) <= most_words else [s for s in re.split(r"(?<=[.!?])\s+", p.strip()) if s]
    out, now, n = [], [], 0
    for u in units:
        k = len(u.split())
        if now and n + k > most_words:
            out.append("\n\n".join(now))
            tail = re.split(r"(?<=[.!?])\s+", out[-1])[-overlap:] if overlap else []
            now, n = ([" ".join(tail)], sum(len(t.split()) for t in tail)) if tail and sum(len(t.split()) for t in tail) + k <= most_words else ([], 0)
        now.append(u)
        n += k
    return [*out, "\n\n".join(now)] if now else out


def chunk_note(text: str, most_words: int = 380, overlap: int = 1) -> list[tuple[str, int, int, str]]:
    """(heading path, first line, last line, content) of a note's chunks; text before the first heading goes where headings exist."""
    body, skipped = split_frontmatter(text or "")
    lines = body.split("\n")
    found = headings(lines)
    sections = []
    if not found:
        sections.append(("", 0, len(lines)))
    stack: list[str] = []
    for k, (i, level, title) in enumerate(found):
        del stack[level - 1 :]
        stack.append(title)
        sections.append((" > ".join(stack), i, found[k + 1][0] if k + 1 < len(found) else len(lines)))
    out = []
    for path, a, b in sections:
        for w in windows("\n".join(lines[a:b]), most_words, overlap):
            out.append((path, skipped + a + 1, skipped + b, w))
    return out


def section_chunks(notes: DataFrame, most_words: int = 380, overlap: int = 1) -> DataFrame:
    """CHUNK_SCHEMA of notes (path, body); the content hash is md5."""

    def chunk(batches):
        for b in batches:
            rows = [(p, i, *c) for p, t in zip(b["path"], b["body"], strict=True) for i, c in enumerate(chunk_note(t, most_words, overlap))]
            yield pd.DataFrame(rows, columns=["path", "chunk", "heading", "start_line", "end_line", "content"])

    return notes.select("path", "body").mapInPandas(chunk, CHUNK_SCHEMA.removesuffix(", content_hash string")).withColumn("content_hash", F.md5("content"))


def line_windows(notes: DataFrame, size: int = 200) -> DataFrame:
    """(path, window, heading, lines, content, next): windows of ``size`` lines, with the first heading in each."""
    lines = notes.select("path", F.posexplode(F.split("body", "\r?\n")).alias("pos", "line"))
    w = F.floor(F.col("pos") / size).cast("int")
    grouped = lines.groupBy("path", w.alias("window")).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    text = F.transform("l", lambda x: x["line"])
    first = F.try_element_at(F.filter(text, lambda x: x.rlike(r"^#{1,6}\s+")), F.lit(1))
    counted = notes.select("path", F.ceil(F.size(F.split("body", "\r?\n")) / size).cast("int").alias("_n"))
    return grouped.join(counted, "path").select("path", "window", F.regexp_replace(first, r"^#{1,6}\s+", "").alias("heading"), F.size("l").alias("lines"), F.array_join(text, "\n").alias("content"), F.when(F.col("window") + 1 < F.col("_n"), F.col("window") + 1).alias("next"))


def read_tables(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """(sheet, row, cells) of CSV or TSV files for ``table_markdown``; a sheet is a file's name. Quoted cells may hold separators and line breaks."""
    rows = spark.read.option("sep", separator).option("multiLine", True).option("escape", '"').csv(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^.]*$", 1)
    return rows.select(name.alias("sheet"), F.monotonically_increasing_id().alias("row"), F.array(*(F.col(c) for c in rows.columns)).alias("cells"))


def table_markdown(rows: DataFrame, sheet: str, row: str, cells: str) -> DataFrame:
    """A markdown section for each sheet: boundary empty rows go, pipes and line breaks are escaped."""
    clean = F.transform(cells, lambda c: F.regexp_replace(F.replace(F.coalesce(F.trim(c), F.lit("")), F.lit("|"), F.lit("\\|")), r"\r?\n", "<br>"))
    kept = rows.withColumn("_c", clean).withColumn("_w", F.coalesce(F.array_max(F.transform(F.col("_c"), lambda c, i: F.when(c != "", i + 1).otherwise(0))), F.lit(0)))
    g = kept.groupBy(sheet).agg(F.max("_w").alias("_w"), F.min(F.when(F.col("_w") > 0, F.col(row))).alias("_a"), F.max(F.when(F.col("_w") > 0, F.col(row))).alias("_b"), F.array_sort(F.collect_list(F.struct(F.col(row).alias("r"), F.col("_c").alias("c")))).alias("_rows"))
    line = lambda x: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(1), F.col("_w")), lambda i: F.coalesce(F.try_element_at(x["c"], i), F.lit(""))), " | "), F.lit(" |"))
    body = F.transform(F.filter("_rows", lambda x: x["r"].between(F.col("_a"), F.col("_b"))), line)
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("_w")))
    return g.where("_w > 0").select(sheet, F.concat(F.lit("## Sheet: "), F.col(sheet), F.lit("\n\n"), F.array_join(F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, F.lit(2), F.size(body))), "\n")).alias("markdown"))
