"""Guarded rewriting of large context blocks within texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import CONTEXT_BLOCKS
from corpusloom.tables import saved

#: The blocks that are rewritten.
REWRITTEN = ("note_context", "active_note", "url_content", "web-content", "web-search", "selected_text", "embedded_note", "embedded_pdf", "web_tab_context", "active_web_tab", "youtube_video_context")
#: Fixed value: what begins a rewritten content.
MARK = "[SUMMARIZED]"


def block_spans(text: Column, types: tuple[str, ...] = REWRITTEN) -> Column:
    """The outermost blocks of a text by place: array of struct(first, last, type, block), places from 1. A block ends with the first end of its type."""

    def of(kind: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(f"(?s)<{kind}>.*?</{kind}>"), F.lit(0))
        start = F.struct(F.lit(0).alias("upto"), F.array().cast("array<struct<first:int,last:int,type:string,block:string>>").alias("out"))

        def place(s: Column, block: Column) -> Column:
            first = F.call_function("locate", block, text, s["upto"] + 1)
            last = first + F.length(block) - 1
            return F.struct(last.alias("upto"), F.concat(s["out"], F.array(F.struct(first.alias("first"), last.alias("last"), F.lit(kind).alias("type"), block.alias("block")))).alias("out"))

        return F.aggregate(found, start, place)["out"]

    every = F.flatten(F.array(*(of(t) for t in types)))
    return F.transform(F.array(every), lambda e: F.array_sort(F.filter(e, lambda x: ~F.exists(e, lambda o: (o["first"] <= x["first"]) & (o["last"] >= x["last"]) & ((o["first"] < x["first"]) | (o["last"] > x["last"]))))))[0]


def compact(texts: DataFrame, rewrite: Callable[[Column, Column, Column], Column], least: int = 50_000, most: int = 500_000, share: float = 0.5) -> DataFrame:
    """Adds compacted, was_compacted, items and rewritten to ``texts`` (id, text): blocks with ``least`` characters of content or more have it replaced by ``rewrite``.

    ``rewrite(content, title, path)`` is any Column, a UDF too; contents beyond ``most`` characters are cut for it and marked. Null and blank results are failures. A text
    of whose large blocks less than ``share`` succeed stays as it is, as does one without any. Others are spliced from right to left. Each block is a row of its own for
    the rewriting; a text's blocks meet again by its id, which must be unique. Null texts stay null.
    """
    part = lambda b, tag: F.regexp_extract(b, f"<{tag}>([^<]*)</{tag}>", 1)
    spans = texts.select("id", F.posexplode(block_spans(F.col("text"))).alias("n", "b")).select("id", "n", "b.*")
    path = F.when(part(F.col("block"), "path") != "", part(F.col("block"), "path")).otherwise(part(F.col("block"), "url"))
    named = spans.withColumn("path", path).withColumn("content", F.regexp_extract("block", "(?s)<content>(.*?)</content>", 1))
    tail = F.nullif(F.element_at(F.split("path", "/"), -1), F.lit(""))
    named = named.withColumn("title", F.coalesce(F.nullif(part(F.col("block"), "title"), F.lit("")), tail, F.lit("Untitled")))
    counts = named.groupBy("id").agg(F.count("*").alias("items"))
    large = named.where(F.length("content") >= least)
    cut = F.when(F.length("content") > most, F.concat(F.left("content", F.lit(most)), F.lit("\n[TRUNCATED]"))).otherwise(F.col("content"))
    new = F.trim(rewrite(cut, F.col("title"), F.col("path")))
    kinds = [t for t in REWRITTEN if CONTEXT_BLOCKS.get(t) == "url"]
    tag = F.when(F.col("type").isin(kinds), "url").otherwise("path")
    line = lambda name, value: F.when(value != "", F.concat(F.lit("<"), name, F.lit(">"), value, F.lit("</"), name, F.lit(">")))
    times = [line(F.lit(t), part(F.col("block"), t)) for t in ("ctime", "mtime")]
    made = F.concat_ws("\n", F.concat(F.lit("<"), "type", F.lit(">")), line(F.lit("title"), F.col("title")), line(tag, F.col("path")), *times, F.concat(F.lit(f"<content>{MARK}\n"), "new", F.lit("</content>")), F.concat(F.lit("</"), "type", F.lit(">")))
    done = saved(large.withColumn("new", F.nullif(new, F.lit(""))).select("id", "first", "last", F.col("new").isNotNull().alias("fine"), F.when(F.col("new").isNotNull(), made).alias("made")), "rewritten")
    kept = done.groupBy("id").agg(F.count("*").alias("asked"), F.count_if("fine").alias("rewritten"), F.sort_array(F.collect_list(F.when(F.col("fine"), F.struct("first", "last", "made"))), asc=False).alias("parts"))
    kept = kept.where((F.col("rewritten") > 0) & (F.col("rewritten") >= share * F.col("asked"))).select("id", "rewritten", "parts")
    splice = F.aggregate("parts", F.col("text"), lambda t, p: F.concat(F.substring(t, F.lit(1), p["first"] - 1), p["made"], F.substring(t, p["last"] + 1, F.length(t))))
    met = texts.join(kept, "id", "left").join(counts, "id", "left")
    was = F.col("parts").isNotNull()
    return met.select(*texts.columns, F.when(was, splice).otherwise(F.col("text")).alias("compacted"), was.alias("was_compacted"), F.when(was, F.col("items")).otherwise(0).cast("long").alias("items"), F.coalesce("rewritten", F.lit(0)).cast("long").alias("rewritten"))
