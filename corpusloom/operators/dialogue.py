"""Turns, context segments, citations and rescored hits of an assistant's answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.ranking import numbered
from corpusloom.tables import ranged


def turn_pairs(messages: DataFrame, chat: str, turn: str) -> DataFrame:
    """(chat, asked, answered, question, answer) of each user message whose next message is the assistant's.

    Messages are numbered by ranges of their turns and paired by a join, so a very long chat isn't sorted in one task.
    Rows with a null chat or turn pair with nothing; equal turns are ordered by role and text.
    """
    m = messages.select(chat, turn, "role", "text").where(F.col(chat).isNotNull() & F.col(turn).isNotNull())
    placed = numbered(m, [chat], [F.col(turn), F.col("role"), F.col("text")])
    asked = placed.where("role = 'user'").select(chat, F.col(turn).alias("asked"), F.col("text").alias("question"), (F.col("place") + 1).alias("place"))
    answered = placed.where("role = 'assistant'").select(chat, F.col(turn).alias("answered"), F.col("text").alias("answer"), "place")
    return asked.join(answered, [chat, "place"]).drop("place")


def latest_segments(segments: DataFrame, keys: list[str], order: str, content: str) -> DataFrame:
    """The latest content of each segment and the place of its first appearance."""
    return segments.groupBy(*keys).agg(F.max_by(content, order).alias(content), F.min(order).alias("first"))


def renumber_citations(citations: DataFrame, doc: str, pos: str, number: str) -> DataFrame:
    """(doc, number, renumbered): numbers of a document's citations by order of first mention, from 1."""
    first = citations.groupBy(doc, number).agg(F.min(pos).alias("_first"))
    return numbered(first, [doc], [F.col("_first"), F.col(number)]).select(doc, number, F.col("place").alias("renumbered"))


def outermost(blocks: DataFrame, doc: str, start: str = "start", end: str = "end", tie: str = "id") -> DataFrame:
    """Blocks of a document that lie within no other of it; of equal blocks the one with the least ``tie`` stays, of repeated rows one.

    By start and then the longer first, a block lies within another if some block before it reaches as far. Blocks are dealt to ranges of
    that order; the reach of a document's earlier ranges is carried over, so that a very long one isn't sorted in one task.
    """
    placed = ranged(blocks, [F.col(doc)], [F.col(start), F.col(end).desc(), F.col(tie)])
    reach = placed.groupBy(doc, "_range").agg(F.max(end).alias("_m"))
    earlier = Window.partitionBy(doc).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    carried = reach.select(doc, "_range", F.max("_m").over(earlier).alias("_carry"))
    before = Window.partitionBy(doc, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    met = placed.withColumn("_own", F.max(end).over(before)).join(carried, [doc, "_range"])
    furthest = F.greatest("_own", "_carry")
    return met.where(furthest.isNull() | (furthest < F.col(end))).select(*blocks.columns)


def hybrid_scores(lexical: DataFrame, semantic: DataFrame, key: list[str], text_weight: float = 0.5) -> DataFrame:
    """Weighted sum of both scores; a hit of one list only has 0 from the other."""
    weighted = lambda rows, w: rows.select(*key, (F.col("score") * w).alias("score"))
    return weighted(lexical, text_weight).unionByName(weighted(semantic, 1 - text_weight)).groupBy(*key).agg(F.sum("score").alias("score"))


def splice_reranked(hits: DataFrame, query: str, score: str, new: str, tie: str, head: int = 20, limit: int = 30) -> DataFrame:
    """Adds rank: a query's best ``head`` hits by the new score, the others after them as they were; ``limit`` in all.

    A hit of the head without a new score goes behind those with one. Only the best ``limit`` hits by the old score are sorted again.
    """
    old = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), tie))
    kept = hits.withColumn("_old", old).where(F.col("_old") <= limit)
    order = [(F.col("_old") > head).asc(), F.when(F.col("_old") <= head, F.col(new)).desc_nulls_last(), F.col("_old")]
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order))).drop("_old")
