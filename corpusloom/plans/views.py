"""Views of the test tables as notes, links, chunks and memories, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt evenly to tasks: a file of narrow rows is read by few, too few for costly expressions."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, folder, basename, tags, inline_tags, mtime (ms), body, heading (the first one), ord of ``documents``."""
    d = table(spark, sf_dir, "documents")
    folder = F.concat_ws("/", "lang", "source")
    base = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    tags = F.array(F.concat(F.lit("#lang/"), "lang"), F.concat(F.lit("#"), "source"))
    return d.select(F.concat(folder, F.lit("/"), base, F.lit(".md")).alias("path"), folder.alias("folder"), base.alias("basename"), tags.alias("tags"), F.array(F.concat(F.lit("#"), "lang")).alias("inline_tags"), (F.lit(1704067200000) + F.col("doc_id") * 3600000).alias("mtime"), F.col("text").alias("body"), F.regexp_extract("text", r"(?m)^#{1,6}[ \t]+([^\n]+)$", 1).alias("heading"), F.col("doc_id").alias("ord"))


NOTES_SQL = r"""notes AS (SELECT lang || '/' || source || '/doc_' || doc_id || '.md' AS path, lang || '/' || source AS folder, 'doc_' || doc_id AS basename,
  ['#lang/' || lang, '#' || source] AS tags, ['#' || lang] AS inline_tags, 1704067200000 + doc_id * 3600000 AS mtime, text AS body, regexp_extract(text, '(?m)^#{1,6}[ \t]+([^\n]+)$', 1) AS heading, doc_id AS ord FROM documents)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two links from each document, by arithmetic on its id."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    n = d.agg((F.max("doc_id") + 1).alias("n"))
    both = F.array((F.col("doc_id") * 7 + 1) % F.col("n"), (F.col("doc_id") * 11 + 3) % F.col("n"))
    return d.crossJoin(F.broadcast(n)).select(F.col("doc_id").alias("src"), F.explode(both).alias("dst"))


EDGES_SQL = """edges AS (SELECT doc_id AS src, unnest([(doc_id * 7 + 1) % n, (doc_id * 11 + 3) % n]) AS dst
  FROM documents, (SELECT max(doc_id) + 1 AS n FROM documents))"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, text): the whole texts of ``benchmark``."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")


QUESTIONS_SQL = "questions AS (SELECT item_id AS query, text FROM benchmark)"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search hits (query, note, folder, score, ord): documents by a score from their id, for ten queries."""
    n = notes(spark, sf_dir)
    return n.select((F.col("ord") % 10).alias("query"), F.col("ord").alias("note"), "folder", (((F.col("ord") * 37) % 101) / 100.0).alias("score"), "ord")


HITS_SQL = """hits AS (SELECT ord % 10 AS query, ord AS note, folder, ((ord * 37) % 101) / 100.0::DOUBLE AS score, ord FROM notes)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits at chunk level from ``lineitem``: query, note, score, and a row number that is unique."""
    return table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("query"), F.col("l_orderkey").alias("note"), F.col("l_extendedprice").alias("score"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("tie"), F.col("l_partkey").alias("part"))


LINES_SQL = """lines AS (SELECT l_returnflag || l_linestatus AS query, l_orderkey AS note, l_extendedprice AS score, l_orderkey * 100 + l_linenumber AS tie, l_partkey AS part FROM lineitem)"""
