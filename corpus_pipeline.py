"""A corpus pipeline of five stages over ``documents``: language, exact copies, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the docs
of the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup, langid, mixing, ngram_join, packing
from corpusloom.llm.common import crc_fold, discard, saved, scratch
from corpusloom.llm.queries import TOKENIZERS

#: No SQL: language and near copies come from models and signatures.
ORACLE_SQL = None


def _named(docs: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    return [n + "_" * next(i for i in range(len(taken) + 1) if (n + "_" * i).lower() not in taken) for n in names]


def _one_of_each(docs: DataFrame) -> DataFrame:
    """Of rows that share doc_id and text, one (the least by the other columns). Costs a shuffle only where an id repeats."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if ids.isEmpty():
        return docs
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    least = docs.groupBy("doc_id", "text").agg(F.min(F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(others)))).alias("r"))
    return least.select(*(F.col(c if c in ("doc_id", "text") else f"r.c{others.index(c)}").alias(c) for c in docs.columns))


def _without(docs: DataFrame, dropped: DataFrame, key: Column) -> DataFrame:
    """``docs`` but for those with the doc_id and the key of a row of ``dropped`` (doc_id, key)."""
    mine, theirs, other = _named(docs, "key", "dropped_id", "dropped_key")
    gone = dropped.select(F.col("doc_id").alias(theirs), F.col("key").alias(other))
    left = docs.withColumn(mine, key).join(gone, F.col("doc_id").eqNullSafe(F.col(theirs)) & (F.col(mine) == F.col(other)), "left_anti")
    return left.select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the language model doesn't reject. It learns from the lang column of four fifths of them.

    Null texts and texts without a letter go, and so do all documents where lang is null throughout; rows that repeat are judged
    alike; an empty table stays empty; other columns are kept, whatever their names.
    """
    held_out = crc_fold("doc_id", 5) == 0
    model = langid.fit_languages(docs.select("doc_id", "text", "lang").where(~held_out))
    names = {c: f"c{i}" for i, c in enumerate(x for x in docs.columns if x not in ("doc_id", "text"))}
    kept = langid.predict_language(docs, model, *(F.col(c).alias(n) for c, n in names.items()), keep_text=True).where("not rejected")
    return kept.select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each text, the one with the largest doc_id.

    Null texts count as empty ones; a null doc_id is below all others; of rows that repeat doc_id and text one stays (the least by the
    other columns); an empty table stays empty; other columns are kept, whatever their names.
    """
    found = exact_dedup.exact_dedup(docs, exact_dedup.earlier_half(docs))
    # Rows that repeat doc_id and text are kept or dropped alike.
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return _one_of_each(_without(docs, found.where("not kept").select("doc_id", F.col("text_sha256").alias("key")), sha))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of similar ones, the one with the smallest doc_id.

    Null texts and texts without words are similar to nothing and stay; a null doc_id is below all others; of rows that repeat doc_id and
    text one stays (the least by the other columns); an empty table stays empty; other columns are kept, whatever their names.
    """
    found = ngram_join.similar_documents(docs)
    gone = found.groupBy("doc_id", F.col("text_key").alias("key")).agg(F.bool_or("kept").alias("kept")).where("not kept")
    return _one_of_each(_without(docs, gone, F.xxhash64(F.col("text").cast("string"))))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document appears, whole, as often as the mix takes it; where it takes a part of one, that is rounded to whole copies, at most 3 in all.

    Documents without words (null texts too) are never taken; a null source is a source of its own; rows that repeat doc_id and text are
    documents of their own; an empty table stays empty; other columns are kept, whatever their names.
    """
    key, number, other_id, other_key, other_number, copies, copy = _named(docs, "key", "number", "taken_id", "taken_key", "taken_number", "copies", "copy")
    times = F.floor(F.try_divide(F.col("taken"), F.col("size")) + 0.5).cast("int")
    taken = mixing.mix(docs).where("taken > 0").select(F.col("doc_id").alias(other_id), F.col("text_key").alias(other_key), times.alias(copies))
    rows, same = docs.withColumn(key, F.xxhash64("text")), F.col("doc_id").eqNullSafe(F.col(other_id)) & (F.col(key) == F.col(other_key))
    if not rows.groupBy("doc_id", key).count().where("count > 1").isEmpty():
        rows = rows.withColumn(number, F.row_number().over(Window.partitionBy("doc_id", key).orderBy(F.lit(1))))
        taken = taken.withColumn(other_number, F.row_number().over(Window.partitionBy(other_id, other_key).orderBy(F.desc(copies))))
        same &= F.col(number) == F.col(other_number)
    return rows.join(taken.where(F.col(copies) > 0), same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences.

    A null text has the end id alone; rows that repeat are packed one by one; an empty table gives no pieces; other columns are ignored.
    """
    return packing.pack_documents(docs, f"{TOKENIZERS}/word_bpe_49k.json").drop("ids")


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixture", mixture), ("packed", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's tables, and the documents it read, go once its own result is written."""
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark, f"stage_{name}"):
            docs = saved(stage(spark, docs, sf_dir), f"stage_{name}")
        if name != STAGES[0][0]:
            discard(before)
        before = docs
    return docs
