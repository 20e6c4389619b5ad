"""Memories and their vectors as JSON lines; partitioned index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMORY_SCHEMA = "id string, content string, category string, projectTag string, createdAt long, updatedAt long, lastAccessedAt long, accessCount int, sensitive boolean, deleted boolean, source struct<type: string, snippet: string>"
VECTOR_SCHEMA = "_type string, model string, dimension int, memoryId string, vector array<double>, createdAt long"


def read_memories(spark: SparkSession, path: str) -> DataFrame:
    """Without blank, malformed and deleted lines."""
    rows = spark.read.schema(MEMORY_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col("id").isNotNull() & ~F.coalesce("deleted", F.lit(False)))


def read_vectors(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(header row, memoryId and vector; of repeated ids the latest)."""
    rows = spark.read.schema(VECTOR_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    header = rows.where(F.col("_type") == "header").select("model", "dimension")
    return header, rows.where(F.col("memoryId").isNotNull()).groupBy("memoryId").agg(F.max_by("vector", "createdAt").alias("vector"))


def write_memories(memories: DataFrame, path: str, append: bool = False) -> None:
    memories.write.mode("append" if append else "overwrite").json(path)


def save_index(index: DataFrame, path: str, partitions: int, key: str = "id") -> None:
    """Rows dealt by a hash of their key to ``partitions`` folders."""
    p = F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int")
    index.withColumn("p", p).repartition(partitions, "p").write.mode("overwrite").partitionBy("p").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("p")


def export_markdown(memories: DataFrame) -> DataFrame:
    """(category, month, markdown): dated bullets of what isn't sensitive, a part for each month, so that no category is gathered whole."""
    at = F.timestamp_millis("createdAt")
    line = F.concat(F.lit("- ["), F.date_format(at, "yyyy-MM-dd"), F.lit("] "), "content")
    kept = memories.where(~F.coalesce("sensitive", F.lit(False))).select("category", F.date_format(at, "yyyy-MM").alias("month"), F.struct("createdAt", "id", line.alias("line")).alias("x"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n")
    return kept.groupBy("category", "month").agg(F.concat(F.lit("## "), F.first("category"), F.lit("\n\n"), lines).alias("markdown"))
