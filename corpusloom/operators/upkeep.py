"""Upkeep of an index of notes: what to index, in which batches, what it holds, and references, memories and lists kept in step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def latest_mtime(index: DataFrame) -> DataFrame:
    """One row: the latest mtime of the index, 0 for an empty one."""
    return index.agg(F.coalesce(F.max("mtime"), F.lit(0)).alias("latest"))


def indexed_paths(index: DataFrame) -> DataFrame:
    return index.select("path").distinct().orderBy("path")


def files_to_index(notes: DataFrame, index: DataFrame, keep: Column, overwrite: bool = False) -> DataFrame:
    """(path, reason): notes that ``keep`` lets in, not blank, and not indexed, without some vector, or changed since the index's latest mtime.

    index: (path, mtime, embedding), a row for each chunk. ``overwrite``: all that ``keep`` lets in, blank ones too.
    """
    if overwrite:
        return notes.where(keep).select("path", F.lit("all").alias("reason"))
    full = notes.where(keep & (F.trim("body") != ""))
    whole = F.every(F.coalesce(F.size("embedding") > 0, F.lit(False)))
    held = index.groupBy("path").agg(whole.alias("_whole"))
    met = full.select("path", "mtime").join(held, "path", "left").crossJoin(F.broadcast(latest_mtime(index)))  # one row
    reason = F.when(F.col("_whole").isNull(), "new").when(~F.col("_whole"), "no vectors").when(F.col("mtime") > F.col("latest"), "changed")
    return met.select("path", reason.alias("reason")).where("reason is not null")


def index_batches(chunks: DataFrame, order: list[str], size: int = 16, every: int = 8, slices: int = 4096) -> DataFrame:
    """Adds id (md5 of title and content), place, batch and checkpoint (true on the row that fills ``every`` batches).

    Chunks are numbered by a hash of their order columns cut into ``slices``, so that no task sorts them all.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int")
    rows = chunks.withColumn("id", F.md5(F.concat_ws("\n", "title", "content"))).withColumn("_part", part)
    sums = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sums.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row a slice
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    placed = rows.withColumn("_w", within).join(F.broadcast(before), "_part").withColumn("place", F.col("_before") + F.col("_w"))
    return placed.withColumn("batch", F.floor((F.col("place") - 1) / size)).withColumn("checkpoint", F.col("place") % (size * every) == 0).drop("_part", "_w", "_before")


def index_stats(index: DataFrame) -> DataFrame:
    """One row: documents, chunks, chunks with a vector, latest mtime, models."""
    return index.agg(F.count_distinct("path").alias("documents"), F.count("*").alias("chunks"), F.count_if(F.size("embedding") > 0).alias("embedded"), F.coalesce(F.max("mtime"), F.lit(0)).alias("latest"), F.count_distinct("model").alias("models"))


def dump(index: DataFrame, paths: DataFrame, columns: list[str], order: str) -> DataFrame:
    """(path, rows): the chunks of the asked paths, in order; a note's chunks are few, as its size is bounded."""
    asked = index.join(paths.select("path").distinct(), "path", "left_semi")
    return asked.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("rows"))


def model_changed(index: DataFrame, current: str) -> DataFrame:
    """One row: whether the model that any row names differs from the current one, so that the index is to be made anew; null for an empty index."""
    return index.agg(F.max(F.struct("path", "model"))["model"].alias("stored")).select(F.when(F.col("stored").isNotNull(), ~T.same_model(F.col("stored"), F.lit(current))).alias("changed"))


def removed_items(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """(key, item): items of lists by lines that are gone, blank lines aside."""
    items = lambda rows: rows.select(key, F.explode(F.split("list", "\n")).alias("item")).select(key, F.trim("item").alias("item")).where("item <> ''").distinct()
    return items(before).join(items(now), [key, "item"], "left_anti")


def live_references(references: DataFrame, files: DataFrame) -> DataFrame:
    """References (project, path) whose file is still there and still of the project: files (project, path)."""
    return references.join(files.select("project", "path").distinct(), ["project", "path"], "left_semi")


def operations_by_file(operations: DataFrame, path: str, order: str) -> DataFrame:
    """(path, operations): a file's edits in order."""
    others = [c for c in operations.columns if c not in (path, order)]
    return operations.groupBy(path).agg(F.array_sort(F.collect_list(F.struct(order, *others))).alias("operations"))


def text_totals(notes: DataFrame) -> DataFrame:
    """One row: notes, characters of all texts joined by spaces, words, tokens (estimated)."""
    words = F.sum(F.coalesce(T.spaced_words(F.col("body")), F.lit(0)).cast("long"))
    chars = F.sum(F.coalesce(F.length("body"), F.lit(0)).cast("long")) + F.greatest(F.count("*") - 1, F.lit(0))
    return notes.agg(F.count("*").alias("notes"), chars.alias("characters"), words.alias("words"), T.token_estimate(words).cast("long").alias("tokens"))


def output_sizes(calls: DataFrame, key: list[str], output: str) -> DataFrame:
    return calls.groupBy(*key).agg(F.sum(F.coalesce(F.length(output), F.lit(0)).cast("long")).alias("size"))


def all_tags(notes: DataFrame, inline: bool = True) -> DataFrame:
    """Distinct tags with a #, in order: of the frontmatter and, if asked for, of the text."""
    rows = notes.select(F.explode("tags").alias("tag"))
    if inline:
        rows = rows.unionByName(notes.select(F.explode("inline_tags").alias("tag")))
    return rows.select(F.when(F.startswith("tag", F.lit("#")), F.col("tag")).otherwise(F.concat(F.lit("#"), "tag")).alias("tag")).distinct().orderBy("tag")


def change_memories(memories: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memories after the changes, changes of unknown ids).

    memories (id, content, embedding); changes (id, content, at): null content deletes; the latest change of an id counts. New content has a null
    embedding, to be made anew; the same content keeps its own.
    """
    last = changes.groupBy("id").agg(F.max_by(F.struct("content"), "at").alias("_c")).select("id", F.col("_c.content").alias("_new"), F.lit(True).alias("_changed"))
    met = memories.join(last, "id", "left")
    kept = met.where(F.col("_changed").isNull() | F.col("_new").isNotNull())
    same = F.col("_changed").isNull() | (F.col("_new") == F.col("content"))
    after = kept.select("id", F.coalesce("_new", "content").alias("content"), F.when(same, F.col("embedding")).alias("embedding"))
    return after, last.join(memories.select("id"), "id", "left_anti").select("id")


def to_embed(memories: DataFrame, everything: bool = False) -> DataFrame:
    """(id, content) of memories without a vector, or of all."""
    return (memories if everything else memories.where(F.coalesce(F.size("embedding"), F.lit(0)) <= 0)).select("id", "content")


def chat_by_epoch(chats: DataFrame, epochs: DataFrame, order: str) -> DataFrame:
    """(epoch, chat): the first chat of each asked epoch."""
    return chats.join(epochs.select("epoch").distinct(), "epoch", "left_semi").groupBy("epoch").agg(F.min_by("chat", order).alias("chat"))
