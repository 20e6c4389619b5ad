"""What the operators of this subpackage share: written tables, file systems, seeded hashes and range shards."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.tables import discard, new_folder, saved, scratch  # noqa: F401 (part of this module for the operators)


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts hold at most ``rows`` rows, unless the session asks for fewer: their memory doesn't follow Spark's default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


_CACHES: dict[str, dict] = {}


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as its Python worker; asking for another one empties it, since workers serve many stages."""
    for other, held in _CACHES.items():
        if other != name:
            held.clear()
    return _CACHES.setdefault(name, {})


def tidy() -> None:
    """Returns memory that a finished task has freed to the system, for the executor's other processes."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: nothing to trim
        pass


def tidied(task):
    """``task`` for mapInArrow, followed by ``tidy``."""

    def run(batches):
        yield from task(batches)
        tidy()

    return run


def if_small(df: DataFrame, rows: int) -> DataFrame:
    """A written table marked for broadcast if it has no more than ``rows`` rows; else Spark shuffles both sides of the join."""
    return F.broadcast(df) if df.count() <= rows else df


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], count: str, how: str = "inner", hot: int = 50_000) -> DataFrame:
    """Inner or left join of ``rows`` with a written ``table`` of distinct keys, whose column ``count`` tells how many rows have the key.

    Keys of more than ``hot`` rows, or of a ten-thousandth of all if that is more, are at most 10,000: they are sent to every task, so
    that a key of a third of all rows isn't shuffled to one.
    """
    total, most = table.agg(F.sum(count), F.max(count)).first()
    limit = max(hot, int(total or 0) // 10_000)
    if (most or 0) <= limit:
        return rows.join(table, keys, how)
    many = table.where(F.col(count) > limit)
    others = rows.join(F.broadcast(many.select(*keys)), keys, "left_anti").join(table.where(F.col(count) <= limit), keys, how)
    return rows.join(F.broadcast(many), keys).unionByName(others)


def open_fs(uri: str):
    """(pyarrow file system, path) of a folder that tasks write files of their own format to."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of a value's text, modulo ``folds``; the same in SQL and in Python. Null is in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(folds), F.lit(0).cast("long"))


def seeded(seed: int, column: str) -> Column:
    """A whole number in [0, 2^60) from md5 of "seed:value"; null counts as the empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def range_shards(keys: DataFrame, target: int, split: int = 4) -> tuple[Callable[[DataFrame], DataFrame], list[int]]:
    """(a function that adds ``shard`` to rows with ``key`` and ``tie``, the weight of every shard).

    keys: ``key`` long, ``tie`` long, ``weight`` long; read a few times, so best a written table. Shards are runs of ascending keys (nulls
    first) of at most ``target`` weight, but for single rows above it and rows that share key and tie. The cuts depend on the rows
    alone: a range is cut into equal cells, about ``split`` for each shard that it needs; cells above the target are cut again between the
    least and largest key they hold, or by ``tie`` where they hold one key. What reaches the driver grows with the number of shards.
    """
    spark = keys.sparkSession
    levels: list[DataFrame] = []
    children: dict[int, list[int]] = {}
    weights: dict[int, int] = {}
    schema = "parent long, lo decimal(20,0), width decimal(21,0), cells long, first long, by_tie boolean"

    def refine(rows: DataFrame, level: DataFrame) -> DataFrame:
        within = F.floor((F.col("key").cast("decimal(20,0)") - F.col("lo")) * F.col("cells").cast("decimal(12,0)") / F.col("width"))
        at = F.when(F.col("by_tie"), F.pmod("tie", "cells")).otherwise(F.least(within.cast("long"), F.col("cells") - 1))
        held = rows.join(F.broadcast(level), rows["cell"] == level["parent"], "left")
        return held.withColumn("cell", F.coalesce(F.col("first") + at, "cell")).select(*rows.columns)

    now = keys.withColumn("cell", F.when(F.col("key").isNull(), 0).otherwise(1).cast("long"))
    cells, fresh = [0, 1], 2
    tied: set[int] = set()
    while True:
        found = {r["cell"]: r for r in now.where(F.col("cell") >= cells[0]).groupBy("cell").agg(F.sum("weight").alias("w"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}
        rows = []
        for c in cells:
            r = found.get(c)
            weights[c] = int(r["w"]) if r else 0
            if weights[c] > target and c not in tied:
                n = min(1 << 20, max(2, split * -(-weights[c] // target)))
                by_tie = r["lo"] == r["hi"]
                if not by_tie:
                    n = min(n, r["hi"] - r["lo"] + 1)
                rows.append((c, Decimal(r["lo"] or 0), Decimal((r["hi"] or 0) - (r["lo"] or 0) + 1), n, fresh, by_tie))
                children[c] = list(range(fresh, fresh + n))
                if by_tie:
                    tied.update(children[c])
                fresh += n
        if not rows:
            break
        cells = list(range(rows[0][4], fresh))
        levels.append(spark.createDataFrame(rows, schema))
        now = refine(now, levels[-1])

    shards: list[int] = []
    of: list[tuple[int, int]] = []
    stack = [1, 0]
    while stack:  # the cells that aren't cut again, in ascending order
        c = stack.pop()
        if c in children:
            stack += reversed(children[c])
        elif weights[c] or c == 1:
            if not shards or shards[-1] and shards[-1] + weights[c] > target:
                shards.append(0)
            shards[-1] += weights[c]
            of.append((c, len(shards) - 1))
    final = spark.createDataFrame(of, "cell long, shard int")

    def assign(rows: DataFrame) -> DataFrame:
        out = rows.withColumn("cell", F.when(F.col("key").isNull(), 0).otherwise(1).cast("long"))
        for level in levels:
            out = refine(out, level)
        return out.join(F.broadcast(final), "cell").drop("cell")

    return assign, shards


def runs(batches, *keys: str):
    """Joins the Arrow batches of one sorted partition and yields a table for each run of equal ``keys``.

    Holds one run (and the batch it ends in) at a time; the caller bounds the size of a run.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    held, held_key = [], None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        change = None
        for k in keys:
            c = table.column(k).combine_chunks()
            c = pc.fill_null(c, -1)
            d = pc.not_equal(c.slice(1), c.slice(0, len(c) - 1))
            change = d if change is None else pc.or_(change, d)
        cuts = [0, *(pc.indices_nonzero(change).to_numpy() + 1).tolist(), table.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            part = table.slice(i, j - i)
            key = tuple(part.column(k)[0].as_py() for k in keys)
            if held and key != held_key:
                yield held_key, pa.concat_tables(held)
                held = []
            held.append(part)
            held_key = key
    if held:
        yield held_key, pa.concat_tables(held)
