"""An index of rows by key as base files and deltas: small batches cost what they touch, readers see whole versions.

Rows are dealt to a fixed number of parts by a hash of their key. A batch of changes becomes one delta folder, sorted by key within each part it touches.
A part whose deltas have grown past a share of its base, or past a number, is merged into a new base; other parts stay as they are. A version is one
small file that names each part's base and deltas (its size follows the number of parts, not of rows); it appears by a rename, so a reader finds the last
whole one. Folders that no kept version names are removed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

KEPT = 2  # versions, so that a reader of the last but one can finish


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, where = _place(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def versions(spark: SparkSession, index: str) -> list[int]:
    return [int(n.removesuffix(".json")) for n in _names(spark, f"{index}/versions") if n.endswith(".json")]


def version(spark: SparkSession, index: str, number: int) -> dict:
    """{"key", "parts", "schema", "of": {part: {"base": folder or None, "rows", "deltas": [[folder, rows], ...]}}}"""
    return json.loads(spark.read.text(f"{index}/versions/{number:012d}.json", wholetext=True).first()[0])


def _commit(spark: SparkSession, index: str, number: int, content: dict) -> None:
    fs, new = _place(spark, f"{index}/versions/{number:012d}.{uuid.uuid4().hex}.tmp")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    fs.rename(new, _place(spark, f"{index}/versions/{number:012d}.json")[1])


def _folders(content: dict) -> set[str]:
    return {f for p in content["of"].values() for f in [p["base"], *(d[0] for d in p["deltas"])] if f}


def _tidy(spark: SparkSession, index: str) -> None:
    numbers = versions(spark, index)
    kept = numbers[-KEPT:]
    used = set().union(*(_folders(version(spark, index, n)) for n in kept))
    for n in numbers[:-KEPT]:
        fs, where = _place(spark, f"{index}/versions/{n:012d}.json")
        fs.delete(where, False)
    for f in _names(spark, f"{index}/rows"):
        if f not in used:
            fs, where = _place(spark, f"{index}/rows/{f}")
            fs.delete(where, True)


def _read(spark: SparkSession, index: str, content: dict, parts: list[str]) -> DataFrame:
    """The rows of ``parts``, with ``part``: bases as they are, but for the keys that deltas hold; of those the latest delta's row, if it isn't a deletion."""
    schema = StructType.fromJson(content["schema"])
    with_part = [*schema.fields, StructField("part", IntegerType())]
    key, columns = content["key"], schema.fieldNames()

    def rows(folders: list[tuple[str, str]], age: int | None = None) -> DataFrame:
        full = StructType(with_part if age is None else [StructField("deleted", BooleanType()), *with_part])
        read = spark.read.schema(full).option("basePath", f"{index}/rows/{folders[0][0]}")
        out = read.parquet(*(f"{index}/rows/{f}/part={p}" for f, p in folders))
        return out if age is None else out.withColumn("age", F.lit(age))

    by_base: dict[str, list[tuple[str, str]]] = {}
    by_delta: dict[str, list[tuple[str, str]]] = {}
    for p in parts:
        held = content["of"][p]
        if held["base"]:
            by_base.setdefault(held["base"], []).append((held["base"], p))
        for f, _ in held["deltas"]:
            by_delta.setdefault(f, []).append((f, p))
    base = spark.createDataFrame([], StructType(with_part))
    for folders in by_base.values():
        base = base.unionByName(rows(folders))
    if not by_delta:
        return base
    deltas = None
    for age, f in enumerate(sorted(by_delta)):  # names begin with the batch's number
        one = rows(by_delta[f], age)
        deltas = one if deltas is None else deltas.unionByName(one)
    others = [c for c in columns if c != key]
    last = deltas.groupBy(key).agg(F.max_by(F.struct("deleted", "part", *others), "age").alias("r"))
    fresh = last.where("not r.deleted").select(key, *(F.col(f"r.`{c}`").alias(c) for c in others), F.col("r.part").alias("part"))
    return base.join(last.select(F.col(key).alias("changed")), F.col(key).eqNullSafe(F.col("changed")), "left_anti").unionByName(fresh)


def read_index(spark: SparkSession, index: str, number: int | None = None) -> DataFrame:
    """The index's rows at its last version, or at an earlier one that is still kept. An index without versions is an error."""
    content = version(spark, index, versions(spark, index)[-1] if number is None else number)
    return _read(spark, index, content, sorted(content["of"], key=int)).drop("part")


def apply_changes(batch: DataFrame, number: int, index: str, key: str, parts: int = 64, share: float = 0.2, most_deltas: int = 16) -> None:
    """Applies (key, ..., deleted, at) changes as version ``number``. Of several changes to a key the latest ``at`` counts, between batches the later batch.

    A batch that is repeated after its version was written changes nothing. A null ``deleted`` is a change like any other; columns named part or age are not allowed.
    """
    spark = batch.sparkSession
    known = versions(spark, index)
    if number in known:
        return
    columns = [c for c in batch.columns if c not in ("deleted", "at")]
    others = [c for c in columns if c != key]
    schema = batch.select(*columns).schema
    content = version(spark, index, known[-1]) if known else {"key": key, "parts": parts, "schema": json.loads(schema.json()), "of": {}}
    last = batch.groupBy(key).agg(F.max_by(F.struct(F.coalesce("deleted", F.lit(False)).alias("deleted"), *others), F.struct("at", "deleted")).alias("r"))
    flat = last.select(key, *(F.col(f"r.`{c}`").alias(c) for c in others), "r.deleted").withColumn("part", F.pmod(F.xxhash64(key), F.lit(content["parts"])).cast("int"))
    folder = f"{number:012d}-{uuid.uuid4().hex}"
    _write(flat, key, f"{index}/rows/{folder}")
    for part, n in _counts(spark, f"{index}/rows/{folder}"):
        held = content["of"].setdefault(str(part), {"base": None, "rows": 0, "deltas": []})
        held["deltas"].append([folder, n])
    grown = [p for p, h in content["of"].items() if len(h["deltas"]) > most_deltas or sum(d[1] for d in h["deltas"]) > share * h["rows"]]
    if grown:
        base = f"{number:012d}-{uuid.uuid4().hex}"
        _write(_read(spark, index, content, grown), key, f"{index}/rows/{base}")
        found = dict(_counts(spark, f"{index}/rows/{base}"))
        for p in grown:
            n = found.get(int(p), 0)
            content["of"][p] = {"base": base if n else None, "rows": n, "deltas": []}
    _commit(spark, index, number, content)
    _tidy(spark, index)


def _write(rows: DataFrame, key: str, place: str) -> None:
    """Rows of a part meet in as many tasks as they fill; each file is sorted by key."""
    rows.hint("rebalance", "part").sortWithinPartitions("part", key).write.partitionBy("part").parquet(place)


def _counts(spark: SparkSession, place: str) -> list[tuple[int, int]]:
    if not any(n.startswith("part=") for n in _names(spark, place)):
        return []
    return [(r["part"], r["count"]) for r in spark.read.parquet(place).groupBy("part").count().collect()]


def maintain(changes: DataFrame, index: str, checkpoint: str, key: str = "path", **options) -> StreamingQuery:
    """Applies a stream of changes, a version for each batch; ``options`` are those of ``apply_changes``."""
    return changes.writeStream.foreachBatch(lambda b, n: apply_changes(b, n, index, key, **options)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
