"""Exact duplicates through minimal perfect hashes over the digests of earlier documents.

The history is a table of shards. A shard holds the digests of one range of digest prefixes, its minimal perfect hash and, in
the slot that the hash gives each digest, the whole 32-byte digest and the locator (doc_id) and size of its winner. New
documents are aggregated by digest, so that a text shared by a third of all rows is one row, sent to their shards and looked
up there. The slot's digest is compared byte by byte, since the hash maps strangers to some slot too. Members are repeats of
a historical text; the others are new texts, grouped among themselves.

The hash is of the kind that places keys bucket by bucket (largest first) with a displacement for each bucket that leads to
free slots; it needs about 2 bytes a bucket of 4 keys.

Very common digests are sent to all tasks where rows meet their winners.

Null texts are empty texts; texts of any length are digested whole, and only digests are shuffled. Of equal texts the row with the largest doc_id stays; a null doc_id is below all others. Rows that
repeat both doc_id and text count one by one in group_size and share their kept flag. Empty tables give empty
results. Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, join_counted, runs, saved

HISTORY_SCHEMA = "shard int, n int, seed long, displacements binary, digests binary, winners binary, sizes binary"
NONE = -(1 << 63)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def digest_of(text: str | Column = "text") -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def shard_of_digest(digest: Column, shards: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _hashes(digests: np.ndarray, seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and base hash of (n, 32) bytes; of bytes 8 to 24, since the first give the shard."""
    words = np.ascontiguousarray(digests[:, 8:24]).view("<u8")
    buckets = max(1, (n + 3) // 4)
    return (_mixed(words[:, 0] + np.uint64(seed)) % np.uint64(buckets)).astype(np.int64), _mixed(words[:, 1] ^ np.uint64(seed * 2 + 1))


def _slot(base: np.ndarray, displacement, n: int) -> np.ndarray:
    return (_mixed(base + np.asarray(displacement, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)


def build_hash(digests: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(seed, displacement of each bucket, slot of each digest): the slots are 0 to n-1, each taken once. Digests are distinct."""
    n = len(digests)
    seed = 0
    while True:
        bucket, base = _hashes(digests, seed, n)
        order = np.argsort(bucket, kind="stable")
        starts = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]])
        ends = np.r_[starts[1:], n]
        displacements = np.zeros(max(1, (n + 3) // 4), np.uint32)
        taken, slots, placed = np.zeros(n, bool), np.zeros(n, np.int64), True
        for k in np.argsort(starts - ends, kind="stable"):
            keys = order[starts[k] : ends[k]]
            found = False
            for first in range(0, max(1 << 14, 64 * n), 256):
                tries = _slot(base[keys][None, :], np.arange(first, first + 256, dtype=np.uint64)[:, None], n)
                free = ~taken[tries].any(axis=1)
                if len(keys) > 1:
                    s = np.sort(tries, axis=1)
                    free &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                hit = np.flatnonzero(free)
                if len(hit):
                    displacements[bucket[keys[0]]] = first + hit[0]
                    slots[keys] = tries[hit[0]]
                    taken[tries[hit[0]]] = found = True
                    break
            if not found:
                placed = False
                break
        if placed:
            return seed, displacements, slots
        seed += 1


def look_up(digests: np.ndarray, n: int, seed: int, displacements: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The slot of each digest, -1 for strangers; every hit is checked over all 32 bytes."""
    if not n:
        return np.full(len(digests), -1)
    bucket, base = _hashes(digests, seed, n)
    slot = _slot(base, displacements[bucket], n)
    return np.where((held[slot] == digests).all(axis=1), slot, -1)


def _digest_matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def build_history(groups: DataFrame, shards: int) -> DataFrame:
    """HISTORY_SCHEMA from distinct (digest, winner, n): one row for each shard, built in parallel."""

    def build(batches):
        import pyarrow as pa

        for (shard,), t in runs(batches, "shard"):
            digests = _digest_matrix(t.column("digest"))
            seed, displacements, slots = build_hash(digests)
            order = np.empty(len(slots), np.int64)
            order[slots] = np.arange(len(slots))
            winners, sizes = (t.column(c).to_numpy()[order].astype("<i8").tobytes() for c in ("winner", "n"))
            row = [[shard], [len(order)], [seed], [displacements.tobytes()], [digests[order].tobytes()], [winners], [sizes]]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)], ["shard", "n", "seed", "displacements", "digests", "winners", "sizes"])

    keyed = groups.select(shard_of_digest(F.col("digest"), shards).alias("shard"), "digest", F.coalesce("winner", F.lit(NONE)).alias("winner"), "n")
    return keyed.repartition("shard").sortWithinPartitions("shard", "digest").mapInArrow(build, HISTORY_SCHEMA)


def against_history(groups: DataFrame, history: DataFrame, shards: int) -> DataFrame:
    """(digest, winner, n, old_winner, old_n) for distinct (digest, winner, n); old_n is 0 for strangers."""
    empty = "cast(null as binary)"
    slots = history.selectExpr("shard", "0 as kind", f"{empty} as digest", "0L as winner", "0L as n", "struct(n, seed, displacements, digests, winners, sizes) as slots")
    asked = groups.select(shard_of_digest(F.col("digest"), shards).alias("shard"), F.lit(1).alias("kind"), "digest", F.coalesce("winner", F.lit(NONE)).alias("winner"), "n", F.lit(None).cast(slots.schema["slots"].dataType).alias("slots"))
    together = slots.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind")

    def look(batches):
        import pyarrow as pa

        shard, table = None, None
        for batch in batches:
            for (s,), t in runs([batch], "shard"):
                if s != shard:
                    shard, table = s, None
                kinds = t.column("kind").to_numpy()
                if kinds[0] == 0:
                    x = t.column("slots")[0].as_py()
                    table = x["n"], x["seed"], np.frombuffer(x["displacements"], np.uint32), np.frombuffer(x["digests"], np.uint8).reshape(-1, 32), np.frombuffer(x["winners"], "<i8"), np.frombuffer(x["sizes"], "<i8")
                    t = t.slice(1)
                if not t.num_rows:
                    continue
                digests = _digest_matrix(t.column("digest"))
                old, old_n = np.full(len(digests), NONE), np.zeros(len(digests), np.int64)
                if table is not None:
                    slot = look_up(digests, *table[:4])
                    met = slot >= 0
                    old[met], old_n[met] = table[4][slot[met]], table[5][slot[met]]
                yield pa.RecordBatch.from_arrays([t.column("digest").combine_chunks(), t.column("winner").combine_chunks(), t.column("n").combine_chunks(), pa.array(old), pa.array(old_n)], ["digest", "winner", "n", "old_winner", "old_n"])

    return together.mapInArrow(look, "digest binary, winner long, n long, old_winner long, old_n long")


def exact_dedup(docs: DataFrame, past: Column, shard_digests: int = 50_000, history_to: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, repeats_history.

    ``past`` marks the documents of earlier batches: their distinct digests become the history (written to ``history_to`` where
    given). All others are looked up in it. The results cover both and don't depend on where the line is drawn.
    """
    rows = docs.select(F.col("doc_id").cast("long"), digest_of("text").alias("digest"), F.coalesce(past, F.lit(True)).alias("past"))
    rows = saved(rows, "digests")
    groups = saved(rows.groupBy("past", "digest").agg(F.max("doc_id").alias("winner"), F.count("*").alias("n")), "groups")
    old, new = groups.where("past").drop("past"), groups.where("not past").drop("past")
    shards = max(1, -(-old.count() // shard_digests))
    history = build_history(old, shards)
    if history_to:
        history.write.parquet(history_to)
        history = docs.sparkSession.read.schema(history.schema).parquet(history_to)
    else:
        history = saved(history, "history")
    looked = against_history(new, history, shards)
    # What was looked up, and the historical texts that no new document repeats.
    met = looked.select("digest", F.greatest("winner", "old_winner").alias("winner"), (F.col("n") + F.col("old_n")).alias("n"), (F.col("old_n") > 0).alias("in_history"))
    rest = old.select("digest", F.coalesce("winner", F.lit(NONE)).alias("winner"), "n", F.lit(True).alias("in_history"))
    final = met.unionByName(rest).groupBy("digest").agg(F.max("winner").alias("winner"), F.max("n").alias("n"), F.max("in_history").alias("in_history"))
    keep = F.when(F.col("winner") != NONE, F.col("winner"))
    winners = saved(final, "winners")
    discard(groups, *([] if history_to else [history]))
    return join_counted(rows, winners, ["digest"], "n").select(
        "doc_id",
        keep.alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        (F.col("in_history") & ~F.col("past")).alias("repeats_history"),
    )


def earlier_half(docs: DataFrame) -> Column:
    """Marks the documents with ids up to the middle of the ids' range as those of earlier batches."""
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    return F.lit(True) if lo is None else F.coalesce(F.col("doc_id") <= F.lit((int(lo) + int(hi)) // 2), F.lit(True))
