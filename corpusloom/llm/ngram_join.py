"""Similar documents by the Jaccard similarity of their word shingles, with Bayesian pruning of candidates.

Documents with equal sets of shingles are one class. Classes get a MinHash signature; classes that share a band of it are
candidates. A candidate pair is compared ``step`` values at a time and dropped once the posterior probability that its
similarity reaches the threshold (uniform prior, binomial matches) is below ``tolerance``. What survives joins classes
into candidate components. The whole shingle sets are then sent to their component, by blocks, where pairs are pruned in the same
way and what is left is verified exactly. Tasks return link counts and spanning edges, never the pairs.

A word is a run of characters that aren't white space, in lower case. Texts of fewer words than a shingle have one shingle, all
their words. Null texts and texts without words have none: they link with nothing. Rows that repeat a doc_id take part one
by one; a null doc_id is below all others, so a class that holds one has a null class_id. Of equal least ids one row is kept. Texts of
any length are read whole, one at a time in a task. Empty tables give empty results. Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, if_small, join_counted, saved, text_batches, tidied, worker_cache
from corpusloom.llm.linking import candidate_edges, components, exact_links, with_least

_P = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < 100_000:
            self[word] = h
        return h


def _word_hashes() -> WordHashes:
    held = worker_cache("words")
    if 0 not in held:
        held[0] = WordHashes()
    return held[0]


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles of ``k`` words."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    n = len(h) - k + 1
    s = np.full(n, k, np.uint64)
    for i in range(k):
        s = (s ^ (s >> np.uint64(29))) * _P + h[i : i + n]
    s = (s ^ (s >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(s ^ (s >> np.uint64(32)))


def minhash(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The least value of each of the permutations of 32-bit space, over a whole set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        y = x[i : i + 512, None] * factors
        y += shifts
        np.minimum(out, y.min(axis=0), out=out)
    return out


def fewest_matches(values: int, threshold: float, tolerance: float) -> int:
    """The fewest matches among ``values`` at which P(similarity >= threshold | matches) is at least ``tolerance``.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail at t is P(Binomial(n + 1, t) <= m).
    """
    tail = 0.0
    for m in range(values + 1):
        tail += math.comb(values + 1, m) * threshold**m * (1 - threshold) ** (values + 1 - m)
        if tail >= tolerance:
            return m
    return values


def survivors(threshold: float, tolerance: float, step: int) -> Callable:
    """For ``candidate_edges``: compares signatures step by step and keeps the pairs that no step drops."""

    def of(codes: np.ndarray) -> Callable:
        signatures = np.ascontiguousarray(codes).view(np.uint32)
        size = signatures.shape[1]
        least = [(n, fewest_matches(n, threshold, tolerance)) for n in [*range(step, size, step), size]]

        def similar(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            left, matches, before = np.arange(len(i)), np.zeros(len(i), np.int32), 0
            for n, fewest in least:
                matches = matches + (signatures[i[left], before:n] == signatures[j[left], before:n]).sum(axis=1)
                keep = matches >= fewest
                left, matches, before = left[keep], matches[keep], n
                if not len(left):
                    break
            out = np.zeros(len(i), bool)
            out[left] = True
            return out

        return similar

    return of


def surviving_pairs(codes: np.ndarray, threshold: float, tolerance: float, step: int) -> np.ndarray:
    """The matrix of the pairs among all signatures of a task group that no step drops."""
    n = len(codes)
    i, j = np.triu_indices(n, 1)
    kept = survivors(threshold, tolerance, step)(codes)(i, j)
    out = np.zeros((n, n), bool)
    out[i[kept], j[kept]] = out[j[kept], i[kept]] = True
    return out


def jaccard_matrix(bodies: list[bytes], threshold: float) -> np.ndarray:
    """Which pairs of shingle sets reach the threshold, exactly: counts of common shingles by products of 0/1 blocks."""
    sets = [np.frombuffer(b, np.uint64) for b in bodies]
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        hit = bool(common and common >= threshold * (sizes.sum() - common) - 1e-9)
        return np.array([[True, hit], [hit, True]])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = max(256, min(8192, (32 << 20) // (4 * len(sets))))
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, [first, first + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[i:j], column[i:j] - first] = 1
        common += m @ m.T
    common = common.astype(np.int64)
    either = sizes[:, None] + sizes[None, :] - common
    return (common > 0) & (common >= threshold * either - 1e-9)


def verified(codes: np.ndarray, bodies: list[bytes], threshold: float, tolerance: float, step: int) -> np.ndarray:
    """The links of a task group: the pairs that pruning leaves, verified on their whole shingle sets."""
    left = surviving_pairs(codes, threshold, tolerance, step)
    some = np.flatnonzero(left.any(axis=1))
    if len(some):
        left[np.ix_(some, some)] &= jaccard_matrix([bodies[k] for k in some], threshold)
    return left


def similar_documents(docs: DataFrame, threshold: float = 0.8, k: int = 5, bands: int = 30, rows: int = 5, tolerance: float = 1e-6, step: int = 25, seed: int = 5) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, kept, text_key.

    class_id is the smallest doc_id that links lead to, n_links the number of other documents with similarity of at least
    ``threshold``, kept true for one row of each class, with that doc_id; text_key is the text's hash, for joins where ids repeat. With 30 bands of 5 a pair at 0.8 is missed with a
    probability of 7 in a million, and each step of the pruning drops one if its posterior is below ``tolerance``.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rng = np.random.default_rng(seed)
    factors = spark.sparkContext.broadcast((rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)))

    def signed(batches):
        import hashlib

        import pyarrow as pa

        for b in (x.slice(i, 256) for x in batches for i in range(0, x.num_rows, 256)):
            sets = [shingle_set(t, k) for t in b.column("text").to_pylist()]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            signatures = [minhash(s, *factors.value).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()), b.column("text_key")], ["doc_id", "digest", "signature", "text_key"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed_docs = texts.withColumn("text_key", F.xxhash64("text")).mapInArrow(tidied(signed), "doc_id long, digest binary, signature binary, text_key long")
    table = saved(signed_docs.withColumn("uid", F.monotonically_increasing_id()), "signatures")
    some = table.where("digest is not null")
    classes = some.groupBy("digest").agg(F.min(F.struct("uid", "doc_id", "text_key")).alias("one"), F.min(F.struct("doc_id", "uid")).alias("low"), F.count("*").alias("weight"))
    classes = saved(classes.select("digest", "one.*", "low", "weight"), "classes")
    signatures = table.select("uid", "signature").join(classes.select("uid"), "uid", "left_semi")

    def banded(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            s = np.frombuffer(b"".join(b.column("signature").to_pylist()), np.uint32).reshape(b.num_rows, bands, rows).astype(np.uint64)
            h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), s.shape[:2]).copy()
            for i in range(rows):
                h = (h ^ (h >> np.uint64(31))) * _P + s[:, :, i]
            h = (h ^ (h >> np.uint64(31))) * _P
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(np.repeat(b.column("uid").to_numpy(), bands))], ["bucket", "uid"])

    index = signatures.mapInArrow(banded, "bucket long, uid long")
    shared = index.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = saved(index.join(shared, "bucket"), "met")
    asked = met.join(table.select("uid", F.col("signature").alias("code")), "uid")
    found = components(candidate_edges(asked, survivors(threshold, tolerance, step)))
    sizes = found.groupBy("component").agg(F.count("*").alias("n"))
    wanted = saved(found.join(sizes, "component").join(classes, "uid").select("component", "n", "uid", "weight", "digest", "doc_id", "text_key"), "candidates")

    def bodies(batches):
        import hashlib

        import pyarrow as pa

        for b in (x.slice(i, 256) for x in batches for i in range(0, x.num_rows, 256)):
            sets = [shingle_set(t, k) for t in b.column("text").to_pylist()]
            same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == d for s, d in zip(sets, b.column("digest").to_pylist(), strict=True)]
            signatures = [minhash(s, *factors.value).tobytes() if ok else None for s, ok in zip(sets, same, strict=True)]
            out = [*(b.column(c) for c in ("component", "n", "uid", "weight")), pa.array(signatures, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["component", "n", "uid", "weight", "code", "body"]).filter(pa.array(same, pa.bool_()))

    again = texts.withColumn("text_key", F.xxhash64("text")).join(if_small(wanted.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"}), 100_000), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    again = again.select("component", "n", "uid", "weight", "digest", "text").mapInArrow(tidied(bodies), "component long, n long, uid long, weight long, code binary, body binary")
    # Of rows that repeat a class's doc_id and text, one with its shingles is enough.
    if not table.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        again = again.dropDuplicates(["uid"])
    counts, edges, links = exact_links(again, lambda codes, b: verified(codes, b, threshold, tolerance, step))
    joined = components(edges)
    per_class = classes.join(counts, "uid", "left").join(joined, "uid", "left").select("digest", "low", "weight", F.coalesce("component", "uid").alias("c"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    per_class = with_least(per_class, "low").withColumnRenamed("least", "first")
    discard(met, found, wanted, links, joined, classes)
    linked = join_counted(some, per_class, ["digest"], "weight")
    linked = linked.select("doc_id", F.col("first.doc_id").alias("class_id"), "n_links", (F.col("uid") == F.col("first.uid")).alias("kept"), "text_key")
    alone = table.where("digest is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"), "text_key")
    return linked.unionByName(alone)
