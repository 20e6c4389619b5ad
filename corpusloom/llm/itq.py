"""Near-duplicate embeddings by iterative quantisation, multi-index Hamming tables and exact reranking.

A rotation is learned on a bounded sample so that the signs of the rotated vectors make balanced codes with little
quantisation error; several rotations from different starts give longer codes. Every vector is coded. The code is cut into chunks, one
hash table for each chunk and label; vectors that share a chunk are candidates if their whole codes differ in few enough
bits. Candidates are joined into components (edges only, one code a row and table), and the original vectors are sent
to their component, by blocks, where the pairs whose codes differ in few enough bits are reranked by their cosine in double precision.
Tasks return counts of links and spanning edges, not pairs.

Tables and the bound on differing bits come from pairs drawn at the threshold and coded by the final codes, so that the share
of them that would be found is measured, not assumed. Where no plan finds enough of them, labels are compared whole, in pairs of blocks of 1,024 vectors,
so that a vector of a label of n goes to n / 1024 tasks. Vectors of each length are a group of their own with its own codes; their lengths are few (each is planned by the driver).

Identical vectors of one label are one representative with a weight. Vectors that are null, empty, zero, or hold null or
non-finite components, and vectors without a label, link with nothing and are their own component. Vectors of doubles are
compared as they are, all others as floats.
Rows that repeat a vec_id take part one by one and show the same component; a null vec_id is below all others, so its component_id is null. Empty tables give empty results; columns beyond vec_id,
embedding and label are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, join_counted, saved
from corpusloom.llm.linking import candidate_edges, components, exact_links, with_least


@dataclass
class Codes:
    """Mean and rotations of a fitted quantiser; bits of all rotations in a row, 8 to a byte."""

    mean: np.ndarray
    rotations: list[np.ndarray]

    @property
    def bits(self) -> int:
        return sum(r.shape[1] for r in self.rotations)

    def encode(self, x: np.ndarray) -> np.ndarray:
        signs = np.concatenate([(x - self.mean) @ r > 0 for r in self.rotations], axis=1)
        return np.packbits(signs, axis=1)


def fit_itq(sample: np.ndarray, n_rotations: int, rounds: int = 30, seed: int = 11, known: Codes | None = None) -> Codes:
    """Learns ``n_rotations`` rotations, beyond those ``known`` of this sample: from a random start, alternately codes by sign and solves for the best rotation."""
    mean = sample.mean(0)
    x = sample - mean
    _, _, basis = np.linalg.svd(x, full_matrices=False)
    v = x @ basis.T
    out = known.rotations[:n_rotations] if known else []
    for k in range(len(out), n_rotations):
        r = np.linalg.qr(np.random.default_rng(seed + k).standard_normal((v.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = w.T @ u.T
        out.append(basis.T @ r)
    return Codes(mean, out)


def pairs_at(sample: np.ndarray, threshold: float, seed: int, n: int = 10_000) -> list[tuple[np.ndarray, np.ndarray]]:
    """About ``n`` pairs at exactly the threshold, twice: unit vectors with partners drawn in any direction, and towards another vector of the sample."""
    rng = np.random.default_rng(seed)
    x = sample[np.concatenate([rng.permutation(len(sample)) for _ in range(-(-n // len(sample)))])[:n]]
    out = []
    for y in (rng.standard_normal(x.shape), sample[rng.integers(len(sample), size=len(x))]):
        y = y - (y * x).sum(axis=1, keepdims=True) * x
        size = np.linalg.norm(y, axis=1, keepdims=True)
        some = size[:, 0] > 1e-9
        if some.any():
            out.append((x[some], threshold * x[some] + math.sqrt(max(0.0, 1 - threshold**2)) * y[some] / size[some]))
    return out


def plan_tables(sample: np.ndarray, threshold: float, group_rows: int, recall: float, seed: int, block: int = 256, most_tables: int = 256) -> tuple[Codes, int, int, int]:
    """(codes, bits of a chunk, tables, bits that a candidate may differ in), such that the measured share of pairs at the threshold that are found is ``recall`` at least.

    Chunks are as wide as the largest label asks for, and narrower where that would take more than ``most_tables`` tables; codes
    hold 128 bits at least, for strangers to stay apart. The bound may lose a tenth of what may be lost, the tables the rest. Small labels
    are compared whole (no bits, one table), and so are all where no width does: that is exact at any size, and quadratic in the largest label.
    """
    pairs = pairs_at(sample, threshold, seed) if group_rows > 64 else []
    codes = fit_itq(sample, 1, seed=seed)
    step = codes.bits
    parts = [[] for _ in pairs]  # differing bits by rotation
    first = min(16, max(8, round(math.log2(max(1, group_rows) / block)))) if pairs else 0
    for width in range(first, 0, -1):
        tables = min(most_tables, 128 // width)
        while True:
            need = -(-tables * width // step)
            codes = fit_itq(sample, max(need, len(codes.rotations)), seed=seed, known=codes)
            for (x, y), p in zip(pairs, parts, strict=True):
                p += [((x - codes.mean) @ r > 0) != ((y - codes.mean) @ r > 0) for r in codes.rotations[len(p) : need]]
            differ = [np.concatenate(p[:need], axis=1) for p in parts]
            n = [d.sum(axis=1) for d in differ]
            most = max(math.ceil(np.quantile(k, 1 - (1 - recall) / 10, method="higher")) for k in n)
            met = [(~d[:, : tables * width].reshape(len(d), tables, width).any(axis=2)).any(axis=1) for d in differ]
            if min(np.mean(m & (k <= most)) for m, k in zip(met, n, strict=True)) >= recall:
                return Codes(codes.mean, codes.rotations[:need]), width, tables, most
            if tables >= most_tables:
                break
            tables = min(most_tables, tables + max(1, tables // 8))
    return Codes(codes.mean, codes.rotations[:1]), 0, 1, step


def near_embeddings(vectors: DataFrame, threshold: float = 0.93, sample_rows: int = 20_000, recall: float = 0.999, seed: int = 11) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept. ``sample_rows`` bounds the vectors that the rotations of a length are learned from."""
    kind = "double" if vectors.schema["embedding"].dataType.simpleString() == "array<double>" else "float"
    x = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{kind}>").alias("v"), "label")
    fine = F.col("label").isNotNull() & F.exists("v", lambda c: c != 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    keys = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(2), "v").alias("h2")]  # together a key of 128 bits
    rows = saved(x.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "v", *keys, F.coalesce(fine, F.lit(False)).alias("usable")), "vectors")
    classes = saved(rows.where("usable").groupBy("label", "v", "h1", "h2").agg(F.min("row").alias("uid"), F.min(F.struct("vec_id")).alias("low"), F.count("*").alias("weight")), "classes")
    # A length whose labels hold one vector each has no pairs.
    lengths = classes.groupBy(F.size("v").alias("d"), "label").count().groupBy("d").agg(F.max("count").alias("largest"), F.sum("count").alias("n")).orderBy("d").collect()
    counts = joined = None
    tables = []
    for r in lengths:
        if r["largest"] > 1:
            c, e, t = length_links(classes.where(F.size("v") == r["d"]), r["d"], r["largest"], r["n"], threshold, sample_rows, recall, seed)
            counts, joined = (c, e) if counts is None else (counts.unionByName(c), joined.unionByName(e))
            tables.append(t)
    own = F.col("weight") - 1
    light = classes.select("label", "h1", "h2", "uid", "low", "weight")
    if counts is None:
        per_class = light.withColumns({"c": F.col("uid"), "n": own})
    else:
        tables.append(components(joined))
        per_class = light.join(counts, "uid", "left").join(tables[-1], "uid", "left").withColumns({"c": F.coalesce("component", "uid"), "n": own + F.coalesce("links", F.lit(0))})
    per_class = with_least(per_class.select("label", "h1", "h2", "weight", "n", "low", "c"), "low").select("label", "h1", "h2", "weight", "n", F.col("least.vec_id").alias("component_id"))
    discard(classes, *tables)
    light = rows.select("vec_id", "label", "h1", "h2", "usable")
    linked = join_counted(light.where("usable"), per_class, ["label", "h1", "h2"], "weight").select("vec_id", "n", "component_id")
    rest = light.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).select("vec_id", F.col("n").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def length_links(classes: DataFrame, dim: int, largest: int, n: int, threshold: float, sample_rows: int, recall: float, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((uid, links), (a, b), their written table) among the ``n`` distinct vectors of one length, with up to ``largest`` of a label."""
    spark = classes.sparkSession
    share = min(1.0, sample_rows / n)
    picked = classes.where(F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).orderBy("uid").limit(sample_rows).select("v").toPandas()["v"]
    if not len(picked):
        picked = classes.limit(sample_rows).select("v").toPandas()["v"]
    sample = np.array(picked.tolist(), np.float64)
    sample /= np.abs(sample).max(axis=1, keepdims=True)  # tiny and huge vectors alike
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    fitted, width, tables, most = plan_tables(sample, threshold, largest, recall, seed)
    codes = spark.sparkContext.broadcast(fitted)

    kind = np.float64 if classes.schema["v"].dataType.simpleString() == "array<double>" else np.float32

    def unit(v):
        v = v.astype(np.float64)
        v = v / np.abs(v).max(axis=1, keepdims=True)  # tiny and huge vectors alike
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    def tabled(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            code = codes.value.encode(unit(b.column("v").flatten().to_numpy().reshape(b.num_rows, dim)))
            bits = np.unpackbits(code, axis=1)[:, : tables * width].reshape(len(code), tables, width)
            chunk = bits @ (1 << np.arange(width, dtype=np.int64))
            keys = (chunk * tables + np.arange(tables)).ravel()
            flat = pa.array([c.tobytes() for c in np.repeat(code, tables, axis=0)], pa.binary())
            uid = np.repeat(b.column("uid").to_numpy(), tables)
            label = b.column("label").take(pa.array(np.repeat(np.arange(len(code)), tables)))
            yield pa.RecordBatch.from_arrays([label, pa.array(keys), pa.array(uid), flat], ["label", "key", "uid", "code"])

    def within(codes):
        words = np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8)))).view(np.uint64)
        return lambda i, j: np.bitwise_count(words[i] ^ words[j]).sum(axis=-1) <= most

    if width:
        index = classes.select("label", "uid", "v").mapInArrow(tabled, f"label {classes.schema['label'].dataType.simpleString()}, key long, uid long, code binary")
        index = saved(index.select(F.xxhash64("label", "key").alias("bucket"), "uid", "code"), "index")
        shared = index.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        found = components(candidate_edges(index.join(shared, "bucket"), within))
        discard(index)
    else:  # labels are compared whole
        found = saved(classes.select("uid", F.xxhash64("label").alias("component")), "whole")

    def cosines(codes, bodies):
        v = unit(np.frombuffer(b"".join(bodies), kind).reshape(len(bodies), -1))
        near = v @ v.T >= threshold
        return near & within(codes)(np.arange(len(v))[:, None], np.arange(len(v))[None, :]) if width else near

    def packed(batches):
        import pyarrow as pa

        for b in batches:
            v = b.column("v").flatten().to_numpy().astype(kind).reshape(b.num_rows, dim)
            code = codes.value.encode(unit(v)) if len(v) else v
            out = [*(b.column(c) for c in ("component", "n", "uid", "weight")), *(pa.array([y.tobytes() for y in x], pa.binary()) for x in (code, v))]
            yield pa.RecordBatch.from_arrays(out, ["component", "n", "uid", "weight", "code", "body"])

    # Components never cross labels: a bucket holds one label. A colliding bucket hash is undone here.
    sizes = found.groupBy("component").agg(F.count("*").alias("n"))
    members = saved(found.join(sizes, "component").join(classes, "uid").select(F.xxhash64("component", "label").alias("component"), "n", "uid", "weight", "v"), "candidates")
    counts, edges, links = exact_links(members.mapInArrow(packed, "component long, n long, uid long, weight long, code binary, body binary"), cosines, block=128 if width else 1024)
    discard(found, members)
    return counts, edges, links
