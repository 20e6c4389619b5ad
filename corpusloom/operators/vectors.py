"""Vector operators: cosine, exact nearest rows by pivots, threshold classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.tables import saved


def cosine(a: Column, b: Column) -> Column:
    """0 for lengths that differ, empty or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (norm == 0), 0.0).otherwise(F.try_divide(dot(a, b), norm))


def top_similar(queries: DataFrame, rows: DataFrame, k: int, least: float = -1.0, pivots: int = 64, block: int = 16_384, seed: int = 5) -> DataFrame:
    """(query, row, similarity, rank): the ``k`` rows most similar to each query vector, itself left out; the smaller id first on ties.

    Both sides are (id long, vector array); similarities are rounded to six places. Rows are dealt to the cells of ``pivots`` of them (for each length of vectors, by a
    seeded hash), and a cell knows its radius. A first pass meets each query with its nearest cell, which bounds the angle to its k-th row; a second one
    with all cells that the triangle inequality on angles doesn't rule out, so that the result is exact. Cells are met in blocks of ``block`` rows
    and queries, whatever the size of a cell; the driver sees pivots and radii only. Vectors that are null, empty, zero, or hold null or non-finite components
    have similarity 0 with everything, as have vectors of different lengths. Rows with a null id are left out.
    """
    spark = queries.sparkSession
    doubles = lambda t: t.where("id is not null").select("id", F.col("vector").cast("array<double>").alias("vector"))
    fine = F.exists("vector", lambda c: c != 0) & F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    classed = lambda t: doubles(t).withColumn("len", F.when(F.coalesce(fine, F.lit(False)), F.size("vector")).otherwise(-1))
    stored, asked = saved(classed(rows), "rows"), saved(classed(queries), "queries")
    order = Window.partitionBy("len").orderBy(F.xxhash64("id", F.lit(seed)), "id")
    chosen = stored.where("len > 0").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= pivots).orderBy("len", "_n").select("len", "vector").toPandas()
    cells = Cells.of(chosen)
    shared = spark.sparkContext.broadcast(cells)
    dealt = saved(stored.where("len > 0").select("id", "vector").mapInArrow(_nearest(shared), "cell int, angle double, id long, vector array<double>"), "cells")
    sizes = dealt.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()  # a row for each pivot
    told = spark.sparkContext.broadcast({r["cell"]: (r["radius"], -(-r["n"] // block)) for r in sizes})
    parts = spark.createDataFrame([(r["cell"], -(-r["n"] // block)) for r in sizes], "cell int, parts int")
    held = dealt.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).drop("parts", "angle")

    def met(reaching: DataFrame) -> DataFrame:
        """Queries (query, vector, cell, part) against the rows of these parts of cells."""
        reaching = saved(reaching, "reaching")
        many = reaching.groupBy("cell", "part").agg(F.ceil(F.count("*") / block).cast("int").alias("turns"))
        turned = reaching.join(many, ["cell", "part"]).withColumn("turn", F.pmod(F.xxhash64("query"), "turns").cast("int"))
        there = held.join(many, ["cell", "part"]).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
        keys = ["cell", "part", "turn"]
        out = turned.select(*keys, "query", "vector").groupBy(*keys).cogroup(there.select(*keys, "id", "vector").groupBy(*keys))
        return out.applyInArrow(_best(k), "query long, row long, similarity double")

    best = Window.partitionBy("query").orderBy(F.desc("similarity"), "row")
    first = saved(met(asked.where("len > 0").select("id", "vector").mapInArrow(_reach(shared, told, None), "query long, vector array<double>, cell int, part int")), "first")
    bound = first.withColumn("_n", F.row_number().over(best)).where(F.col("_n") == k).select(F.col("query").alias("id"), F.col("similarity").alias("bound"))
    bounded = asked.where("len > 0").join(bound, "id", "left").select("id", "vector", F.greatest(F.coalesce("bound", F.lit(-1.0)), F.lit(float(least))).alias("bound"))
    near = met(bounded.mapInArrow(_reach(shared, told, 1e-6), "query long, vector array<double>, cell int, part int"))
    # Rows without a direction, or of another length, have similarity 0: the smallest k + 1 ids of them can matter to a query.
    low = stored.withColumn("_n", F.row_number().over(Window.partitionBy("len").orderBy("id"))).where(F.col("_n") <= k + 1).select(F.col("len").alias("other"), F.col("id").alias("row"))
    kinds = asked.select("len").distinct()
    far = kinds.join(low, (F.col("len") != F.col("other")) | (F.col("len") < 0)).withColumn("_n", F.row_number().over(Window.partitionBy("len").orderBy("row"))).where(F.col("_n") <= k + 1)
    zero = asked.select(F.col("id").alias("query"), "len").join(far.select("len", "row"), "len").where("query <> row").select("query", "row", F.lit(0.0).alias("similarity"))
    found = near.unionByName(zero).where(F.col("similarity") >= least)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


class Cells:
    """Pivots by length of vectors, as unit vectors; cells are numbered over all of them."""

    def __init__(self, pivots: dict):
        self.pivots = pivots
        self.first, n = {}, 0
        for d, p in pivots.items():
            self.first[d], n = n, n + len(p)

    @classmethod
    def of(cls, chosen) -> Cells:
        import numpy as np

        out = {}
        for d, group in chosen.groupby("len"):
            v = np.array(group["vector"].tolist(), float)
            v /= np.abs(v).max(axis=1, keepdims=True)
            out[int(d)] = v / np.linalg.norm(v, axis=1, keepdims=True)
        return cls(out)


def _angles(x, y):
    import numpy as np

    return np.arccos(np.clip(x @ y.T, -1, 1))


def _nearest(shared):
    """Rows with the cell of their nearest pivot and the angle to it."""

    def nearest(batches):
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for first in range(0, whole.num_rows, 2048):
                b = whole.slice(first, 2048)
                for d, (places, v) in unit_vectors(b.column("vector")).items():
                    a = _angles(v, shared.value.pivots[d])
                    own = a.argmin(axis=1)
                    at = pa.array(places)
                    yield pa.RecordBatch.from_arrays([pa.array((own + shared.value.first[d]).astype(np.int32)), pa.array(a[np.arange(len(own)), own]), b.column("id").take(at), b.column("vector").take(at)], ["cell", "angle", "id", "vector"])

    return nearest


def reached(angles, radii, bound, rounding: float):
    """Which cells may hold a row as similar as ``bound``: the angle to one is at least the angle to its pivot less its radius."""
    import numpy as np

    most = np.arccos(np.clip(bound - rounding, -1, 1))
    return angles - radii <= most[:, None] + 1e-7  # single steps of arccos near 0 and pi are up to 1.5e-8


def _reach(shared, told, rounding: float | None):
    """The parts of cells that each query meets: those of its nearest cell without ``rounding``, else those that its bound doesn't rule out."""

    def reach(batches):
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                b = whole.slice(first, 512)
                for d, (places, v) in unit_vectors(b.column("vector")).items():
                    if d not in shared.value.pivots:
                        continue
                    start = shared.value.first[d]
                    a = _angles(v, shared.value.pivots[d])
                    n = a.shape[1]
                    radii = np.array([told.value.get(start + c, (-np.inf, 0))[0] for c in range(n)])
                    parts = np.array([told.value.get(start + c, (0, 0))[1] for c in range(n)])
                    if rounding is None:
                        hit = np.zeros(a.shape, bool)
                        hit[np.arange(len(a)), np.where(parts > 0, a, np.inf).argmin(axis=1)] = True
                    else:
                        hit = reached(a, radii, b.column("bound").to_numpy()[places], rounding)
                    q, c = np.nonzero(hit & (parts > 0))
                    times = parts[c]
                    q, c = np.repeat(q, times), np.repeat(c, times)
                    part = np.arange(len(q)) - np.repeat(np.cumsum(times) - times, times)
                    for i in range(0, len(q), 8192):
                        at = pa.array(places[q[i : i + 8192]])
                        yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("vector").take(at), pa.array((c[i : i + 8192] + start).astype(np.int32)), pa.array(part[i : i + 8192].astype(np.int32))], ["query", "vector", "cell", "part"])

    return reach


def _best(k: int):
    """The best ``k`` rows of a block for each of its queries."""

    def best(asked, rows):
        import numpy as np
        import pyarrow as pa

        out = {"query": [np.zeros(0, np.int64)], "row": [np.zeros(0, np.int64)], "similarity": [np.zeros(0)]}
        if asked.num_rows and rows.num_rows:
            ids, mine = asked.column("query").to_numpy(), rows.column("id").to_numpy()
            order = np.argsort(mine, kind="stable")  # of equal ones the smaller id comes first
            mine = mine[order]
            ((_, v),) = unit_vectors(rows.column("vector")).values()
            ((_, u),) = unit_vectors(asked.column("vector")).values()
            v = v[order]
            for at in range(0, len(ids), 64):
                s = np.round(u[at : at + 64] @ v.T, 6)
                s[ids[at : at + 64, None] == mine[None, :]] = -np.inf
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                value = np.take_along_axis(s, top, 1)
                some = np.isfinite(value)
                out["query"].append(np.repeat(ids[at : at + 64], some.sum(axis=1)))
                out["row"].append(mine[top][some])
                out["similarity"].append(value[some])
        return pa.table({c: np.concatenate(x) for c, x in out.items()})

    return best


def unit_vectors(column) -> dict:
    """length -> (places, unit vectors) of an Arrow array of lists; vectors without a direction are in none."""
    import numpy as np

    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(lengths[lengths > 0]).tolist():
        places = np.flatnonzero(lengths == d)
        v = column.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)  # null components are NaN
        size = np.abs(v).max(axis=1)
        fine = np.isfinite(size) & (size > 0)
        v = v[fine] / size[fine, None]
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        out[d] = places[fine], v
    return out


def category(similarity: Column) -> Column:
    return F.when(similarity > 0.7, 3).when(similarity > 0.55, 2).otherwise(1)


def related_notes(vectors: DataFrame, note: Column, links: DataFrame, asked: DataFrame, k: int = 20, weight: float = 0.7) -> DataFrame:
    """(query, note, score, similarity, category, place): notes like those asked for or linked with them, by category of similarity and then by score.

    vectors (id, vector) of chunks, ``note`` the note of an id; links (query, note, links, backlinks); asked (query). A note's similarity is
    that of its nearest chunk; it counts ``weight``, and a link 0.3 in both directions, 0.24 in one.
    """
    mine = vectors.withColumn("_n", note).join(asked.select(F.col("query").alias("_n")).distinct(), "_n", "left_semi")
    found = top_similar(mine.select("id", "vector"), vectors, k)
    of = vectors.select("id", note.alias("_n"))
    pairs = found.join(of.select(F.col("id").alias("query"), F.col("_n").alias("q")), "query").join(of.select(F.col("id").alias("row"), F.col("_n").alias("note")), "row").where("q <> note")
    best = pairs.groupBy(F.col("q").alias("query"), "note").agg(F.max("similarity").alias("similarity"))
    best = best.withColumn("_rn", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "note"))).where(F.col("_rn") <= k).drop("_rn")
    bonus = links.select("query", "note", F.when(F.col("links") & F.col("backlinks"), 0.3).otherwise(0.24).alias("bonus"))
    s = F.coalesce("similarity", F.lit(0.0))
    both = best.join(bonus, ["query", "note"], "full_outer").select("query", "note", F.round(weight * s + F.coalesce("bonus", F.lit(0.0)), 9).alias("score"), "similarity", category(s).alias("category"))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("category"), F.desc("score"), "note")))


def recall_memories(memories: DataFrame, queries: DataFrame, now: Column, k: int = 5, least: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """((query, id, similarity, rank), memories with their counters): the best ``k`` for each query of those that are neither deleted nor sensitive.

    memories (id, vector, deleted, sensitive, accesses, accessed), queries (id, vector) by ids of their own. Each time a memory is recalled counts an access;
    its last access is then ``now``.
    """
    open_ones = memories.where(~F.coalesce("deleted", F.lit(False)) & ~F.coalesce("sensitive", F.lit(False)))
    found = top_similar(queries.select((-1 - F.col("id")).alias("id"), "vector"), open_ones.select("id", "vector"), k, least)
    found = found.select((-1 - F.col("query")).alias("query"), F.col("row").alias("id"), "similarity", "rank")
    times = found.groupBy("id").agg(F.count("*").alias("_n"))
    counted = memories.join(times, "id", "left").withColumn("accesses", F.col("accesses") + F.coalesce("_n", F.lit(0))).withColumn("accessed", F.when(F.col("_n").isNotNull(), now).otherwise(F.col("accessed"))).drop("_n")
    return found, counted
