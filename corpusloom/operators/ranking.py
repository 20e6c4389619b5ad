"""Ranking: fusion, normalisers, cutoffs, diversity, de-duplication. Windows are over a query's hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.tables import ranged


def _by(keys: list[str], *order) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def reciprocal_rank_fusion(lists: DataFrame, query: str, item: str, rank: str, k: int = 60) -> DataFrame:
    """Sum of 1 / (k + rank) over all lists that hold the item; lists are rows of one table."""
    return lists.groupBy(query, item).agg(F.sum(1 / (k + F.col(rank))).alias("score"))


def merge_lexical_semantic(lexical: DataFrame, semantic: DataFrame, key: list[str], boost: float = 1.1) -> DataFrame:
    """Full outer join; the larger score, hybrid where both have it; lexical hits by tag are boosted first."""
    lex = lexical.select(*key, (F.col("score") * F.when(F.col("by_tag"), boost).otherwise(1.0)).alias("lex"))
    sem = semantic.select(*key, F.col("score").alias("sem"))
    source = F.when(F.col("lex").isNotNull() & F.col("sem").isNotNull(), "hybrid").when(F.col("lex").isNotNull(), "lexical").otherwise("semantic")
    return lex.join(sem, key, "full_outer").select(*key, F.greatest("lex", "sem").alias("score"), source.alias("source"))


def filter_over_search(filtered: DataFrame, search: DataFrame, key: str = "path") -> DataFrame:
    """All filtered rows and the searched ones whose key isn't among them; null keys stay."""
    rest = search.join(filtered.select(key).distinct(), key, "left_anti").select(*search.columns)
    return filtered.withColumn("origin", F.lit("filter")).unionByName(rest.withColumn("origin", F.lit("search")))


def min_max(hits: DataFrame, query: str, score: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Scaled to [low, high] within a query, 0.5 if all scores are equal. Bounds are aggregated, then joined."""
    b = hits.groupBy(query).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    scaled = F.when(F.col("_hi") == F.col("_lo"), 0.5).otherwise(F.lit(low) + F.try_divide(F.col(score) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * (high - low))
    return hits.join(b, query).withColumn("normalised", scaled).drop("_lo", "_hi")


def z_score(hits: DataFrame, query: str, score: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """0.5 + 0.5 tanh(z / 2.5), clipped; 0.5 without deviation."""
    b = hits.groupBy(query).agg(F.avg(score).alias("_m"), F.stddev_pop(score).alias("_s"))
    z = F.try_divide(F.col(score) - F.col("_m"), F.col("_s"))
    return hits.join(b, query).withColumn("normalised", F.when(F.col("_s") == 0, 0.5).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), 0.5 + 0.5 * F.tanh(z / 2.5))))).drop("_m", "_s")


def percentile(hits: DataFrame, query: str, score: str, tie: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Place among a query's ascending scores, scaled; 0.5 for one hit."""
    placed = numbered(hits, [query], [F.col(score), F.col(tie)])
    n = hits.groupBy(query).agg(F.count("*").alias("_n"))
    return placed.join(n, query).withColumn("normalised", F.when(F.col("_n") == 1, 0.5).otherwise(low + F.try_divide(F.col("place") - 1, F.col("_n") - 1) * (high - low))).drop("_n", "place")


def numbered(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """row_number over ``keys`` as column ``place``, without sorting a whole key in one task.

    Rows are dealt to ranges of keys and order, so that a key of a third of all rows, or with many equal values, spans as many tasks as it
    fills. The rows of a key before a range are counted by aggregation. Rows that share keys and order are numbered in any order.
    """
    dealt = ranged(rows, [F.col(k) for k in keys], order)
    counts = dealt.groupBy(*keys, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_c"))
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # a row a range
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(by.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    same = F.lit(True)
    for k in [*keys, "_range"]:
        same = same & F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}"))
    met = dealt.alias("_l").join(before.alias("_r"), same)
    return met.select(*(F.col(f"_l.{c}") for c in rows.columns), (F.col("_r._before") + F.col("_l._at") - F.col("_r._first") + 1).cast("long").alias("place"))


def statistics(rows: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """Mean, population deviation, least, largest and upper median."""
    s = rows.groupBy(key).agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.min(score).alias("min"), F.max(score).alias("max"))
    middle = numbered(rows, [key], [F.col(score), F.col(tie)]).join(s.select(key, "n"), key).where(F.col("place") == F.floor(F.col("n") / 2) + 1)
    return s.join(middle.select(key, F.col(score).alias("median")), key)


def _contenders(query: str, note: str, score: str, tie: str, limit: int, most: int = 200_000):
    """Of any part of the hits, those that can be in ``diverse_top`` of all: the best hits of a query's ``limit`` best notes, and its 2 ``limit`` best hits.

    If a note's best hit is left out, ``limit`` notes have better ones, so none of its hits counts. Further hits count only if a query has fewer than
    ``limit`` notes; such a hit then has less than ``limit`` best ones and ``limit`` further ones before it. Hits without a score or tie stay. At most about ``most`` rows are held.
    """

    def contenders(batches):
        import pyarrow as pa

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= most:
                kept = reduced(pa.Table.from_batches(held)).combine_chunks()
                held, n = kept.to_batches(), kept.num_rows
                if n > most // 2:
                    yield from held
                    held, n = [], 0
        if n:
            yield from reduced(pa.Table.from_batches(held)).to_batches()

    def reduced(t):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        code = lambda c: t.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        blank = np.zeros(t.num_rows, bool)
        for c in (score, tie):
            blank |= t.column(c).is_null(nan_is_null=True).to_numpy()
        order = pc.sort_indices(t.select([score, tie]), sort_keys=[(score, "descending"), (tie, "ascending")]).to_numpy().astype(np.int64)
        order = order[~blank[order]]
        q, k = code(query)[order], code(note)[order]
        best = np.sort(np.unique(q * (t.num_rows + 1) + k, return_index=True)[1])
        places = np.concatenate([order[best[_heads(q[best], limit)]], order[_heads(q, 2 * limit)], np.flatnonzero(blank)])
        return t.take(pa.array(np.unique(places)))

    return contenders


def _heads(keys, n: int):
    """The places of the first ``n`` of each key."""
    import numpy as np

    by = np.argsort(keys, kind="stable")
    at = np.arange(len(by))
    starts = np.concatenate([[True], keys[by][1:] != keys[by][:-1]])[: len(by)]
    return by[at - np.maximum.accumulate(np.where(starts, at, 0)) < n]


def diverse_top(hits: DataFrame, query: str, note: str, score: str, tie: str, limit: int) -> DataFrame:
    """The best of every note first, then the next best, ``limit`` in all; numbered by score.

    What can't be among them is left out where the rows are read, so that only few rows are dealt out and sorted.
    """
    hits = hits.mapInArrow(_contenders(query, note, score, tie, limit), hits.schema)
    first = F.row_number().over(_by([query, note], F.desc(score), tie))
    ranked = hits.withColumn("_again", (first > 1).cast("int"))
    top = ranked.withColumn("_rn", F.row_number().over(_by([query], "_again", F.desc(score), tie))).where(F.col("_rn") <= limit)
    return top.withColumn("rank", F.row_number().over(_by([query], F.desc(score), tie))).drop("_again", "_rn")


def adaptive_cutoff(hits: DataFrame, query: str, score: str, tie: str, floor: int = 3, ceiling: int = 30, relative: float = 0.3, absolute: float = 0.01) -> DataFrame:
    """The first ``floor`` hits, and more up to ``ceiling`` as long as they reach the threshold."""
    ranked = hits.withColumn("rank", F.row_number().over(_by([query], F.desc(score), tie))).where(F.col("rank") <= ceiling)
    top = hits.groupBy(query).agg(F.greatest(F.max(score) * relative, F.lit(absolute)).alias("threshold"))
    return ranked.join(top, query).where((F.col("rank") <= floor) | (F.col(score) >= F.col("threshold")))


def diverse_cutoff(hits: DataFrame, query: str, note: str, score: str, tie: str, floor: int = 3, ceiling: int = 30, relative: float = 0.3, absolute: float = 0.01) -> DataFrame:
    """Each note's best hit first, as long as it reaches the threshold or the first ``floor`` aren't full, then further hits, ``ceiling`` in all.

    The threshold is a share of the query's best score, or ``absolute`` if that is more. Numbered by score. Only the best ``ceiling`` of a note
    and of a query go on from each step, as no more can be taken.
    """
    threshold = F.greatest(F.max(score) * relative, F.lit(absolute))
    limits = hits.groupBy(query).agg(threshold.alias("_t"))
    nth = F.row_number().over(_by([query, note], F.desc(score), tie))
    rows = hits.withColumn("_nth", nth).where(F.col("_nth") <= ceiling).withColumn("_again", (F.col("_nth") > 1).cast("int")).join(limits, query)
    # First the notes' best hits by score: those that fail the threshold come after all that don't, so a prefix is taken.
    first = rows.where("_again = 0").withColumn("_p", F.row_number().over(_by([query], F.desc(score), tie))).where(F.col("_p") <= ceiling)
    taken = first.where((F.col("_p") <= floor) | (F.col(score) >= F.col("_t")))
    held = taken.groupBy(query).agg(F.count("*").alias("_held"))
    left = rows.join(taken.select(query, tie), [query, tie], "left_anti")
    left = left.withColumn("_p", F.row_number().over(_by([query], F.desc(score), tie))).where(F.col("_p") <= ceiling).join(held, query)
    more = left.where((F.col("_held") + F.col("_p") <= ceiling) & ((F.col(score) >= F.col("_t")) | (F.col("_held") + F.col("_p") <= floor)))
    out = taken.select(*hits.columns).unionByName(more.select(*hits.columns))
    return out.withColumn("rank", F.row_number().over(_by([query], F.desc(score), tie)))


def best_per_key(rows: DataFrame, key: list[str], score: str, tie: str) -> DataFrame:
    """The row with the best score of each key, the first on ties; an aggregate, so that hot keys combine before the shuffle."""
    others = [c for c in rows.columns if c not in (*key, score, tie)]
    best = F.max_by(F.struct(score, tie, *others), F.struct(F.col(score), -F.col(tie)))
    return rows.groupBy(*key).agg(best.alias("_b")).select(*key, *(F.col(f"_b.{c}").alias(c) for c in (score, tie, *others)))


def folder_boost(hits: DataFrame, totals: DataFrame, least: int = 2, ratio: float = 0.4, cap: float = 1.15) -> DataFrame:
    """Scores of notes in folders of which a good share was hit, times min(1 + log2(n + 1) sqrt(share), cap)."""
    found = hits.groupBy("query", "folder").agg(F.countDistinct("note").alias("n")).join(totals, "folder")
    share = F.col("n") / F.col("total")
    factor = F.when((F.col("n") >= least) & (share >= ratio), F.least(1 + F.log2(F.col("n") + 1) * F.sqrt(share), F.lit(cap))).otherwise(1.0)
    return hits.join(found.select("query", "folder", factor.alias("factor")), ["query", "folder"], "left").withColumn("boosted", F.col("score") * F.coalesce("factor", F.lit(1.0)))


def graph_boost(candidates: DataFrame, edges: DataFrame, tags: DataFrame, strength: float = 0.1, cap: float = 1.15) -> DataFrame:
    """candidates (query, note, score): backlinks, shared citers and shared tags among a query's candidates raise the score."""
    c = candidates.select("query", "note")
    a, b = c.alias("a"), c.withColumnRenamed("note", "other").alias("b")
    back = a.join(edges, F.col("a.note") == edges["dst"]).select("query", "note", F.col("src").alias("other")).where("note <> other").join(b, ["query", "other"], "left_semi").groupBy("query", "note").agg(F.countDistinct("other").alias("backlinks"))
    cites = c.join(edges, c["note"] == edges["dst"]).select("query", "note", "src")
    tagged = c.join(tags, "note").select("query", "note", "tag")

    def shared(x: DataFrame, by: str, name: str) -> DataFrame:
        y = x.withColumnRenamed("note", "other")
        return x.join(y, ["query", by]).where("note <> other").groupBy("query", "note").agg(F.countDistinct("other").alias(name))

    out = candidates
    for x, name in ((back, "backlinks"), (shared(cites, "src", "co_citations"), "co_citations"), (shared(tagged, "tag", "shared_tags"), "shared_tags")):
        out = out.join(x, ["query", "note"], "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    s = F.col("backlinks") * 1.0 + F.col("co_citations") * 0.5 + F.col("shared_tags") * 0.3
    return out.withColumn("boosted", F.col("score") * F.least(1 + strength * F.log(1 + s), F.lit(cap)))


def best_with_bounds(hits: DataFrame, query: str, score: str, tie: str, limit: int) -> DataFrame:
    """(query, tie, score, rank, lo, hi): the best ``limit`` hits of each query, with the least and largest score of all its hits.

    Hits are read once and not kept: a task passes on no more than ``limit`` of a query, with the bounds it has seen.
    """
    rows = hits.select(query, tie, score)
    order = [(query, "ascending"), (score, "descending"), (tie, "ascending")]

    def pruned(table):
        import numpy as np
        import pyarrow.compute as pc

        table = table.sort_by(order)
        q = table.column(query).combine_chunks()
        begins = np.concatenate(([True], pc.fill_null(pc.not_equal(q.slice(1), q.slice(0, len(q) - 1)), True).to_numpy(zero_copy_only=False)))
        first = np.flatnonzero(begins)
        of = np.cumsum(begins) - 1
        lo = np.minimum.reduceat(table.column("lo").to_numpy(), first)[of]
        hi = np.maximum.reduceat(table.column("hi").to_numpy(), first)[of]
        keep = np.arange(len(of)) - first[of] < limit
        import pyarrow as pa

        table = table.set_column(3, "lo", pa.array(lo)).set_column(4, "hi", pa.array(hi))
        return table.filter(pa.array(keep))

    def task(batches):
        import pyarrow as pa

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                t = pa.Table.from_batches([batch])
                held.append(t.append_column("lo", t.column(score)).append_column("hi", t.column(score)))
                n += batch.num_rows
                if n > 500_000:
                    held = [pruned(pa.concat_tables(held))]
                    n = held[0].num_rows if held[0].num_rows < 250_000 else 0
        if held:
            yield from pruned(pa.concat_tables(held)).to_batches()

    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    few = rows.mapInArrow(task, ", ".join(f"`{c}` {kind[c]}" for c in (query, tie, score)) + ", lo double, hi double")
    w = Window.partitionBy(query)
    bounded = few.withColumn("rank", F.row_number().over(w.orderBy(F.desc(score), tie))).withColumn("lo", F.min("lo").over(w)).withColumn("hi", F.max("hi").over(w))
    return bounded.where(F.col("rank") <= limit)
