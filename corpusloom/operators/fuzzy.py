"""Fuzzy ranking: targets that hold a query's letters in their order, scored by how they lie."""

from __future__ import annotations

from heapq import heappush, heappushpop

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.tables import saved


def tree(words: list[str]) -> dict:
    """Words by their letters, each letter below those before it; "" holds a word's place in the list."""
    root: dict = {}
    for i, w in enumerate(words):
        at = root
        for c in w:
            at = at.setdefault(c, {})
        at[""] = i
    return root


def alignments(root: dict, target: str):
    """(place, score) of the words of a tree whose letters the target holds in their order, by the leftmost alignment.

    10 a letter, 15 more next to the one before, 10 more at a word's start; less the letters before the first (20 at most). Words with a
    common beginning are aligned once as far as it goes, and those whose beginning isn't in the target not at all.
    """
    open_ones = [(root, 0, 0)]
    while open_ones:
        node, at, score = open_ones.pop()
        for c, below in node.items():
            if c == "":
                yield below, score
                continue
            p = target.find(c, at) + 1
            if p:
                gain = (25 if p == at + 1 else 10) if at else 10 - min(p - 1, 20)
                open_ones.append((below, p, score + gain + (10 if p == 1 or target[p - 2] in " \t\n\x0b\f\r/_.-" else 0)))


def _best(limit: int):
    """The best ``limit`` targets of a part for each word of a block."""

    def best(asked, held):
        import pyarrow as pa

        words = asked.column("q").to_pylist()
        held = held.sort_by("id")  # of equal scores the smaller id counts, so the later row is the worse one
        root = tree(words)
        kept: list[list] = [[] for _ in words]
        for i, t in enumerate(held.column("t").to_pylist()):
            for k, score in alignments(root, t):
                row, own = (score - (len(t) - len(words[k])), -i), kept[k]
                if len(own) < limit:
                    heappush(own, row)
                else:
                    heappushpop(own, row)
        places = pa.array([k for k, own in enumerate(kept) for _ in own], pa.int64())
        rows = pa.array([-i for own in kept for _, i in own], pa.int64())
        scores = pa.array([s for own in kept for s, _ in own], pa.int32())
        return pa.table({"q": asked.column("q").take(places), "id": held.column("id").take(rows), "score": scores})

    return best


def fuzzy_top(queries: DataFrame, targets: DataFrame, limit: int = 10, letters: int = 400_000, part: int = 20_000) -> DataFrame:
    """(query, id, score, rank): the best ``limit`` targets (id, text) of each query (query, text), the smaller id first on ties.

    A score is that of the alignment less the letters left over. Letter case and a query's white space don't count; empty queries and null texts have no hits.
    Distinct queries are cut by their order into blocks of about ``letters`` letters, targets into parts of about ``part``; each block meets each part in a task of its
    own, where a tree of the queries' letters is followed through each target, so that a query costs nothing in targets that miss its beginning.
    """
    asked = saved(queries.select("query", F.lower(F.regexp_replace("text", r"\s+", "")).alias("q")).where("q <> ''").distinct(), "asked")
    held = saved(targets.where("text is not null").select("id", F.lower("text").alias("t")), "targets")
    total = asked.select("q").distinct().agg(F.coalesce(F.sum(F.length("q")), F.lit(0))).first()[0]
    blocks, parts = max(1, -(-total // letters)), max(1, -(-held.count() // part))
    words = saved(asked.select("q").distinct().repartitionByRange(blocks, "q").withColumn("block", F.spark_partition_id()), "blocks")
    last = words.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0]
    dealt = min(4 * (last + 1) * parts, 10_000)
    left = words.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(dealt, "block", "part")
    right = held.withColumn("part", F.pmod(F.xxhash64("id", "t"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(last)))).repartition(dealt, "block", "part")
    schema = T.StructType([T.StructField("q", T.StringType()), T.StructField("id", targets.schema["id"].dataType), T.StructField("score", T.IntegerType())])
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_best(limit), schema)
    best = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "id"))
    found = found.withColumn("rank", best("q")).where(F.col("rank") <= limit).join(asked, "q").select("query", "id", "score")
    return found.withColumn("rank", best("query")).where(F.col("rank") <= limit)
