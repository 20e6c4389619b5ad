"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by the set of sources they belong to. From the sets' word counts, a flow routes words to the
sources' quotas; every further repetition of a set costs more than the one before (0, 1, 2, ...), so that text is repeated only
where no fresh text is left. The flow's amounts are then turned into documents: each set is laid out in the order of a
seeded hash, taken whole as often as the flow says, and once more up to the remaining words; the last document is cut there.

Sizes are runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return; null texts have
size 0. Documents of no source are never taken. Null sources count as one source of their own, the last. A source
without words has target 0. Rows that repeat a doc_id are documents of their own, ordered among themselves by their text's
hash. Texts of any length are counted whole, one at a time in a task. Empty tables give empty results. Columns beyond doc_id, text and the sources are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import if_small, saved, seeded

WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def targets(sizes: dict[str, int], weights: dict[str, float], total: int, copies: int) -> dict[str, float]:
    """Shares ``total`` by weight; what passes ``copies`` times a source's size is shared again among the others."""
    order = sorted(sizes, key=lambda s: (copies * sizes[s] / weights[s], s))
    left, weight, out = total, sum(weights.values()), {}
    for i, s in enumerate(order):
        cap = copies * sizes[s]
        if cap / weights[s] > left / weight:
            return out | {x: left / weight * weights[x] for x in order[i:]}
        out[s] = float(cap)
        left, weight = left - cap, weight - weights[s]
    return out


class _Routes:
    """The arcs of a flow from sets to the sources they name, as arrays; the paths run between sources, over all sets at once."""

    def __init__(self, supply: list[tuple[int, list[int]]], quotas: list[int]):
        degrees = np.array([len(x) for _, x in supply], np.int64)
        self.first = np.concatenate([[0], np.cumsum(degrees)])  # of each set's arcs
        self.source = np.array([s for _, x in supply for s in x], np.int64)
        self.set = np.repeat(np.arange(len(supply)), degrees)
        self.flow = np.zeros(len(self.source), np.int64)
        self.rest = np.zeros(len(supply), np.int64)  # words of each set that have no way yet
        self.room = np.array(quotas, np.int64)
        by_source = np.argsort(self.source, kind="stable")
        self.of = np.split(by_source, np.searchsorted(self.source[by_source], np.arange(1, len(quotas)))) if quotas else []

    def _arcs(self, sets: np.ndarray) -> np.ndarray:
        n = self.first[sets + 1] - self.first[sets]
        return np.repeat(self.first[sets] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())

    def path(self) -> list[int] | None:
        """The shortest list of sources that leads from words without a way to a source with room: each can hand words on to the next."""
        waiting = np.flatnonzero(self.rest)
        before = {int(s): None for s in np.unique(self.source[self._arcs(waiting)])}
        now = list(before)
        while now:
            for s in now:
                if self.room[s]:
                    out = []
                    while s is not None:
                        out.append(s)
                        s = before[s]
                    return out[::-1]
            later = []
            for s in now:
                holding = self.set[self.of[s][self.flow[self.of[s]] > 0]]
                for t in np.unique(self.source[self._arcs(holding)]).tolist():
                    if t not in before:
                        before[t] = s
                        later.append(t)
            now = later
        return None

    def push(self, path: list[int]) -> None:
        """As many words as the path takes, from all sets that have some for it."""
        start = self.of[path[0]]
        moves = [(start, self.rest[self.set[start]])]  # arcs that gain and how much they may
        for s, t in zip(path, path[1:], strict=False):
            gains = self.of[t]
            loses = self.of[s]
            has = np.zeros(len(self.rest), np.int64)
            has[self.set[loses]] = self.flow[loses]
            moves.append((gains, has[self.set[gains]]))
        amount = min(int(self.room[path[-1]]), *(int(m.sum()) for _, m in moves))
        for k, (gains, most) in enumerate(moves):
            upto = np.minimum(np.cumsum(most), amount)
            given = np.diff(upto, prepend=0)
            self.flow[gains] += given
            taken = np.zeros(len(self.rest), np.int64)
            taken[self.set[gains]] = given
            if k:
                loses = self.of[path[k - 1]]
                self.flow[loses] -= taken[self.set[loses]]
            else:
                self.rest -= taken
        self.room[path[-1]] -= amount


def min_cost_flow(supply: list[tuple[int, list[int]]], quotas: list[int], copies: int) -> list[dict[int, int]]:
    """For each (words, distinct sources) of ``supply`` the words that go to each source; the k-th repetition costs k a word.

    Costs lie on the repetitions alone, and the amounts that sets can send form a polymatroid, so the cheapest flow is found greedily: a largest flow
    with every word once, then more with every word twice, and so on; a flow is only ever extended. Each extension takes all sets along a shortest path of sources at once.
    """
    routes = _Routes(supply, quotas)
    words = np.array([w if x else 0 for w, x in supply], np.int64)
    for _ in range(copies):
        routes.rest += words
        while (path := routes.path()) is not None:
            routes.push(path)
    out: list[dict[int, int]] = [{} for _ in supply]
    used = np.flatnonzero(routes.flow)
    for i, s, f in zip(routes.set[used].tolist(), routes.source[used].tolist(), routes.flow[used].tolist(), strict=True):
        out[i][s] = f
    return out


def sums_before(rows: DataFrame, keys: list[str], at: str, value: str, fan: int = 4096) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the key's rows with a smaller ``at`` (distinct whole numbers from 0).

    Runs of ``fan`` numbers are summed first, so that a window sorts no more than the runs of a key, or the rows of a run.
    """
    run = F.expr(f"{at} div {fan}L").alias("_run")
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy(*keys, run).agg(F.sum(value).alias("_s"))
    runs = runs.select(*keys, "_run", F.coalesce(F.sum("_s").over(earlier(*keys).orderBy("_run")), F.lit(0)).alias("_runs"))
    within = F.coalesce(F.sum(value).over(earlier(*keys, "_run").orderBy(at)), F.lit(0))
    return rows.withColumn("_run", run).withColumn("_within", within).join(runs, [*keys, "_run"]).withColumn("before", F.col("_runs") + F.col("_within")).drop("_run", "_within", "_runs")


def mix(docs: DataFrame, sources: Column | None = None, copies: int = 3, cycle: tuple[int, ...] = (1, 2, 3), weights: dict[str, float] | None = None, seed: int = 17, bucket_docs: int = 512, most_sets: int = 1_000_000) -> DataFrame:
    """One row per document: doc_id, text_key, size, source_size, target, taken, taken_by.

    ``sources`` is an array of the source names of a document (default: its column source). Without ``weights`` (by name) the
    sources in order of code points weigh ``cycle``, repeating. ``taken`` counts the words the mix takes, repetitions included, at most
    ``copies`` times the size; ``taken_by`` splits them by source. source_size and target are those of the document's sole source, null if it
    has several. The driver sees a row for each set of sources; more than ``most_sets`` of them raise an error.
    """
    sets = F.array_sort(F.array_distinct(F.transform(sources if sources is not None else F.array("source"), source_key)))
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), size_of(F.col("text")).alias("size"), seeded(seed, "doc_id").alias("h"), F.coalesce(sets, F.array().cast("array<string>")).alias("sources"))
    rows = saved(rows, "sizes")
    groups = rows.groupBy("sources").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    found = sorted((r["sources"], r["words"], r["n"]) for r in groups.limit(most_sets + 1).collect())
    if len(found) > most_sets:
        raise ValueError(f"more than {most_sets} sets of sources")
    names = sorted({s for g, _, _ in found for s in g})
    weigh = {s: cycle[i % len(cycle)] if weights is None else weights[s[1:] if s[0] == "0" else None] for i, s in enumerate(names)}
    own = {s: sum(w for g, w, _ in found if s in g) for s in names}
    total = sum(w for g, w, _ in found if g)
    target = {s: round(t, 6) for s, t in targets(own, weigh, total, copies).items()}
    index = {s: i for i, s in enumerate(names)}
    flow = min_cost_flow([(w, [index[s] for s in g]) for g, w, _ in found], [int(target[s] + 0.5) for s in names], copies)
    plan = []
    for (g, w, _), f in zip(found, flow, strict=True):
        spans, at = [], 0
        for s in sorted(f):
            spans.append((names[s], at, at + f[s]))
            at += f[s]
        plan.append((g, w, own[g[0]] if len(g) == 1 else None, target[g[0]] if len(g) == 1 else None, at, spans))
    spark = docs.sparkSession
    plan = spark.createDataFrame(plan, "sources array<string>, words long, source_size long, target double, routed long, spans array<struct<source: string, a: long, b: long>>")
    # A set may hold a third of all rows: positions come from sums over slices of the hash, then from within a slice.
    width = (1 << 60) // max(1, -(-sum(n for _, _, n in found) // bucket_docs)) + 1
    rows = rows.withColumn("slice", F.expr(f"h div {width}L"))
    slices = rows.groupBy("sources", "slice").agg(F.sum("size").alias("s"))
    before = sums_before(slices, ["sources"], "slice", "s").select("sources", "slice", "before")
    within = Window.partitionBy("sources", "slice").orderBy("h", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("upto", F.sum("size").over(within)).join(before, ["sources", "slice"]).join(if_small(plan, 10_000), "sources")
    first = F.col("before") + F.col("upto") - F.col("size")
    rounds = F.when(F.col("words") > 0, F.expr("routed div words")).otherwise(0)
    rest = F.col("routed") - rounds * F.col("words")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - first))
    placed = placed.withColumn("first", first).withColumn("taken", taken.cast("long"))
    share = """filter(transform(spans, s -> struct(s.source as source, aggregate(transform(sequence(0, if(words > 0, routed div words, 0L)), k -> greatest(0L, least(s.b, k * words + first + size) - greatest(s.a, k * words + first))), 0L, (x, y) -> x + y) as words)), x -> x.words > 0)"""
    by = F.transform(F.expr(share), lambda x: F.struct(F.when(x["source"] != "1", F.substr(x["source"], F.lit(2))).alias("source"), x["words"].alias("words")))
    return placed.select("doc_id", "text_key", "size", "source_size", "target", "taken", by.alias("taken_by"))
