"""Blocked comparison of groups and connected components, for the near-duplicate operators.

A group (an index bucket or a candidate component) may hold a third of all rows. Groups above ``block`` members are
cut into blocks by a hash of the member, and every pair of blocks is a task group of its own, so that no task ever
holds more than two blocks at a time. The block pairs of a group are dealt to tasks in turn. Tasks return counts and spanning
edges, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, join_counted, runs, saved, tidied


def block_pairs(members: DataFrame, group: str, member: str, size: str, block: int) -> DataFrame:
    """Members of groups of two or more, with one row for each pair of blocks ``bi <= bj`` that holds the member's block ``own``.

    ``size`` is the column with the number of members of the group. Rows come sorted by group and block pair within a partition.
    """
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    dealt = (
        members.where(F.col(size) > 1)
        .withColumn("_b", blocks)
        .withColumn("own", F.when(F.col("_b") > 1, F.pmod(F.xxhash64(member, F.lit(7)), F.col("_b")).cast("int")).otherwise(0))
        .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
        .withColumn("bi", F.least("own", "_o"))
        .withColumn("bj", F.greatest("own", "_o"))
        .drop(size, "_b", "_o")
    )
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pair = F.expr("bj * (bj + 1L) div 2 + bi")  # numbers the block pairs of a group
    return dealt.repartitionById(tasks, F.pmod(F.xxhash64(group) + pair, F.lit(tasks)).cast("int")).sortWithinPartitions(group, "bi", "bj", member)


def roots(n: int, edges) -> np.ndarray:
    """The smallest member index of each of ``n`` members' components."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(n)], dtype=np.int64)


def chain(ids: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the members of each component in a row, so that no member has a high degree."""
    order = np.lexsort((ids, root))
    same = root[order][1:] == root[order][:-1]
    return ids[order][:-1][same], ids[order][1:][same]


def sparse_links(n: int, similar: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Roots of the components of a group; ``similar(i, j)`` tells which of the pairs are linked.

    A small group compares all its pairs at once. In a larger one a member is compared only with those that aren't
    yet in its component: this loses no link between components, and a group of copies is settled by its first row of comparisons.
    """
    if n <= 64:
        i, j = np.triu_indices(n, 1)
        hit = similar(i, j)
        return roots(n, zip(i[hit].tolist(), j[hit].tolist(), strict=True))
    root = np.arange(n)
    for i in range(n - 1):
        rest = np.flatnonzero(root != root[i])
        rest = rest[rest > i]
        if len(rest):
            hit = np.unique(root[rest[similar(np.full(len(rest), i), rest)]])
            if len(hit):
                low = min(root[i], hit[0])
                root[np.isin(root, np.append(hit, root[i]))] = low
    return root


def code_matrix(column) -> np.ndarray:
    """Codes of equal length, a row for each; the column is a binary Arrow array."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.uint8).reshape(len(parts), -1)


def candidate_edges(members: DataFrame, similar_of: Callable, block: int = 2048) -> DataFrame:
    """(a, b) edges between members of the same bucket that ``similar_of`` lets through.

    members: ``bucket`` long, ``n`` long (members of the bucket), ``uid`` long, ``code`` binary. ``similar_of(codes)`` gets the codes
    of a group as a two-dimensional uint8 array and returns ``similar(i, j) -> mask`` over pairs of its rows.
    """

    def compare(batches):
        import pyarrow as pa

        for _, t in runs(batches, "bucket", "bi", "bj"):
            if t.num_rows < 2:
                continue
            ids = t.column("uid").to_numpy()
            a, b = chain(ids, sparse_links(len(ids), similar_of(code_matrix(t.column("code").combine_chunks()))))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return block_pairs(members.select("bucket", "n", "uid", "code"), "bucket", "uid", "n", block).mapInArrow(tidied(compare), "a long, b long")


def components(edges: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """(uid, component): the smallest uid that can be reached, for every uid that has an edge; a written table.

    The edges of a partition are first reduced to stars, ``chunk`` edges at a time. Each round then hooks: of the parents of a node the
    least stays, and the others become its children. It ends with a jump to the parents' parents, where parents of very many nodes are sent to
    every task. Both make ends of edges smaller, so the
    rounds end, with one star for each component. A round's tables go as soon as the next one's are there.
    """

    def stars(batches):
        import pyarrow as pa

        def reduced(parts):
            a, b = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            ids, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = roots(len(ids), zip(inverse[: len(a)].tolist(), inverse[len(a) :].tolist(), strict=True))
            child = np.flatnonzero(root != np.arange(len(ids)))
            return pa.RecordBatch.from_arrays([pa.array(ids[child]), pa.array(ids[root[child]])], ["a", "b"])

        held, n = [], 0
        for x in batches:
            held.append((x.column(0).to_numpy(), x.column(1).to_numpy()))
            n += x.num_rows
            if n >= chunk:
                yield reduced(held)
                held, n = [], 0
        if n:
            yield reduced(held)

    def hook(batches):
        import pyarrow as pa

        last, least = None, None  # the node that the batch before ended with, and its least parent
        for x in batches:
            if not x.num_rows:
                continue
            a, b = x.column(0).to_numpy(), x.column(1).to_numpy()
            first = np.r_[a[0] != last, a[1:] != a[:-1]]
            at = np.maximum.accumulate(np.where(first, np.arange(len(a)), -1))
            low = np.where(at >= 0, b[at], least if last is not None else 0)
            other = np.unique(np.stack([b[b != low], low[b != low]]), axis=1)
            last, least = a[-1], low[-1]
            out = [np.r_[a[first], other[0]], np.r_[b[first], other[1]], np.r_[np.zeros(first.sum(), bool), np.ones(other.shape[1], bool)]]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in out], ["a", "b", "changed"])

    now = saved(edges.where("a <> b").mapInArrow(tidied(stars), "a long, b long"), "stars")
    while True:
        hooked = saved(now.select("a", "b").repartition("a").sortWithinPartitions("a", "b").mapInArrow(hook, "a long, b long, changed boolean"), "hooked")
        parents = hooked.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("above"))
        above = saved(hooked.groupBy("b").agg(F.count("*").alias("n")).join(parents, "b", "left"), "above")
        jumped = join_counted(hooked, above, ["b"], "n", hot=1000).select("a", F.coalesce("above", "b").alias("b"), (F.col("changed") | F.col("above").isNotNull()).alias("changed"))
        before, now = now, saved(jumped, "jumped")
        discard(before, hooked, above)
        if not now.agg(F.bool_or("changed")).first()[0]:
            break
    found = saved(now.select(F.col("a").alias("uid"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("uid"), F.col("b").alias("component")).distinct()), "components")
    discard(now)
    return found


def with_least(members: DataFrame, value: str) -> DataFrame:
    """A written table that adds ``least``: the least ``value`` of the members' component ``c``. Components of very many members go to every task."""
    held = saved(members, "members")
    lows = saved(held.groupBy("c").agg(F.min(value).alias("least"), F.count("*").alias("_members")), "lows")
    out = saved(join_counted(held, lows, ["c"], "_members", hot=1000).drop("c", "_members", value), "per_class")
    discard(held, lows)
    return out


def exact_links(members: DataFrame, links_of: Callable, block: int = 128) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((uid, links), (a, b), the written table of both): how much weight every member links with inside its candidate component, and spanning edges.

    members: ``component`` long, ``n`` long (members of the component), ``uid`` long, ``weight`` long, ``code`` binary, ``body`` binary.
    ``links_of(codes, bodies)`` returns the boolean matrix of links among the members of one task group.
    """

    def compare(batches):
        import pyarrow as pa

        for (_, bi, bj), t in runs(batches, "component", "bi", "bj"):
            if t.num_rows < 2:
                continue
            ids, own, weight = (t.column(c).to_numpy() for c in ("uid", "own", "weight"))
            hit = links_of(code_matrix(t.column("code").combine_chunks()), t.column("body").to_pylist())
            np.fill_diagonal(hit, False)
            if bi != bj:  # links inside a block are counted where the block meets itself
                hit = hit & (own[:, None] != own[None, :])
            n = hit @ weight
            some = n > 0
            if not some.any():
                continue
            root = sparse_links(len(ids), lambda i, j, hit=hit: hit[i, j])
            a, b = chain(ids, root)
            out = [pa.array(np.concatenate([ids[some], a])), pa.array(np.concatenate([n[some], np.zeros(len(a), np.int64)])), pa.array(np.concatenate([np.full(some.sum(), -1), b]))]
            yield pa.RecordBatch.from_arrays(out, ["uid", "links", "other"])

    rows = block_pairs(members.select("component", "n", "uid", "weight", "code", "body"), "component", "uid", "n", block)
    out = saved(rows.mapInArrow(tidied(compare), "uid long, links long, other long"), "links")
    counts = out.where("other < 0").groupBy("uid").agg(F.sum("links").alias("links"))
    return counts, out.where("other >= 0").select(F.col("uid").alias("a"), F.col("other").alias("b")), out
