"""Packing documents into fixed-length sequences by first-fit decreasing over a tournament tree of bin capacities.

Documents are dealt at random (a seeded hash) to groups of about ``group_bytes`` text, and every group is packed on its own. A
document of more ids than a sequence first fills whole sequences; what remains is an item. Items go, longest first, to the
first bin with room, which the tree of largest remaining capacities finds in logarithmic time. A bin left with
more than ``slack`` free places is cut into sequences whose lengths are powers of two, which need no padding.

Null texts are empty: their document is the end id alone. Texts of any length are encoded whole, one at a time in a task. Equal lengths are placed in the order of
(doc_id, text). Rows that repeat a doc_id are documents of their own; their pieces
share that id. A null doc_id stays null. Empty tables give empty results. Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import text_batches, tidied
from corpusloom.llm.pieces import pieces

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class Tournament:
    """Leaves are the free places of bins in the order of their opening; every inner node has the larger of its two."""

    def __init__(self, bins: int, capacity: int):
        self.width = 1
        while self.width < max(1, bins):
            self.width *= 2
        self.free = [capacity] * (2 * self.width)

    def take(self, size: int) -> tuple[int, int]:
        """Puts ``size`` into the first bin that has room: (bin, free places before)."""
        free, at = self.free, 1
        while at < self.width:
            at *= 2
            if free[at] < size:
                at += 1
        before = free[at]
        free[at] = before - size
        leaf = at - self.width
        while at > 1:
            at //= 2
            top = max(free[2 * at], free[2 * at + 1])
            if free[at] == top:
                break
            free[at] = top
        return leaf, before


def pack(lengths: list[int], capacity: int, slack: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; documents are numbered by their place in ``lengths``."""
    out, sequence = [], 0
    items = []
    for d, n in enumerate(lengths):
        full = n // capacity
        for k in range(full):
            out.append((d, k * capacity, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            items.append((n % capacity, d, full * capacity))
    items.sort(key=lambda x: (-x[0], x[1]))
    tree = Tournament(len(items), capacity)
    bins: dict[int, list[tuple[int, int, int]]] = {}
    for size, d, start in items:
        bins.setdefault(tree.take(size)[0], []).append((d, start, size))
    for held in bins.values():
        fill = sum(x[2] for x in held)
        parts = [fill]
        if capacity - fill > slack:
            parts = [1 << b for b in range(fill.bit_length() - 1, -1, -1) if fill >> b & 1]
        room, offset = parts.pop(0), 0
        for d, start, size in held:
            while size:
                if offset == room:
                    sequence, room, offset = sequence + 1, parts.pop(0), 0
                now = min(size, room - offset)
                out.append((d, start, now, sequence, offset))
                start, size, offset = start + now, size - now, offset + now
        sequence += 1
    return out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, slack: int = 32, group_bytes: int = 8 << 20, keeps_space: bool = False, seed: int = 23) -> DataFrame:
    """One row per piece: SCHEMA. ``ids`` are little-endian unsigned 32-bit, as the checksum takes them."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    groups = max(1, -(-int(total) // group_bytes))
    keyed = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", F.lit(seed), F.xxhash64("text")), F.lit(groups)).cast("int"))
    dealt = keyed.repartitionById(groups, F.col("g")).sortWithinPartitions("g", "doc_id", "text")

    def packed(batches):
        import pyarrow as pa

        enc = pieces(tokenizer, keeps_space)
        end = np.array([end_id], enc.kind)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        group, doc_ids, ids = None, [], []

        def finish():
            placed = pack([len(x) for x in ids], capacity, slack)
            for i in range(0, len(placed), 4096):
                part = placed[i : i + 4096]
                bodies = [ids[d][s : s + n].astype("<u4").tobytes() for d, s, n, _, _ in part]
                cols = [[doc_ids[p[0]] for p in part], [p[1] for p in part], [p[2] for p in part], [zlib.crc32(b) for b in bodies], [len(ids[p[0]]) for p in part], [(group << 32) + p[3] for p in part], [p[4] for p in part]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(bodies, pa.binary())], names)

        for b in batches:
            for doc_id, text, g in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if g != group:
                    if ids:
                        yield from finish()
                    group, doc_ids, ids = g, [], []
                doc_ids.append(doc_id)
                ids.append(np.concatenate([enc.encode(text), end]))
        if ids:
            yield from finish()

    return dealt.mapInArrow(tidied(packed), SCHEMA)
