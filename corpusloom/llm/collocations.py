"""Phrases whose words keep company, mined best first for each language.

A text is lower-cased (A-Z), cut at ``.,;:!?`` and line ends into pieces, and those at spaces and tabs into words. A phrase of 2 to 4 words that
occurs ``least`` times or more is a candidate. Cut after its first k words, it scores floor(2000000 a / (l + r)) from its own count a and those of
its two parts; its lowest cut counts. A candidate that a longer one with 80 % of its count or more holds is dropped. Each language's
first ``top`` survivors are the result.

Phrases grow from their prefixes, and counts of prefixes bound what may grow from them: an extension of p has at most f(p) occurrences, and its first
cut gives it 2000000 f(p) / (f(first word) + f(p)) at most, a bound that falls as p grows. The frontier begins with all pairs of frequent words. The search
goes in rounds, each with a floor for each language: first the score of a pair somewhat behind the ``top``-th, then of one farther behind, in the end 0. A
round extends the prefixes whose bound reaches the floor, longer and longer. All that scores the floor or more is then known, with its parts
(counted on demand) and its extensions to both sides (which decide whether it's dropped: a longer phrase can't be more frequent than the one-word
extension that it holds). A language with ``top`` survivors at the floor or above, which includes all ties of the last, is settled and leaves the search;
the others go on. Work of earlier rounds isn't repeated.

The corpus is written once as blocks of word numbers with their own dictionaries; rare words, which no candidate holds, become gaps. A scan reads
blocks and counts what it is told to. What is frequent and what to extend is told by Bloom filters of a fixed size (``filter_bits``, whatever the corpus): a phrase that
passes by chance is counted exactly all the same, in every block, so it costs a row and changes nothing. Counts are added up by
phrase in a shuffle of sums; everything else is joins of phrase tables.

Null texts are empty, a null lang is ``und``. Rows that repeat count again. Pieces of any length are taken whole: a block ends only between pieces, so
a text without any cut is one block, in one task's memory. Equal scores go by count, then by phrase in byte order. Empty tables, and those
without candidates, give no rows. Columns beyond text and lang are ignored. Counts are exact up to 2^63, scores are calculated in decimals.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, saved, scratch, tidied

BLOCK = "lang string, words array<string>, counts array<long>, ids binary"
CODED = "lang string, words array<string>, hashes binary, ids binary"
SCALE = 2_000_000
_CUT = 0xFF  # no byte of UTF-8
_TABLE = bytes(_CUT if b in b".,;:!?" or 0x0A <= b <= 0x0D else 0x20 if b == 0x09 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_SLICE, _ROWS = 1 << 20, 1 << 15
_PROBES = 4
_STEP = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


@contextmanager
def _few_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for what is written inside: a row here is a whole block."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


# --- blocks


def word_runs(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, with the mark b"\\xff" where pieces end, in lists that end with a piece."""
    data, at = text.translate(_TABLE), 0
    while at < len(data):
        end = data.find(_CUT, at + _SLICE) + 1 or len(data)
        yield data[at:end].replace(b"\xff", b" \xff ").split()
        at = end


class _Numbers(dict):
    """word -> its number in the block, from 1; 0 is a cut."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _blocks(block_words: int):
    def write(batches):
        import pyarrow as pa
        held: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
        words: dict[str, int] = {}

        def flush(lang):
            numbers, parts = held.pop(lang)
            del words[lang]
            ids = np.concatenate(parts)
            counts = np.bincount(ids, minlength=len(numbers))[1:]
            if len(counts):
                own = pa.array([w.decode() for w in list(numbers)[1:]], pa.string())
                ends = pa.array([0, len(counts)], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.ListArray.from_arrays(ends, own), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64())), pa.array([ids.astype("<i4").tobytes()], pa.binary())], ["lang", "words", "counts", "ids"])

        for b in batches:
            texts = b.column("text").cast(pa.binary())
            for lang, text in zip(b.column("lang").to_pylist(), texts, strict=True):
                for run in word_runs(text.as_py()):
                    numbers, parts = held.get(lang) or held.setdefault(lang, (_Numbers({b"\xff": 0}), []))
                    parts += [np.fromiter(map(numbers.__getitem__, run), np.int32, len(run)), np.zeros(1, np.int32)]
                    words[lang] = words.get(lang, 0) + len(run) + 1
                    if words[lang] >= block_words:
                        yield from flush(lang)
                if sum(words.values()) >= 4 * block_words:  # many languages at once
                    yield from flush(max(words, key=words.get))
        for lang in list(held):
            yield from flush(lang)

    return write


def _recoded(told):
    """Blocks without the words that the filter leaves out, which become cuts; the others are numbered anew."""

    def recode(batches):
        import pyarrow as pa

        for b in batches:
            for lang, words, ids in zip(*(b.column(c) for c in ("lang", "words", "ids")), strict=True):
                hashes = _starts(lang.as_py(), words.as_py())
                kept = np.flatnonzero(passes(told.value.get("word"), hashes))
                new = np.zeros(len(words) + 1, np.int32)
                new[kept + 1] = np.arange(1, len(kept) + 1)
                held = pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), words.values.take(pa.array(kept)))
                yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()]), held, pa.array([hashes[kept].tobytes()]), pa.array([new[np.frombuffer(ids.as_py(), "<i4")].tobytes()])], ["lang", "words", "hashes", "ids"])

    return recode


def code_corpus(docs: DataFrame, least: int, block_words: int, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written: blocks of words that may occur ``least`` times or more in their language; those that do, (lang, word, f); each language's number of words n."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    with _few_rows(spark, 256):
        blocks = saved(texts.mapInArrow(tidied(_blocks(block_words)), BLOCK), "blocks")
    sizes = saved(blocks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n")), "sizes")
    often = saved(blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f")).where(F.col("f") >= least), "often")
    told = spark.sparkContext.broadcast(filters(often.select(F.lit("word").alias("kind"), "lang", F.col("word").alias("phrase")), bits))
    with _few_rows(spark, 8):
        coded = saved(blocks.mapInArrow(tidied(_recoded(told)), CODED), "coded")
    told.unpersist()
    discard(blocks)
    return coded, often, sizes


# --- scans


def _hash(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data)


def _starts(lang: str, words: list[str]) -> np.ndarray:
    """The hashes of phrases of one word."""
    return np.array([_hash(w.encode()) for w in words], np.uint64) + np.uint64(_hash(lang.encode()) * _STEP & _ALL)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def _probe(mixed: np.ndarray, k: int, bits: int) -> np.ndarray:
    return ((mixed >> np.uint64(32)) * np.uint64(k + 1) + (mixed & np.uint64(0xFFFFFFFF))) & np.uint64(bits - 1)


def passes(bitmap: np.ndarray | None, h: np.ndarray) -> np.ndarray:
    """Which hashes a Bloom filter may hold."""
    out = np.zeros(len(h), bool)
    if bitmap is not None:
        m, left = _mixed(h), np.arange(len(h))
        for k in range(_PROBES):
            p = _probe(m[left], k, len(bitmap) * 64)
            left = left[(bitmap[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1]
        out[left] = True
    return out


def filters(marks: DataFrame, bits: int) -> dict[str, np.ndarray]:
    """A Bloom filter of ``bits`` bits for each kind of ``marks`` (kind, lang, phrase): built by the tasks, united by Spark."""

    def fill(batches):
        import pyarrow as pa

        own: dict[str, np.ndarray] = {}
        for b in batches:
            hashes: dict[str, list[int]] = {}
            for kind, lang, phrase in zip(*(b.column(c).to_pylist() for c in ("kind", "lang", "phrase")), strict=True):
                h = _hash(lang.encode())
                for w in phrase.split(" "):
                    h = (h * _STEP + _hash(w.encode())) & _ALL
                hashes.setdefault(kind, []).append(h)
            for kind, found in hashes.items():
                bitmap, m = own.setdefault(kind, np.zeros(bits // 64, np.uint64)), _mixed(np.array(found, np.uint64))
                for k in range(_PROBES):
                    p = _probe(m, k, bits)
                    np.bitwise_or.at(bitmap, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))
        for kind, bitmap in own.items():
            at = np.flatnonzero(bitmap)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(at)), pa.array(at, pa.int64()), pa.array(bitmap[at].view(np.int64))], ["kind", "at", "bits"])

    found = marks.select("kind", "lang", "phrase").mapInArrow(fill, "kind string, at long, bits long").groupBy("kind", "at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out: dict[str, np.ndarray] = {}
    kinds = np.array(found.column("kind").to_pylist(), object)
    at, held = found.column("at").to_numpy(), found.column("bits").to_numpy()
    for kind in set(kinds.tolist()):
        out[kind] = np.zeros(bits // 64, np.uint64)
        out[kind][at[kinds == kind]] = held[kinds == kind].view(np.uint64)
    return out


def _scan(told, pairs: bool):
    """Counts, in each block, the n-grams that ``told`` (a broadcast of filters) names, or all pairs."""

    def count(batches):
        by = told.value
        for b in batches:
            for lang, words, hashes, ids in zip(*(b.column(c) for c in ("lang", "words", "hashes", "ids")), strict=True):
                lang, ids = lang.as_py(), np.frombuffer(ids.as_py(), "<i4").astype(np.int64) - 1
                starts = np.frombuffer(hashes.as_py(), np.uint64)
                of = starts - np.uint64(_hash(lang.encode()) * _STEP & _ALL)
                ok, h = ids >= 0, None
                for n in (1, 2) if pairs else (1, 2, 3, 4):
                    if n == 1:
                        at = np.flatnonzero(ok)
                        here = starts[ids[at]]
                    else:
                        keep = (at + n - 1 < len(ids)) & ok[np.minimum(at + n - 1, len(ids) - 1)]
                        before_at, before_h = at, h
                        at = at[keep]
                        here = before_h[keep] * np.uint64(_STEP) + of[ids[at + n - 1]]
                        named = passes(by.get("count"), here) if n < 4 else np.zeros(len(at), bool)
                        if n == 2 and pairs:
                            named[:] = True
                        if n > 2:
                            named |= passes(by.get("right"), before_h)[keep]
                            shifted = np.searchsorted(before_at, at + 1)  # where the last n-1 words begin
                            named |= passes(by.get("left"), before_h)[shifted]
                        if named.any():
                            yield from _counted(words.values, lang, ids, at[named], n)
                    h = here

    return count


def _counted(words, lang: str, ids: np.ndarray, at: np.ndarray, n: int):
    """Record batches of the distinct n-grams at the places ``at``, written with their language, and how often each is there."""
    import pyarrow as pa
    import pyarrow.compute as pc

    key = ids[at]
    for k in range(1, n):
        if k > 1:
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(words) + ids[at + k]
    _, first, amount = np.unique(key, return_index=True, return_counts=True)
    for i in range(0, len(first), _ROWS):
        here = at[first[i : i + _ROWS]]
        text = pc.binary_join_element_wise(*(words.take(pa.array(ids[here + k])) for k in range(n)), " ")
        yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(lang, text, "\t"), pa.array(amount[i : i + _ROWS].astype(np.int64))], ["gram", "f"])


def scan(coded: DataFrame, often: DataFrame, marks: DataFrame | None, least: int, bits: int) -> DataFrame | None:
    """Written: (lang, phrase, len, f, first, last) of what the marks name (all pairs without marks), ``least`` or more times found; ``first`` and ``last`` are the counts of the outer words."""
    spark = coded.sparkSession
    by = filters(marks, bits) if marks is not None else {}
    if marks is not None and not by:
        return None
    told = spark.sparkContext.broadcast(by)
    with _few_rows(spark, 8):
        sums = coded.mapInArrow(tidied(_scan(told, marks is None)), "gram string, f long").groupBy("gram").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
        # Words hold no tab: what precedes the last one is the language.
        phrase = F.substring_index("gram", "\t", -1)
        split = sums.select(F.expr("left(gram, length(gram) - length(substring_index(gram, '\\t', -1)) - 1)").alias("lang"), phrase.alias("phrase"), (F.length(phrase) - F.length(F.translate(phrase, " ", "")) + 1).alias("len"), "f")
        for name, n in (("first", 1), ("last", -1)):
            split = split.withColumn("word", _words("phrase", n)).join(often.select("lang", "word", F.col("f").alias(name)), ["lang", "word"]).drop("word")
        out = saved(split, "counted")
    told.unpersist()
    return out


# --- scores


def score_of(a: Column, l: Column, r: Column) -> Column:
    """floor(2000000 a / (l + r)), exactly."""
    wide = lambda c: c.cast("decimal(27,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(9,0)") * wide(a), wide(l) + wide(r)).cast("long")


def _words(phrase: str, n: int) -> Column:
    """The first n words of a phrase, the last ones for a negative n."""
    return F.substring_index(phrase, " ", n)


def _bounds(known: DataFrame) -> DataFrame:
    """Adds ``grows`` (no extension scores more) and ``bound`` (nor does the phrase itself)."""
    grows = score_of(F.col("f"), F.col("first"), F.col("f"))
    return known.withColumn("grows", grows).withColumn("bound", F.when(F.col("len") == 2, score_of(F.col("f"), F.col("first"), F.col("last"))).otherwise(F.least("grows", score_of(F.col("f"), F.col("f"), F.col("last")))))


def scored(known: DataFrame) -> DataFrame:
    """(lang, phrase, len, a, k, l, r, score) of the phrases with a score within [low, high) of their row in ``known``."""
    may = _bounds(known).where("bound >= low")
    of = known.select("lang", F.col("phrase").alias("part"), F.col("f").alias("found"))

    def part(rows: DataFrame, n: int, name: str) -> DataFrame:
        # A part that no scan has counted belongs to a phrase below the floor.
        return rows.withColumn("part", _words("phrase", n)).join(of, ["lang", "part"]).drop("part").withColumnRenamed("found", name)

    def best(rows: DataFrame, cuts: list[tuple[str, str]]) -> DataFrame:
        each = F.array(*(F.struct(score_of(F.col("f"), F.col(l), F.col(r)).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r")) for k, (l, r) in enumerate(cuts, 1)))
        return rows.withColumn("cut", F.array_min(each)).select("lang", "phrase", "len", F.col("f").alias("a"), "cut.k", "cut.l", "cut.r", "cut.score", "low", "high").where("score >= low and score < high").drop("low", "high")

    two = best(may.where("len = 2"), [("first", "last")])
    three = best(part(part(may.where("len = 3"), 2, "l2"), -2, "r2"), [("first", "r2"), ("l2", "last")])
    four = part(part(part(part(may.where("len = 4"), 3, "l3"), -3, "r3"), 2, "l2"), -2, "r2")
    return two.unionByName(three).unionByName(best(four, [("first", "r3"), ("l2", "r2"), ("l3", "last")]))


def not_held(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` but for those with a one-word extension of 80 % of their count or more. A longer phrase has no more occurrences than that extension."""
    longer = known.where("len > 2")
    ends = F.explode(F.expr("array(substring_index(phrase, ' ', 1 - len), substring_index(phrase, ' ', len - 1))"))
    most = longer.select("lang", ends.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    return rows.join(most, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (F.col("longest") * 100 < F.col("a") * 80)).drop("longest")


def _joined(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def collocations(docs: DataFrame, top: int = 2000, least: int = 30, reach: float = 1.25, block_words: int = 120_000, filter_bits: int = 1 << 25) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases. ``reach``: the first floor is the score of the pair at ``reach * top``; it changes the work only."""
    with scratch(docs.sparkSession, "settled", "sizes"):
        found, sizes = _search(docs, top, least, reach, block_words, filter_bits)
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _floors(pairs: DataFrame, open_: DataFrame, rank: int) -> DataFrame:
    """Written: (lang, low, high) of the languages in ``open_`` (lang, high): low is the score of the pair at ``rank``, or 0."""
    place = Window.partitionBy("lang").orderBy(F.desc("bound"), "phrase")
    last = _bounds(pairs).select("lang", "phrase", "bound").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= rank).groupBy("lang").agg(F.max("rank").alias("rank"), F.min("bound").alias("bound"))
    low = F.when(F.col("rank") == rank, F.least("bound", "high")).otherwise(0)
    return saved(open_.join(last, "lang", "left").select("lang", low.cast("long").alias("low"), "high"), "floors")


def _search(docs: DataFrame, top: int, least: int, reach: float, block_words: int, bits: int) -> tuple[DataFrame, DataFrame]:
    coded, often, sizes = code_corpus(docs, least, block_words, bits)
    pairs = scan(coded, often, None, least, bits)
    tables, survivors, rank = [pairs], [], max(1, round(top * reach))
    open_ = sizes.select("lang", F.lit(1 << 62).alias("high"))

    def marked(kind: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), "lang", "phrase")

    while True:
        floors = _floors(pairs, open_, rank)
        for n in (2, 3, 4):
            known = _joined(tables)
            here = _bounds(known.where(F.col("len") == n).join(floors, "lang"))
            within = here.where("bound >= low and bound < high")
            marks = []
            if n < 4:
                marks += [marked("right", here.where("grows >= low and grows < high")), marked("left", within)]
            for k in range(2, n):  # the parts behind a cut that no scan has counted yet
                wanted = within.select("lang", _words("phrase", -k).alias("phrase")).distinct()
                marks.append(marked("count", wanted.join(known, ["lang", "phrase"], "left_anti")))
            new = scan(coded.join(floors, "lang", "left_semi"), often, _joined(marks), least, bits)
            if new is not None:
                tables.append(saved(new.join(known, ["lang", "phrase"], "left_anti"), "known"))
        known = _joined(tables).join(floors, "lang")
        survivors.append(saved(not_held(scored(known), known), "settled"))
        have = _joined(survivors).groupBy("lang").agg(F.count("*").alias("have"))
        left = floors.join(have, "lang", "left").where((F.coalesce("have", F.lit(0)) < top) & (F.col("low") > 0))
        open_ = saved(left.select("lang", F.col("low").alias("high")), "open")
        if open_.isEmpty():
            return _joined(survivors), sizes
        rank *= 4
