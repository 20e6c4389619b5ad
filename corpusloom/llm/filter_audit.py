"""What each filter of a chain removes in every order of the chain, and what the filters share.

Five filters look at whole texts: A few words, B few distinct words, C many capitals, D signs of markup or code, E the text of a document
with a smaller id. E is an existential self-join: a left-semi join on the text's hash, the exact text and a smaller doc_id. Its right side
holds one row for each repeated text (the least id), aggregated before the shuffle; the left side only rows whose hash occurs
more than once, and those of a very common hash are dealt to several tasks by a salt, to which the right row is copied. The ids
that E finds are united with the ids that fail A to D, and the union is aggregated to one combination of bits for each document. From
the counts of the 32 combinations in each part, all 120 orders follow by sums, one row of arrays for each part.

Null texts are empty, a null source is the empty part. Rows that repeat count one by one; equal ids are not smaller, so a repeat of the
least row doesn't fail E. A null doc_id is neither smaller than another nor has it smaller ones, and it has no labels. Of several labels of
a document, any 1 counts. Very long texts are split into words once each, in one row's memory. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import if_small, saved, scratch

FILTERS = "ABCDE"
_WORD = r"[^\x20\x09-\x0D]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ROW = ("doc_id", "part", "hash")


def failures(text: Column) -> Column:
    """Bits 1, 2, 4, 8 for the failed ones of A, B, C, D."""
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))

    def bits(w: Column, distinct: Column) -> Column:
        a, b = F.size(w) < 50, F.size(distinct).cast("long") * 100 < F.size(w).cast("long") * 65
        c, d = capitals.cast("long") * 100 > F.length(text).cast("long") * 5, text.rlike("[#$%&*|]")
        return sum((x.cast("int") * (1 << i) for i, x in enumerate((b, c, d), 1)), a.cast("int"))

    # A lambda over one element computes the words once.
    return F.transform(F.array(words), lambda w: bits(w, F.array_distinct(w)))[0]


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("hash"))


def repeated_ids(docs: DataFrame, marks: DataFrame, deal: int = 10_000, small: int = 1_000_000) -> DataFrame:
    """(doc_id, part, hash) of every row whose text is that of a row with a smaller id. marks: a written table with ``doc_id`` and ``hash`` of all rows."""
    found = marks.groupBy("hash").agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    again = if_small(saved(found.where("least < most").select("hash", F.ceil(F.col("n") / deal).cast("int").alias("salts")), "repeated"), small)
    rows = _rows(docs).where("doc_id is not null").join(again, "hash")
    left = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), "salts").cast("int"))
    right = rows.groupBy("hash", "text", "salts").agg(F.min("doc_id").alias("smaller")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    l, r = left.alias("l"), right.alias("r")
    same = (F.col("l.hash") == F.col("r.hash")) & (F.col("l.salt") == F.col("r.salt")) & (F.col("l.text") == F.col("r.text"))
    return l.join(r, same & (F.col("r.smaller") < F.col("l.doc_id")), "left_semi").select(*_ROW)


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Written: (part, bits, n, good, toxic) for every combination of failed filters that occurs in a part."""
    with scratch(docs.sparkSession, "audit_combinations"):
        return _combinations(docs, labels)


def _combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    marks = saved(_rows(docs).select(*_ROW, failures(F.col("text")).alias("bits")), "audit_marks")
    # Rows that share id, part and text share their bits; n counts them.
    e = repeated_ids(docs, marks).select(*_ROW, F.lit(16).alias("bits"), F.lit(0).alias("n"))
    united = marks.select(*_ROW, "bits", F.lit(1).alias("n")).unionByName(e)
    each = united.groupBy(*_ROW).agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    joined = each.join(told, "doc_id", "left")
    amount = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).cast("long").alias(c)
    return saved(joined.groupBy("part", "bits").agg(F.sum("n").cast("long").alias("n"), amount("good"), amount("toxic")), "audit_combinations")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    steps = []
    for order in permutations(range(5)):
        name = "".join(FILTERS[f] for f in order)
        steps += [{"filter_order": name, "step": k + 1, "before": sum(1 << g for g in order[:k]), "bit": 1 << f} for k, f in enumerate(order)]
    known = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, before int, bit int>>")
    counts = combinations(docs, labels).groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("held"))  # 32 at most
    each = counts.select("part", "held", F.explode(known).alias("s")).select("part", "held", "s.*")

    def total(of: str, when) -> Column:
        return F.aggregate("held", F.lit(0).cast("long"), lambda t, h: t + F.when(when(h["bits"]), h[of]).otherwise(0))

    before, bit = F.col("before"), F.col("bit")
    fails = lambda b: b.bitwiseAND(bit) != 0
    passed = lambda b: b.bitwiseAND(before) == 0
    # A document that fails m filters is removed by each of them in 120 / m of the 120 orders.
    share = F.aggregate("held", F.lit(0).cast("long"), lambda t, h: t + F.when(fails(h["bits"]), h["n"] * F.floor(F.lit(120) / F.bit_count(h["bits"]))).otherwise(0))
    return each.select(
        "part", "filter_order", "step",
        total("n", lambda b: b.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        total("n", lambda b: passed(b) & fails(b)).alias("removed"),
        total("n", lambda b: ~passed(b) & fails(b)).alias("redundant"),
        total("n", lambda b: b == bit).alias("unique_fails"),
        total("good", lambda b: passed(b) & fails(b)).alias("good_lost"),
        total("toxic", lambda b: passed(b) & fails(b)).alias("toxic_lost"),
        share.alias("shapley"),
    )
