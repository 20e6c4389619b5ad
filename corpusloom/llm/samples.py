"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import seeded


def _share(rows: DataFrame, label: str, most: int) -> tuple[Column, int]:
    """(for each row, the hash below which about ``most`` rows of its label lie; the number of labels)."""
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return F.lit(0), 0
    return F.element_at(F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1 << 60, (1 << 60) * most // n)))), F.col(label)), len(counts)


def with_some_labels(docs: DataFrame, labels: DataFrame, label: str, most: int, seed: int = 3) -> DataFrame:
    """(doc_id, text, label) of about ``most`` labelled documents of each value, at most twice as many.

    The sample is drawn from the labels alone, in the order of a seeded hash; being bounded, it is sent to the documents, whose texts
    aren't shuffled.
    """
    rows = labels.select("doc_id", label).where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    share, n = _share(rows, label, most)
    picked = rows.withColumn("h", seeded(seed, "doc_id")).where(F.col("h") < share).orderBy("h", "doc_id", label).limit(2 * most * n).drop("h")
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def labelled_sample(labelled: DataFrame, label: str, most: int, most_bytes: int = 64 << 20, most_rows: int | None = None, seed: int = 3) -> list[tuple]:
    """(label, text) of about ``most`` rows of each value of ``label``, by a seeded hash of doc_id, at most twice as many.

    All texts together hold no more than ``most_bytes``, each label an equal share: in the order of the hash, a text is taken if it still
    fits, whole. ``most_rows`` bounds the rows of all labels together. Null labels and null texts aren't sampled. The rows come in the order of the hash.
    """
    rows = labelled.select(seeded(seed, "doc_id").alias("h"), "doc_id", F.col(label).alias("label"), "text").where("label is not null and text is not null")
    share, n = _share(rows, "label", most)
    if not n:
        return []
    if most_rows is not None and n * most > most_rows:
        return labelled_sample(labelled, label, max(1, most_rows // n), most_bytes, None, seed)
    key = F.xxhash64("text").alias("key")
    picked = rows.where(F.col("h") < share)
    sizes = picked.select("h", "label", key, F.octet_length("text").alias("size")).orderBy("h", "label", "key").limit(2 * most * n).collect()
    left: dict = {}
    taken = []
    for r in sizes:
        if r["size"] <= left.setdefault(r["label"], most_bytes // n):
            left[r["label"]] -= r["size"]
            taken.append((r["h"], r["key"]))
    wanted = labelled.sparkSession.createDataFrame(sorted(set(taken)), "h long, key long")
    found = picked.select("h", "label", "text", key).join(F.broadcast(wanted), ["h", "key"]).select("h", "label", "text").collect()
    found.sort(key=lambda r: (r["h"], str(r["label"]), r["text"]))
    return [(r["label"], r["text"]) for r in found]


def fit_logistic(x, y, l2: float = 1e-3, rounds: int = 200):
    """Weights and bias of a logistic regression by Newton's method; few columns. Classes count as if equally many."""
    import numpy as np

    x = np.column_stack([np.asarray(x, float), np.ones(len(y))])
    y = np.asarray(y, float)
    share = np.where(y == 1, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - y)) + l2 * np.r_[w[:-1], 0]
        hess = (x * (share * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(np.r_[np.full(len(w) - 1, l2), 1e-9])
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], w[-1]
