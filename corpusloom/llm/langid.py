"""Language identification by nearest centroids of TF-IDF weighted character n-grams.

A text becomes a unit vector over hashed two- and three-letter grams (letters in lower case, everything else a space). Each
language has several centroids, found by clustering its vectors by cosine on a bounded sample. A text gets the
language of the nearest centroid; the score is the cosine. A text farther from all centroids than any text of the sample,
with a margin, is rejected.

Null texts and texts without a letter get the language ``und`` and score 0 and are rejected. So does every text if nothing could be
learned. Of equally near centroids the first counts, by name of the language. Texts of any length are read whole, one at a time in a task. Rows that
repeat a doc_id, or have none, are handled one by one; empty tables give empty results; columns beyond doc_id, text
and (for fitting) lang are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import text_batches, tidied, tidy, worker_cache
from corpusloom.llm.samples import labelled_sample

DIM = 1 << 13
_blank = re.compile(r"[\W\d_]+").sub


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed grams; None for a text without a letter."""
    s = _blank(" ", (text or "").lower())
    if not any(map(str.isalpha, s)):
        return None
    c = np.frombuffer(f" {s.strip()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
    grams = np.concatenate([two ^ np.uint32(0x165667B1), three])
    grams = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return np.bincount(grams >> np.uint32(19), minlength=DIM).astype(np.float32)


@dataclass
class CentroidModel:
    langs: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    least: dict[str, float]  # cosine below which a text is rejected

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts)
        v *= self.idf
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        return v

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cos = self.vectors(counts) @ self.centroids.T
        best = cos.argmax(axis=1)
        return best, np.clip(cos[np.arange(len(best)), best], 0, 1)


def _clusters(v: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 15) -> np.ndarray:
    k = min(k, len(v))
    centres = v[rng.choice(len(v), k, replace=False)]
    for _ in range(rounds):
        near = (v @ centres.T).argmax(axis=1)
        sums = np.stack([v[near == i].sum(axis=0) if (near == i).any() else v[rng.integers(len(v))] for i in range(k)])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def fit_languages(labelled: DataFrame, most_per_lang: int = 400, most_texts: int = 4000, clusters: int = 3, margin: float = 0.8, seed: int = 3) -> CentroidModel | None:
    """Fits on (doc_id, text, lang). ``most_per_lang`` and ``most_texts`` bound the sample, from which weights, centroids and limits come."""
    found = [(lang, c) for lang, t in labelled_sample(labelled, "lang", most_per_lang, most_rows=most_texts) if (c := gram_counts(t)) is not None]
    if not found:
        return None
    langs = sorted({x for x, _ in found})
    labels = np.array([x for x, _ in found])
    counts = np.stack([c for _, c in found])
    del found
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    model = CentroidModel([], np.zeros((0, DIM), np.float32), idf, {})
    v = model.vectors(counts)
    del counts
    rng = np.random.default_rng(seed)
    parts = [_clusters(v[labels == x], clusters, rng) for x in langs]
    model.langs = [x for x, p in zip(langs, parts, strict=True) for _ in p]
    model.centroids = np.concatenate(parts).astype(np.float32)
    cos = v @ model.centroids.T
    model.least = {x: margin * float(cos[labels == x].max(axis=1).min()) for x in langs}
    del v
    tidy()
    return model


def predict_language(docs: DataFrame, model: CentroidModel | None, *keep: Column, keep_text: bool = False) -> DataFrame:
    """doc_id, the columns ``keep``, lang_pred, score, rejected and, if asked for, text (which then goes to the tasks once)."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long"), *keep, F.col("text").cast("string").alias("_text"))
    kept = [f for f in rows.schema.fields if f.name != "_text"]

    def predict(batches):
        import pyarrow as pa

        worker_cache("languages")
        m = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                b = batch.slice(first, 256)
                counts = [gram_counts(t) if m else None for t in b.column("_text").to_pylist()]
                lang, score, rejected = ["und"] * len(counts), [0.0] * len(counts), [True] * len(counts)
                some = [i for i, c in enumerate(counts) if c is not None]
                if some:
                    best, cos = m.nearest(np.stack([counts[i] for i in some]))
                    for i, k, s in zip(some, best.tolist(), cos.tolist(), strict=True):
                        lang[i], score[i] = m.langs[k], s
                        rejected[i] = s < m.least[m.langs[k]]
                cols = [*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_()), *b.columns[-1:][:keep_text]]
                yield pa.RecordBatch.from_arrays(cols, [*(f.name for f in kept), "lang_pred", "score", "rejected", "text"][: len(cols)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", lang_pred string, score double, rejected boolean" + ", text string" * keep_text
    return rows.mapInArrow(tidied(predict), schema)
