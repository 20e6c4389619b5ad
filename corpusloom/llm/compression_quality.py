"""A quality classifier by compression: two zstandard dictionaries, one trained on good and one on bad labelled text.

A whole text is compressed with each dictionary, in pieces of ``piece`` bytes each on its own, so that a long text's own repetitions don't
outweigh the dictionaries. The difference of the summed sizes, normalised by their sum and by the text's length, says
which class it resembles. A logistic curve over both, fitted on labelled texts that are in neither dictionary, turns them into a
score from 0 to 1.

Labels are read for fitting only, from a bounded sample of whole texts (``most_per_class`` for each class, ``most_bytes`` in all). Null and
empty texts have a difference of 0. Without labels of both classes every score is 0.5. Texts of any length are read whole, one at a time
in a task. Rows that repeat a doc_id, or have none, are scored one by one; empty tables give empty results; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import text_batches
from corpusloom.llm.samples import fit_logistic, labelled_sample


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    weights: list[float]
    bias: float
    level: int

    def compressors(self):
        import zstandard as z

        out = []
        for d in (self.good, self.bad):
            d = z.ZstdCompressionDict(d)
            d.precompute_compress(level=self.level)
            out.append(z.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False))
        return out

    def score(self, x: list[float]) -> float:
        z = sum(w * v for w, v in zip(self.weights, x, strict=True)) + self.bias
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def differences(text: str | None, compressors, piece: int = 2000) -> list[float]:
    """The size with the bad dictionary less that with the good one, over their sum and over the text's length."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return [0.0, 0.0]
    good, bad = (sum(len(c.compress(data[i : i + piece])) for i in range(0, len(data), piece)) for c in compressors)
    return [(bad - good) / (bad + good), (bad - good) / len(data)]


def _dictionary(texts: list[str], size: int, train_bytes: int, rng: random.Random, piece: int = 400) -> bytes:
    """Trained on pieces from all over the texts, ``train_bytes`` of them at most; where they are too few to train on, the pieces themselves."""
    import zstandard as z

    parts = [t[i : i + piece].encode() for t in texts for i in range(0, len(t), piece)]
    rng.shuffle(parts)
    parts = parts[: max(1, train_bytes // piece)]
    try:
        return z.train_dictionary(min(size, sum(map(len, parts)) // 4), parts).as_bytes()
    except z.ZstdError:
        return b"".join(parts)[:size]


def fit_quality(labelled: DataFrame, label: str = "quality", most_per_class: int = 2500, most_bytes: int = 64 << 20, dictionary_bytes: int = 1_000_000, train_bytes: int = 16 << 20, level: int = 3, seed: int = 3) -> CompressionModel | None:
    """Fits on (doc_id, text, label 0 or 1); every other sampled text goes to the dictionaries, the rest to the curve.

    ``most_per_class`` and ``most_bytes`` bound the sample, ``train_bytes`` what a dictionary of ``dictionary_bytes`` is trained on.
    """
    rng = random.Random(seed)
    texts: dict[int, list[str]] = {0: [], 1: []}
    for y, t in labelled_sample(labelled.where(F.col(label).isin(0, 1)), label, most_per_class, most_bytes):
        if t:
            texts[y].append(t)
    if min(map(len, texts.values())) < 4:
        return None
    model = CompressionModel(_dictionary(texts[1][::2], dictionary_bytes, train_bytes, rng), _dictionary(texts[0][::2], dictionary_bytes, train_bytes, rng), [], 0, level)
    c = model.compressors()
    x, y = zip(*((differences(t, c), k) for k in (0, 1) for t in texts[k][1::2]), strict=True)
    x = np.array(x)
    scale = np.maximum(x.std(axis=0), 1e-9)
    w, bias = fit_logistic(x / scale, y, l2=1e-5)
    model.weights, model.bias = (w / scale).tolist(), float(bias)
    return model


def score_quality(docs: DataFrame, model: CompressionModel | None, *keep: Column) -> DataFrame:
    """doc_id, the columns ``keep``, difference, score, predicted."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long"), *keep, F.col("text").cast("string").alias("_text"))
    kept = [f for f in rows.schema.fields if f.name != "_text"]

    def score(batches):
        import pyarrow as pa

        m = shared.value
        c = m.compressors() if m else None
        for b in batches:
            d = [differences(t, c) if m else [0.0] for t in b.column("_text").to_pylist()]
            s = [m.score(x) if m else 0.5 for x in d]
            cols = [*b.columns[:-1], pa.array([x[0] for x in d], pa.float64()), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, [*(f.name for f in kept), "difference", "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", difference double, score double, predicted int"
    return rows.mapInArrow(score, schema)
