"""Toxicity severity by cumulative-link ordinal regression over sparse word counts.

P(grade <= k) is a logistic curve of a threshold minus one weighted sum of word features; the weights are shared by all
thresholds, which are kept in order. Features are log(1 + count) of the words that tell the grades apart in the fitting
sample. The result holds every grade's probability and the expected severity.

Labels that are grades are fitted as they are. Labels that are 0/1 flags hold no grades above 1: the flagged texts of the sample are then
graded 1 to 3 by the number of telling words they hold (``graded``). Such grades order texts by the amount of what the flag marks; they are made here, not
labelled, and only the flag can be checked against labels.

A word is a run of letters, digits and underscores, in lower case. Null and empty texts have no features and get the
thresholds' own probabilities; of equally likely grades the lowest is the text's. Labels are read for fitting only, from a bounded sample
(``most_per_class`` for each value, ``most_bytes`` in all). Without
labels, or with labels of one grade only, the severity is that grade (0 without any). Texts of any length are read whole, one at a time in a task. Rows that
repeat a doc_id, or have none, are scored one by one; empty tables
give empty results; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import text_batches
from corpusloom.llm.samples import labelled_sample

_words = re.compile(r"\w+").findall


@dataclass
class OrdinalModel:
    weights: dict[str, float]
    thresholds: list[float]  # in ascending order, one less than the grades

    def probabilities(self, text: str | None) -> list[float]:
        words = _words((text or "").lower())
        hit = self.weights.keys() & set(words)
        score = 0.0
        if hit:
            counts = Counter(w for w in words if w in hit)
            score = sum(self.weights[w] * math.log1p(counts[w]) for w in sorted(hit))
        below = [1 / (1 + math.exp(-max(-40.0, min(40.0, t - score)))) for t in self.thresholds]
        return [b - a for a, b in zip([0.0, *below], [*below, 1.0], strict=True)]


def word_evidence(docs: list[tuple[int, str]], least_docs: int = 4) -> dict[str, tuple[float, float]]:
    """word -> (log odds of grade above 0, likelihood-ratio statistic of the word's tie to it), by documents with the word."""
    n, df = Counter(), (Counter(), Counter())
    for grade, text in docs:
        n[grade > 0] += 1
        df[grade > 0].update(set(_words(text.lower())))
    out, total = {}, n[True] + n[False]
    for w in df[0].keys() | df[1].keys():
        a, b = df[1][w], df[0][w]
        if a + b < least_docs:
            continue
        odds = math.log((a + 0.5) / (n[True] - a + 0.5)) - math.log((b + 0.5) / (n[False] - b + 0.5))
        cells = ((a, n[True], a + b), (b, n[False], a + b), (n[True] - a, n[True], total - a - b), (n[False] - b, n[False], total - a - b))
        out[w] = (odds, 2 * sum(k * math.log(k * total / (r * c)) for k, r, c in cells if k))
    return out


def graded(flags: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Severity grades 0 to 3 from 0/1 labels: flagged texts are graded by how many telling words they hold (1-2, 3-5, more)."""
    telling = {w for w, (o, g) in word_evidence(flags).items() if o > 2 and g > 18}
    out = []
    for flag, text in flags:
        n = sum(w in telling for w in _words(text.lower())) if flag else 0
        out.append((0 if not flag else 1 if n <= 2 else 2 if n <= 5 else 3, text))
    return out


def loss_and_gradient(p: np.ndarray, x: np.ndarray, y: np.ndarray, share: np.ndarray, levels: int, l2: float) -> tuple[float, np.ndarray]:
    """Of the weighted negative log likelihood of grades ``y``; p: weights, first threshold, logarithms of the gaps to the next ones."""
    k = x.shape[1]
    w, gaps = p[:k], np.exp(p[k + 1 :])
    theta = p[k] + np.r_[0, np.cumsum(gaps)]
    f = 1 / (1 + np.exp(-np.clip(theta[None, :] - (x @ w.astype(x.dtype))[:, None], -40, 40)))
    rows = np.arange(len(y))
    cum = np.c_[np.zeros(len(y)), f, np.ones(len(y))]
    prob = np.maximum(cum[rows, y + 1] - cum[rows, y], 1e-9)
    d = np.c_[np.zeros(len(y)), f * (1 - f), np.zeros(len(y))]  # slopes of the curves
    hi, lo = d[rows, y + 1] / prob * share, d[rows, y] / prob * share
    g_theta = np.zeros(levels + 2)
    np.add.at(g_theta, y + 1, -hi)
    np.add.at(g_theta, y, lo)
    g_theta = g_theta[1:-1]
    g = np.concatenate([x.T @ (hi - lo).astype(x.dtype) + l2 * w, [g_theta.sum()], np.cumsum(g_theta[::-1])[::-1][1:] * gaps])
    return float(-(share * np.log(prob)).sum() + l2 / 2 * (w * w).sum()), g


def fit_ordinal(docs: list[tuple[int, str]], most_words: int = 300, l2: float = 1e-4, rounds: int = 400, rate: float = 0.05) -> OrdinalModel:
    """Fits by gradient descent (Adam); grade 0 and the grades above it together count the same."""
    grades = sorted({g for g, _ in docs})
    if len(grades) < 2:
        top = max([0, *grades])
        return OrdinalModel({}, [-40.0] * top)
    levels = max(grades)
    evidence = word_evidence(docs)
    # A word has to tell the grades apart well beyond what some of very many words do by chance.
    chosen = sorted((w for w, (_, g) in evidence.items() if g > 18), key=lambda w: (-evidence[w][1], w))[:most_words]
    index = {w: i for i, w in enumerate(chosen)}
    x = np.zeros((len(docs), len(chosen)), np.float32)
    y = np.array([g for g, _ in docs])
    for r, (_, text) in enumerate(docs):
        for w, c in Counter(w for w in _words(text.lower()) if w in index).items():
            x[r, index[w]] = math.log1p(c)
    share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y == 0).sum())
    p = np.zeros(len(chosen) + levels)
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        g = loss_and_gradient(p, x, y, share, levels, l2)[1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    theta = p[len(chosen)] + np.r_[0, np.cumsum(np.exp(p[len(chosen) + 1 :]))]
    return OrdinalModel({w: float(a) for w, a in zip(chosen, p, strict=False) if abs(a) > 1e-6}, theta.tolist())


def fit_toxicity(labelled: DataFrame, label: str = "toxic", most_per_class: int = 4000, most_bytes: int = 64 << 20, grades: bool = False) -> OrdinalModel:
    """Fits on (doc_id, text, label). ``grades``: the labels are grades 0, 1, 2, ... already; else 0/1 flags, graded here."""
    sample = labelled_sample(labelled, label, most_per_class, most_bytes)
    return fit_ordinal(sample if grades else graded(sample))


def score_toxicity(docs: DataFrame, model: OrdinalModel, *keep: Column) -> DataFrame:
    """doc_id, the columns ``keep``, score (probability of a grade above 0), predicted (1 from 0.5 on), grade (the likeliest),
    expected_severity, probabilities."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long"), *keep, F.col("text").cast("string").alias("_text"))
    kept = [f for f in rows.schema.fields if f.name != "_text"]
    names = [*(f.name for f in kept), "score", "predicted", "grade", "expected_severity", "probabilities"]

    def score(batches):
        import pyarrow as pa

        for b in batches:
            p = [shared.value.probabilities(t) for t in b.column("_text").to_pylist()]
            s = [1 - x[0] for x in p]
            grade = [max(range(len(x)), key=x.__getitem__) for x in p]
            expected = [sum(k * v for k, v in enumerate(x)) for x in p]
            cols = [*b.columns[:-1], pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32()), pa.array(grade, pa.int32()), pa.array(expected, pa.float64()), pa.array(p, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", score double, predicted int, grade int, expected_severity double, probabilities array<double>"
    return rows.mapInArrow(score, schema)
