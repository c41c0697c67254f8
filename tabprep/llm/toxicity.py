"""Toxicity: cumulative-link ordinal regression over sparse text features.

P(grade <= k) = sigmoid(theta_k - w.x) with one weight vector shared by all ordered thresholds. Features are words and
word beginnings, chosen by how much more often toxic training documents hold them.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.llm.common import Memory, blocks, labelled_sample, map_batches, remainder, rewrite_texts
from tabprep.workspace import discard, pin

LETTERS = re.compile(r"[^\W\d_]+")
STARTS = (3, 4, 5, 6)


def features(text: str | None) -> set[str]:
    """Distinct lower-cased words and, marked by ``^``, their beginnings of a few lengths."""
    words = set(LETTERS.findall((text or "").lower()))
    found = set(words)
    for n in STARTS:
        found.update("^" + word[:n] for word in words if len(word) > n)
    return found


@dataclass
class Ordinal:
    weights: dict[str, float]
    thresholds: np.ndarray

    def grades(self, text: str | None) -> np.ndarray:
        """Probabilities of the grades 0, 1, ..."""
        found = set().union(*filter(None, map(self.memory.__getitem__, (text or "").lower().encode().split())))
        total = sum(self.weights[f] for f in sorted(found))
        below = 1 / (1 + np.exp(-np.clip(self.thresholds - total, -500, 500)))
        return np.diff(np.concatenate([[0.0], below, [1.0]]))

    def __post_init__(self):
        #: What known features a blank-separated part of a text has, remembered for frequent parts.
        self.memory = Memory(lambda part: tuple(f for f in features(part.decode()) if f in self.weights), 50_000)


def fit_ordinal(
    rows: list[list[int]], grades: np.ndarray, width: int, ridge: float = 0.02, steps: int = 400
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by gradient descent (Adam) on the mean negative log likelihood."""
    n, levels = len(rows), int(grades.max()) + 1
    sizes = np.array([len(r) for r in rows])
    owner = np.repeat(np.arange(n), sizes)
    cells = np.concatenate([np.array(r, np.int64) for r in rows]) if sizes.sum() else np.zeros(0, np.int64)
    shares = np.array([(grades <= k).mean() for k in range(levels - 1)])
    theta0 = np.log(shares / (1 - shares))
    raw = np.concatenate([theta0[:1], np.log(np.maximum(np.diff(theta0), 1e-3))])  # ordered by construction
    params = np.concatenate([np.zeros(width), raw])
    first = second = np.zeros_like(params)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    for step in range(1, steps + 1):
        w, raw = params[:width], params[width:]
        theta = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
        margin = np.bincount(owner, weights=w[cells], minlength=n)
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        upper, lower = sigmoid(edges[grades + 1] - margin), sigmoid(edges[grades] - margin)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        grad_margin = (du - dl) / n
        grad_theta = np.array(
            [(-(du * (grades == k)).sum() + (dl * (grades == k + 1)).sum()) / n for k in range(levels - 1)]
        )
        grad_raw = np.array([grad_theta[k:].sum() * (1.0 if k == 0 else np.exp(raw[k])) for k in range(levels - 1)])
        grad_w = np.bincount(cells, weights=grad_margin[owner], minlength=width) + ridge * w / n
        grad = np.concatenate([grad_w, grad_raw])
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        params = params - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    raw = params[width:]
    return params[:width], np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))


def train(sample: DataFrame, max_features: int = 4_000, min_documents: int = 4, min_z: float = 4.0) -> Ordinal | float:
    """Learn from ``label, text`` rows.

    The labels know two levels, so toxic rows are split at the median of their share of chosen features: grades 0, 1
    and 2. Without rows of both labels the smoothed share of toxic rows is returned.
    """

    def count(batches):
        toxic: Counter[str] = Counter()
        clean: Counter[str] = Counter()
        for labels, texts in blocks(batches):
            for label, text in zip(labels, texts):
                (toxic if label else clean).update(features(text))
            if len(toxic) + len(clean) > 100_000:
                yield from ({"feature": list(c), "n": list(c.values()), "label": [k] * len(c)} for k, c in ((1, toxic), (0, clean)))
                toxic, clean = Counter(), Counter()
        yield from ({"feature": list(c), "n": list(c.values()), "label": [k] * len(c)} for k, c in ((1, toxic), (0, clean)))

    sample = pin(sample, "toxicity-sample")
    totals = {row["label"]: row["n"] for row in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    clean, toxic = totals.get(0, 0), totals.get(1, 0)
    if min(clean, toxic) < 2:
        discard(sample)
        return (toxic + 1) / (clean + toxic + 2)
    t, c = F.col("toxic"), F.col("clean")
    share = F.lit(toxic / (clean + toxic))
    counted = (
        map_batches(sample.select("label", "text"), [("feature", "string"), ("n", "long"), ("label", "int")], count)
        .groupBy("feature").agg(
            F.sum(F.col("n") * F.col("label")).alias("toxic"), F.sum(F.col("n") * (1 - F.col("label"))).alias("clean")
        )
        .withColumn("z", (t - (t + c) * share) / F.sqrt((t + c) * share * (1 - share)))
        .where((t >= min_documents) & (F.col("z") >= min_z))
        .orderBy(F.desc("z"), "feature").limit(max_features).select("feature")
    )
    names = sorted(row["feature"] for row in counted.collect())  # at most max_features
    place = {name: i for i, name in enumerate(names)}

    def found(batches):
        for labels, texts in blocks(batches):
            cells = [sorted(place[f] for f in features(text) if f in place) for text in texts]
            yield {"label": labels, "cells": cells, "size": [len(text or "") for text in texts]}

    fields = [("label", "int"), ("cells", "array<int>"), ("size", "long")]
    rows = map_batches(sample.select("label", "text"), fields, found).toPandas()  # a few numbers per sampled row
    discard(sample)
    label = rows["label"].to_numpy(int)
    density = rows["cells"].map(len).to_numpy(float) / np.log1p(rows["size"].to_numpy(float) + 1)
    grades = np.where(label == 1, 1 + (density > np.median(density[label == 1])), 0)
    if grades.max() < 2:
        grades = label
    weights, thresholds = fit_ordinal([list(c) for c in rows["cells"]], grades, len(names))
    return Ordinal(dict(zip(names, weights.tolist())), thresholds)


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.5, divisor: int = 5, held: int = 0,
    sample_rows: int = 8_000,
) -> DataFrame:
    """``doc_id, held_out, score, severity, grade, predicted`` for every row of ``docs``.

    ``severity`` is the expected grade, ``grade`` the likeliest, ``score`` the probability of any grade above 0, and
    ``predicted`` is 1 from ``threshold`` on. Learned from at most ``sample_rows`` labelled rows whose remainder is
    not ``held``. A null text counts as empty; a null id has no label; repeated rows each give a row; of several labels of an
    id the highest counts; other columns are ignored. Without labels of both kinds the score is a constant.
    """
    model = train(labelled_sample(docs, labels, "toxic", sample_rows, divisor, held))
    fields = [("doc_id", "long"), ("score", "double"), ("severity", "double"), ("grade", "int"), ("predicted", "int")]

    def run(batches):
        for ids, texts in blocks(batches):
            if isinstance(model, float):
                p = np.tile([1 - model, model], (len(texts), 1))
            else:
                p = np.array([model.grades(text) for text in texts])
            score = 1 - p[:, 0]
            yield {
                "doc_id": ids, "score": score, "severity": p @ np.arange(p.shape[1]), "grade": p.argmax(axis=1),
                "predicted": (score >= threshold).astype(int),
            }

    scored = map_batches(docs.select("doc_id", "text"), fields, run)
    return scored.withColumn("held_out", remainder("doc_id", divisor) == held)


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs``, all columns, without rows whose own text gets a toxic verdict; learned from all labels. Ids decide nothing.

    Null and empty texts are judged like any other. Where labels of both kinds are missing nothing can be learned, and all rows stay.
    """
    model = train(labelled_sample(docs, labels, "toxic", 8_000, 1, -1))
    if isinstance(model, float):
        return docs

    def change(texts):
        return [bool(1 - model.grades(text)[0] < threshold) for text in texts], texts

    return rewrite_texts(docs, docs.schema, change)
