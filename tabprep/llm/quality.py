"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a Gaussian with a covariance shrunk towards its diagonal; the score is the calibrated difference of the two
log densities, whose Mahalanobis distances come from cached Cholesky factors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.llm.common import hash_sample, SPACES, blocks, map_batches, remainder
from tabprep.workspace import pin

UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
DIGITS, STOPS, LOUD = b"0123456789", b".,;:", b"!?"
SYMBOLS, BARS = b"#*$%&<>=@^~\\", b"|_/{}[]()"
SIZE = 13


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of one text: lengths and shares on a log scale. Finite for any text."""
    raw = (text or "").encode()
    words, total = raw.split(), len(raw)
    n = len(words)
    count = lambda chars: total - len(raw.translate(None, chars))
    share = lambda part, whole: float(np.log((part + 0.1) / (whole + 1.0)))
    lines = raw.split(b"\n")
    upper, lower = count(UPPER), count(LOWER)
    return [
        float(np.log1p(n)), float(np.log1p(total / max(n, 1))), share(upper, upper + lower), share(count(DIGITS), total),
        share(count(STOPS), n), share(count(LOUD), n), share(count(SYMBOLS), n), share(count(BARS), n),
        share(count(SPACES), total), share(len(set(words)), n), share(len(set(lines)), len(lines)),
        share(sum(a == b for a, b in zip(words, words[1:])), n), float(np.log1p(n / len(lines))),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` for every row; a null text counts as empty."""

    def run(batches):
        for ids, texts in blocks(batches):
            yield {"doc_id": ids, "x": [statistics(text) for text in texts]}

    return map_batches(docs.select("doc_id", "text"), [("doc_id", "long"), ("x", "array<double>")], run)


@dataclass
class Discriminant:
    """Means and inverse Cholesky factors of both classes, and the calibration of their log-density difference."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 minus that of class 0."""
        logs = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.factors[k].T
            logs.append(-0.5 * (z * z).sum(axis=1) - 0.5 * self.log_dets[k])
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.offset, -700, 700)))


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products of ``x`` by ``label``: summed in every task, then by Spark per cell."""
    fields = [("label", "int"), ("cell", "int"), ("value", "double")]
    width = 1 + SIZE + SIZE * SIZE

    def run(batches):
        sums = np.zeros((2, width))
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, SIZE)
            y = np.array(batch.column("label").to_pylist(), int)
            for k in (0, 1):
                part = x[y == k]
                sums[k] += np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part).ravel()])
        yield {"label": np.repeat([0, 1], width), "cell": np.tile(np.arange(width), 2), "value": sums.ravel()}

    summed = map_batches(rows.select("label", "x"), fields, run).groupBy("label", "cell").agg(F.sum("value").alias("v"))
    out = np.zeros((2, width))
    for row in summed.collect():  # at most 2 * width rows
        out[row["label"], row["cell"]] = row["v"]
    return {k: (out[k, 0], out[k, 1 : 1 + SIZE], out[k, 1 + SIZE :].reshape(SIZE, SIZE)) for k in (0, 1)}


def fit(rows: DataFrame, shrinkage: float = 0.1, calibration_rows: int = 20_000) -> Discriminant | float:
    """Fit on ``label, x`` rows: moments of all of them, calibration on at most ``calibration_rows`` of them.

    With a class missing there is nothing to separate: the smoothed share of label 1 is returned instead.
    """
    sums = moments(rows)
    n0, n1 = sums[0][0], sums[1][0]
    if min(n0, n1) < 2:
        return (n1 + 1) / (n0 + n1 + 2)
    means, factors, dets = [], [], []
    pooled = sum(s[2] - np.outer(s[1], s[1]) / s[0] for s in sums.values()) / (n0 + n1)
    floor = np.maximum(np.diag(pooled), 1e-3)
    for k in (0, 1):
        n, total, outer = sums[k]
        mean = total / n
        own = (outer - n * np.outer(mean, mean)) / n
        weight = n / (n + 2 * SIZE)  # few rows: lean on the pooled covariance
        cov = weight * own + (1 - weight) * pooled
        cov = (1 - shrinkage) * cov + shrinkage * np.diag(np.diag(cov)) + 0.05 * np.diag(floor)
        lower = np.linalg.cholesky(cov)
        means.append(mean)
        factors.append(np.linalg.inv(lower))
        dets.append(2 * np.log(np.diag(lower)).sum())
    model = Discriminant(np.array(means), np.array(factors), np.array(dets))
    sample = hash_sample(rows, calibration_rows, "doc_id", "x").select("label", "x").toPandas()
    d = np.clip(model.difference(np.array(sample["x"].tolist(), float)), -60, 60)
    y = sample["label"].to_numpy(float)
    beta = np.array([0.0, 0.1])
    design = np.column_stack([np.ones_like(d), d])
    for _ in range(50):  # Newton steps of a logistic fit with a small ridge
        p = 1 / (1 + np.exp(-design @ beta))
        grad = design.T @ (p - y) + 0.01 * beta
        hess = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    model.offset, model.slope = float(beta[0]), float(max(beta[1], 1e-6))
    return model


def quality_scores(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, divisor: int = 5, held: int = 0,
    calibration_rows: int = 20_000,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Labels are learned only from rows whose remainder is not ``held``. Statistics of all documents are written once to the shared
    folder; fitting and scoring read that table. Null texts count as empty, a null id has no label, several labels
    of one id count as their maximum, repeated rows each give a row, other columns are ignored. Without labels of
    both kinds every score is the smoothed share of label 1 (0.5 with none).
    """
    stats = pin(document_statistics(docs), "quality-statistics")
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(
        F.max("quality").cast("int").alias("label")
    )
    train = stats.join(known.where("label in (0, 1)"), "doc_id").where(remainder("doc_id", divisor) != held)
    model = fit(train, calibration_rows=calibration_rows)

    def run(batches):
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, SIZE)
            score = np.full(len(x), model) if isinstance(model, float) else model.score(x)
            yield {"doc_id": batch.column("doc_id"), "score": score, "predicted": (score >= threshold).astype(np.int32)}

    scored = map_batches(stats, [("doc_id", "long"), ("score", "double"), ("predicted", "int")], run)
    return scored.select("doc_id", (remainder("doc_id", divisor) == held).alias("held_out"), "score", "predicted")
