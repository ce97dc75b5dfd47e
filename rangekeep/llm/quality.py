"""Quality classifier: regularised quadratic discriminant over document statistics.

A text becomes a vector of transformed statistics (lengths, shares of kinds of characters, repetition).  Each
class has a mean and a covariance, shrunk towards the pooled diagonal.  The score is the logistic of the
difference of the two Gaussian log densities plus the log prior odds; Mahalanobis distances go through inverse
Cholesky factors that are computed once.

The fit takes at most SAMPLE labelled rows, chosen by a hash of the id; labels that are null, or differ
for one id, are left out; of rows that share a labelled id, the text that sorts first is learned from.  Without labelled rows of both classes all scores are 0.5.  Null texts count as empty,
and empty texts get a score like any other.  Repeated rows get equal scores.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import islice
from operator import eq
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket, fields, free_name, text_udf

#: Labelled rows that the fit takes at most.
SAMPLE = 20_000
SHRINK = 0.1
THRESHOLD = 0.7
NAMES = ("chars", "words", "word_length", "upper", "digits", "marks", "spaces", "newlines", "distinct", "adjacent", "top",
         "lines")


def statistics(text: str) -> list[float]:
    """The transformed statistics, in the order of NAMES; all defined for the empty text."""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    n = max(1, int(raw.sum()))
    upper, lower, digits = int(raw[65:91].sum()), int(raw[97:123].sum()), int(raw[48:58].sum())
    spaces, newlines = int(raw[9:14].sum() + raw[32]), int(raw[10])
    marks = int(raw[:128].sum()) - upper - lower - digits - spaces
    ws = text.split()
    m = max(1, len(ws))
    count = Counter(ws)
    top = max(count.values(), default=0)
    lines = text.split("\n")
    root = math.sqrt
    return [
        math.log1p(len(text)), math.log1p(len(ws)), math.log1p((n - spaces) / m), root(upper / n), root(digits / n),
        root(marks / n), root(spaces / n), root(newlines / n),
        math.log1p(len(count)) / math.log1p(m), root(sum(map(eq, ws, islice(ws, 1, None))) / m), root(top / m),
        root(1 - len(set(lines)) / len(lines)),
    ]


def labelled(labels: DataFrame, label_col: str, folds: int, held_out: int, limit: int) -> DataFrame:
    """Up to `limit` labels (doc_id, y) outside the held-out fold, the same ones each time."""
    rows = labels.select("doc_id", F.col(label_col).cast("int").alias("y")).filter(
        F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (bucket(F.col("doc_id"), folds) != held_out))
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").select("doc_id", "y")
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def gaussian(x: np.ndarray, pooled: np.ndarray, shrink: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, inverse Cholesky factor and log determinant of a class."""
    mean = x.mean(axis=0)
    cov = (1 - shrink) * np.cov(x.T, bias=True) + shrink * np.diag(pooled) + 1e-6 * np.eye(x.shape[1])
    factor = np.linalg.cholesky(cov)
    return mean, np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum())


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        sample: int = SAMPLE, shrink: float = SHRINK) -> dict | None:
    """The model, or None if a class has no labelled rows."""
    ys = F.broadcast(labelled(labels, label_col, 4, 2, sample))  # `sample` rows of two numbers at most
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(ys, "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    schema = fields("x array<double>")
    got = rows.select("doc_id", "y", text_udf(schema, lambda: lambda t: (statistics(t),))(F.col("text"))["x"].alias("x")).collect()
    got.sort(key=lambda r: (r["doc_id"], r["x"]))
    x, y = np.array([r["x"] for r in got]), np.array([r["y"] for r in got])
    if len(got) == 0 or min((y == 0).sum(), (y == 1).sum()) < 2:
        return None
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - centre) / scale
    pooled = sum((y == k).sum() * x[y == k].var(axis=0) for k in (0, 1)) / len(y)
    return {"centre": centre, "scale": scale, "classes": [gaussian(x[y == k], pooled, shrink) for k in (0, 1)],
            "prior": math.log((y == 1).sum() / (y == 0).sum())}


def probabilities(model: dict | None, stats: np.ndarray) -> np.ndarray:
    """For each row of statistics, the probability of label 1."""
    if model is None:
        return np.full(len(stats), 0.5)
    x = (stats - model["centre"]) / model["scale"]
    logs = [-0.5 * (np.square((x - mean) @ inverse.T).sum(axis=1) + logdet) for mean, inverse, logdet in model["classes"]]
    return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0] + model["prior"], -700, 700)))


def score(text: Column, model: dict | None) -> Column:
    """The probability of label 1."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            stats = np.array([statistics(t.as_py() or "") for t in texts]).reshape(-1, len(NAMES))
            yield pa.array(probabilities(model, stats), pa.float64())

    return F.arrow_udf(run, "double").asNondeterministic()(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), score(F.col(text_col), model).alias("score"))
    return rows.select("doc_id", (bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                       (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with predicted 1, whole and unchanged."""
    name = free_name(docs, "quality_score")
    model = fit(docs, labels, id_col, text_col)
    return docs.withColumn(name, score(F.col(text_col), model)).filter(F.col(name) >= THRESHOLD).drop(name)
