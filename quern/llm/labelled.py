"""Bounded labelled samples and a small regularised logistic regression, shared by the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str) -> F.Column:
    """crc32 of the id as text, modulo 5; 0 marks the held-out fold."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))


def fresh(taken: list[str], name: str) -> str:
    """A column name like ``name`` that is not taken (names differ by more than case)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """``(_id, _y)``: the largest label of each id outside the held-out fold; null labels and ids are left out."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
    return known.where("_id IS NOT NULL AND _y IN (0, 1)").where(remainder("_id") != 0).groupBy("_id").agg(F.max("_y").alias("_y"))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """``(doc_id, text, y)``: at most ``per_class`` documents of label 0 and of label 1.

    The bound is a parameter: the rows are the first by a hash of the id among those outside the
    held-out fold.  Of an id that repeats the text with the least hash is taken.
    """
    known = training_labels(labels, label)
    order = F.xxhash64("_id")
    chosen = known.where("_y = 0").orderBy(order, "_id").limit(per_class).unionByName(known.where("_y = 1").orderBy(order, "_id").limit(per_class))
    # at most 2 * per_class rows of two numbers
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    return rows.groupBy("doc_id").agg(F.min_by(F.struct("text"), F.xxhash64("text"))["text"].alias("text"), F.first("_y").alias("y"))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Coefficients (the last is the intercept) by Newton steps; the ridge spares the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (p - y)) + penalty * beta
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
