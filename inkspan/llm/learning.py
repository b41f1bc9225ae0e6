"""Labelled samples of a bounded size, and small models in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import fresh, save, unit_hash, with_row_id

#: At most about so many labelled rows of each class are fitted on.
PER_CLASS = 6000


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, learn: Column, *, per_class: int = PER_CLASS, seed: int = 7) -> DataFrame:
    """text, y, weight of about ``per_class`` labelled rows of each class at most, chosen by a hash of their id and place.

    ``weight`` undoes the sampling. Only rows of ``labels`` for which ``learn``
    (a condition on doc_id) holds and whose label is 0 or 1 count; of an id
    labelled twice the larger label. Rows of ``docs`` that repeat an id are
    chosen one by one. So the chosen rows' numbers are bounded by ``per_class``
    and may be broadcast; texts of other rows are never moved.
    """
    rows = labels.where(learn & F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.max(column).alias("y"))
    rid = fresh(docs, "__rid")
    docs = with_row_id(docs.select("doc_id", "text"), rid)
    rows = save(docs.select("doc_id", rid).join(rows, "doc_id"), "labelled-rows")
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rate = {y: min(1.0, per_class / n) for y, n in counts.items()}
    chosen = rows.withColumn("rate", F.when(F.col("y") == 1, F.lit(rate.get(1, 1.0))).otherwise(F.lit(rate.get(0, 1.0)))).where(unit_hash(seed, "doc_id", rid) < F.col("rate"))
    text = docs.join(F.broadcast(chosen.select(rid, "y", "rate")), rid)
    return save(text.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y", (1 / F.col("rate")).alias("weight")), "labelled")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, *, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Newton's method on the weighted log loss; the last coefficient is the intercept."""
    a = np.c_[x, np.ones(len(x))]
    c = np.zeros(a.shape[1])
    r = np.full(len(c), ridge)
    r[-1] = 1e-3
    for _ in range(steps):
        p = sigmoid(a @ c)
        g = a.T @ (w * (p - y)) + r * c
        h = (a * (w * p * (1 - p))[:, None]).T @ a + np.diag(r)
        step = np.linalg.solve(h, g)
        c -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return c
