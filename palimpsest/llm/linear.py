"""Sparse logistic regression on hashed features, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, *, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.5, l2: float = 1.0, passes: int = 2, seed: int = 7) -> tuple[np.ndarray, float]:
    """(weights, bias) from rows of (indices, values); rows in a seeded order, one update each (FTRL-proximal).

    No rows, or rows of one class only: weights of zero and a bias at that class's smoothed log odds.
    """
    n, positive = len(labels), float(np.sum(labels))
    z, g2 = np.zeros(size), np.zeros(size)
    bias = float(np.log((positive + 1) / (n - positive + 1)))
    if n == 0 or positive in (0, n):
        return z.astype(np.float32), bias
    zb = gb = 0.0
    start = bias
    order = np.random.Generator(np.random.PCG64(seed))
    for _ in range(passes):
        for i in order.permutation(n):
            index, value = rows[i]
            zi, gi = z[index], g2[index]
            w = np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(gi)) / alpha + l2), 0.0)
            bias = start - zb / ((beta + np.sqrt(gb)) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w @ value + bias, -35, 35)))
            error = p - labels[i]
            g = error * value
            z[index] = zi + g - (np.sqrt(gi + g * g) - np.sqrt(gi)) / alpha * w
            g2[index] = gi + g * g
            zb += error - (np.sqrt(gb + error * error) - np.sqrt(gb)) / alpha * (bias - start)
            gb += error * error
    w = np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(g2)) / alpha + l2), 0.0)
    return w.astype(np.float32), float(start - zb / ((beta + np.sqrt(gb)) / alpha))


def fitted(rows: DataFrame, size: int, **options) -> tuple[np.ndarray, float]:
    """(weights, bias) from rows (doc_id, label, index[, value]), bounded in number: one task learns from them, in the order
    of ids and then of their values, and the driver gets the weights alone. A row without values has ones."""
    valued = "value" in rows.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(frames)
        if held:
            found = pd.concat(held, ignore_index=True)
            values = found["value"] if valued else found["index"].map(lambda x: np.ones(len(x), np.float32))
            found = found.assign(v=values, n=found["index"].map(len), s=(found["value"] if valued else found["index"]).map(lambda v: float(np.sum(v, dtype=np.float64))))
            found = found.sort_values(["doc_id", "n", "s"], kind="stable")
            weights, bias = train_ftrl(list(zip(found["index"], found["v"], strict=True)), found["label"].to_numpy(np.float64), size, **options)
            yield pd.DataFrame({"weights": [weights.tobytes()], "bias": [bias]})

    row = rows.repartition(1).mapInPandas(run, "weights binary, bias double").first()
    if row is None:
        return train_ftrl([], np.empty(0), size)
    return np.frombuffer(bytes(row["weights"]), np.float32).copy(), row["bias"]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
