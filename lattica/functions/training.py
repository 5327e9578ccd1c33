"""A small two-layer network fitted on the driver from a bounded sample of features."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import perceptron


def fit_perceptron(x: np.ndarray, y: np.ndarray, hidden: int = 8, rounds: int = 300, rate: float = 0.05, seed: int = 42) -> dict:
    """Mean squared error by gradient descent with momentum; the parameters as lists.

    ``x``: rows of features, already sampled to fit the driver.
    """
    rng = np.random.default_rng(seed)
    w1, b1 = rng.normal(0, 1 / np.sqrt(x.shape[1]), (hidden, x.shape[1])), np.zeros(hidden)
    w2, b2 = rng.normal(0, 1 / np.sqrt(hidden), hidden), 0.0
    speed = [0.0] * 4
    for _ in range(rounds):
        z = x @ w1.T + b1
        h = np.maximum(z, 0)
        p = 1 / (1 + np.exp(-(h @ w2 + b2)))
        g = 2 * (p - y) * p * (1 - p) / len(x)
        gh = np.outer(g, w2) * (z > 0)
        slopes = [gh.T @ x, gh.sum(0), h.T @ g, g.sum()]
        speed = [0.9 * s + d for s, d in zip(speed, slopes)]
        w1, b1, w2, b2 = (w - rate * s * len(x) ** 0.5 for w, s in zip((w1, b1, w2, b2), speed))
    return {"w1": w1.tolist(), "b1": b1.tolist(), "w2": w2.tolist(), "b2": float(b2)}


def get_parameters(network: dict) -> str:
    """The network as JSON text."""
    return json.dumps({k: network[k] for k in ("w1", "b1", "w2", "b2")})


def set_parameters(text: str) -> dict:
    """The network from such text; raises where shapes do not fit."""
    network = json.loads(text)
    if not len(network["w1"]) == len(network["b1"]) == len(network["w2"]) or len(set(map(len, network["w1"]))) > 1:
        raise ValueError("shapes of the parameters do not fit")
    return network


def predict(rows: DataFrame, network: dict, vector_col: str = "x", threshold: float = 0.5) -> DataFrame:
    """``rows`` with p and predicted (1 if p > ``threshold``, else 0), inside code generation."""
    scored = rows.withColumn("p", perceptron(F.col(vector_col), network["w1"], network["b1"], network["w2"], network["b2"]))
    return scored.withColumn("predicted", (F.col("p") > threshold).cast("int"))


def squared_loss(rows: DataFrame, label_col: str = "y") -> DataFrame:
    """loss: the mean squared error of predicted rows, one row."""
    return rows.agg(F.avg((F.col("p") - F.col(label_col)) ** 2).alias("loss"))
