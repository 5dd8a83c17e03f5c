"""Held-out rule, bounded label samples, and a two-layer network in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id") -> Column:
    """True for rows kept from learning: crc32 of the id as text, mod 5, is 0."""
    text = F.col(id_col).cast("string").cast("binary")
    return F.coalesce(F.crc32(text) % 5 == 0, F.lit(False))


def label_sample(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids to learn from, by hash: doc_id, label (0 or 1).

    Held-out ids and null labels are left out; an id with several labels counts
    once, with the largest. The bound is the only thing the fit does not see.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


@dataclass
class Network:
    """Inputs are standardised; one hidden layer; the logit is divided by ``temperature``."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.maximum(z @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def fit(
    x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, decay: float = 1e-4, seed: int = 1
) -> Network:
    """Adam on three quarters of the rows, the temperature on the rest.

    With no rows, or rows of one class only, the score is the smoothed share of
    label 1 for every document.
    """
    d = x.shape[1]
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    flat = Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), prior, 1.0)
    if len(np.unique(y)) < 2:
        return flat
    random = np.random.default_rng(seed)
    order = random.permutation(len(y))
    cut = max(1, len(y) // 4)
    held, rest = order[:cut], order[cut:]
    mean, scale = x[rest].mean(0), x[rest].std(0) + 1e-6
    net = Network(
        mean, scale, random.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden),
        random.normal(0, np.sqrt(1 / hidden), hidden), prior, 1.0,
    )
    z = np.clip((x - mean) / scale, -8, 8)
    values = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    step, best, kept = 0, np.inf, None
    for _ in range(epochs):
        for rows in np.array_split(random.permutation(rest), max(1, len(rest) // 128)):
            zb, yb = z[rows], y[rows]
            h = np.maximum(zb @ values[0] + values[1], 0)
            p = 1 / (1 + np.exp(-np.clip(h @ values[2] + values[3], -40, 40)))
            delta = (p - yb) / len(rows)
            back = np.outer(delta, values[2]) * (h > 0)
            slopes = [zb.T @ back, back.sum(0), h.T @ delta, np.array([delta.sum()])]
            step += 1
            for i, slope in enumerate(slopes):
                slope = slope + decay * values[i]
                first[i] = 0.9 * first[i] + 0.1 * slope
                second[i] = 0.999 * second[i] + 0.001 * slope * slope
                rate = 0.003 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                values[i] = values[i] - rate * first[i] / (np.sqrt(second[i]) + 1e-8)
        net.w1, net.b1, net.w2, net.b2 = values[0], values[1], values[2], float(values[3][0])
        now = _loss(net.logits(x[held]), y[held])
        if now < best:
            best, kept = now, [v.copy() for v in values]
    net.w1, net.b1, net.w2, net.b2 = kept[0], kept[1], kept[2], float(kept[3][0])
    logits = net.logits(x[held])
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 101))
    net.temperature = float(min(grid, key=lambda t: _loss(logits / t, y[held])))
    return net
