"""Distances learned from labelled samples, and alignment of labelled point clouds.

What is learned on are the samples' distance vectors (one row per pair of labelled
regions, of which there are some hundred); computing them is distributed, fitting is not.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _into_limits(x: np.ndarray, low: float, high: float, least_sum: float) -> np.ndarray:
    """The nearest vector with entries in [low, high] and a sum of at least ``least_sum``."""
    inside = np.clip(x, low, high)
    if inside.sum() >= least_sum:
        return inside
    a, b = 0.0, high - float(x.min()) + 1
    for _ in range(100):
        middle = (a + b) / 2
        a, b = (middle, b) if np.clip(x + middle, low, high).sum() < least_sum else (a, middle)
    return np.clip(x + b, low, high)


def bounded_weights(rows: np.ndarray, total: float = 16.0, low: float = 1 / 3, high: float = 3.0, steps: int = 5_000) -> np.ndarray:
    """Feature weights that make the distance vectors ``rows`` of like samples short, as a unit vector.

    Least squares of rows @ w with sum(w) >= total and every weight between ``low`` and
    ``high`` times the mean weight, by accelerated projected gradients.
    """
    n = rows.shape[1]
    mean = total / n
    gram = rows.T @ rows
    pace = 1 / max(1e-12, float(np.linalg.eigvalsh(gram)[-1]))
    w = last = np.full(n, mean)
    momentum = 1.0
    for _ in range(steps):
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = w + (momentum - 1) / following * (w - last)
        last, momentum = w, following
        w = _into_limits(ahead - pace * (gram @ ahead), low * mean, high * mean, total)
        if np.abs(w - last).max() < 1e-12:
            break
    return w / np.linalg.norm(w)


def rank_weights(rows: np.ndarray, relevance: np.ndarray, query: np.ndarray, penalty: float = 10.0, steps: int = 100) -> np.ndarray:
    """Feature weights of a linear rank machine, as a unit vector: in each query more relevant rows shall score higher.

    Squared hinge loss over all pairs of rows of one query with different relevance,
    by Newton steps. Without such a pair all weights are equal.
    """
    differences = []
    for q in np.unique(query):
        x, r = rows[query == q], relevance[query == q]
        i, j = np.nonzero(r[:, None] > r[None, :])
        differences.append(x[i] - x[j])
    d = np.concatenate(differences) if differences else np.empty((0, rows.shape[1]))
    n = rows.shape[1]
    if not len(d):
        return np.full(n, 1 / np.sqrt(n))
    w = np.zeros(n)
    for _ in range(steps):
        short = d @ w < 1
        active = d[short]
        new = np.linalg.solve(np.eye(n) + 2 * penalty / len(d) * active.T @ active, 2 * penalty / len(d) * active.sum(0))
        if np.abs(new - w).max() < 1e-10:
            break
        w = new
    return w / max(1e-300, np.linalg.norm(w))


def leave_one_out(fit: Callable[[np.ndarray], np.ndarray], samples: int, involved: Callable[[int], np.ndarray], rows: np.ndarray) -> list[tuple[np.ndarray, float, float]]:
    """For each sample the weights fitted without its rows, and how long its rows are under them and under equal weights.

    ``involved(k)`` marks the rows of sample k; ``fit`` takes the mask of the rows to learn on.
    """
    n = rows.shape[1]
    equal = np.full(n, 1 / np.sqrt(n))
    out = []
    for k in range(samples):
        own = involved(k)
        w = fit(~own)
        out.append((w, float(np.linalg.norm(rows[own] @ w)), float(np.linalg.norm(rows[own] @ equal))))
    return out


def extent(points: np.ndarray) -> np.ndarray:
    """Diagonal matrix of the widths of a cloud, (dimension, point), with 1 for the homogeneous row."""
    return np.diag([*(points[:-1].max(1) - points[:-1].min(1)), 1.0])


def alignment_cost(transform: np.ndarray, fixed: np.ndarray, moving: np.ndarray, fixed_class: np.ndarray, moving_class: np.ndarray) -> float:
    """Sum over the classes of the mean distance between the fixed points of a class and the moved ones; points are homogeneous columns."""
    moved, total = transform @ moving, 0.0
    for k in np.intersect1d(fixed_class, moving_class):
        p, q = fixed[:-1, fixed_class == k], moved[:-1, moving_class == k]
        total += float(np.sqrt(((p[:, :, None] - q[:, None, :]) ** 2).sum(0)).mean())
    return total


def alignment_hessian(transform: np.ndarray, fixed: np.ndarray, moving: np.ndarray, fixed_class: np.ndarray, moving_class: np.ndarray) -> np.ndarray:
    """Second derivatives of the cost by the entries of the two upper rows, from exact sums over the pairs."""
    dims = fixed.shape[0] - 1
    size = dims * moving.shape[0]
    moved, out = transform @ moving, np.zeros((size, size))
    for k in np.intersect1d(fixed_class, moving_class):
        p, own = fixed[:-1, fixed_class == k], np.flatnonzero(moving_class == k)
        off = moved[:-1, own][:, None, :] - p[:, :, None]
        far = np.maximum(np.sqrt((off**2).sum(0)), 1e-12)
        for a in range(dims):
            for b in range(dims):
                curve = ((float(a == b) - off[a] * off[b] / far**2) / far).sum(0) / (p.shape[1] * len(own))
                part = (moving[:, own] * curve) @ moving[:, own].T
                out[a * moving.shape[0] : (a + 1) * moving.shape[0], b * moving.shape[0] : (b + 1) * moving.shape[0]] += part
    return out


def affine_fit(fixed: np.ndarray, moving: np.ndarray, fixed_class: np.ndarray, moving_class: np.ndarray, steps: int = 200) -> tuple[np.ndarray, float]:
    """(transform, cost): the affine transform that brings classes of ``moving`` to those of ``fixed``.

    Starts from the transform that scales the extents, and reweights least squares: with weights 1 / distance
    the normal equations of a step have the cost's minimum as their fixed point. The best step is kept.
    """
    ratio = np.diag(np.diag(extent(fixed)) / np.maximum(np.diag(extent(moving)), 1e-12))
    best, now = ratio, ratio
    cost = alignment_cost(best, fixed, moving, fixed_class, moving_class)
    for _ in range(steps):
        left, right = np.zeros((moving.shape[0],) * 2), np.zeros((fixed.shape[0] - 1, moving.shape[0]))
        moved = now @ moving
        for k in np.intersect1d(fixed_class, moving_class):
            p, own = fixed[:-1, fixed_class == k], np.flatnonzero(moving_class == k)
            far = np.sqrt(((moved[:-1, own][:, None, :] - p[:, :, None]) ** 2).sum(0))
            weight = 1 / np.maximum(far, 1e-9) / (p.shape[1] * len(own))
            left += (moving[:, own] * weight.sum(0)) @ moving[:, own].T
            right += p @ weight @ moving[:, own].T
        now = np.vstack([right @ np.linalg.pinv(left), np.eye(moving.shape[0])[-1:]])
        new = alignment_cost(now, fixed, moving, fixed_class, moving_class)
        if new < cost:
            better = cost - new
            best, cost = now, new
            if better < 1e-12:
                break
    return best, cost


def mixture(spark: SparkSession, n: int, centres: list[list[float]], spread: float = 0.3, seed: int = 1) -> DataFrame:
    """(id, part, v): ``n`` points of a mixture of equally likely normal components around ``centres``."""
    rows = spark.range(n).withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(len(centres))).cast("int"))
    middle = F.get(F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres]), F.col("part"))
    noise = F.array(*[F.randn(seed + k) * spread for k in range(len(centres[0]))])
    return rows.select("id", "part", F.zip_with(middle, noise, lambda a, b: a + b).alias("v"))
