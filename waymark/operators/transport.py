"""Distances between weighted sets of vectors: earth mover's, partial, and by clusters."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.lineage import fresh


def moved(cost: np.ndarray, supply: np.ndarray, demand: np.ndarray, fraction: float = 1.0) -> float:
    """The least cost of moving ``fraction`` of the mass from rows to columns, per mass moved.

    Weights must be positive; masses are normalised to 1. What a partial flow leaves
    stays at one more row and column, which all others reach for nothing.
    """
    n, m = cost.shape
    if not n or not m or fraction <= 0:
        return 0.0
    alike = fraction == 1 and (supply == supply[0]).all() and (demand == demand[0]).all()
    if alike:  # whole numbers: no rounding, as ties are many
        return cheapest_flow(cost, [m] * n, [n] * m) / (n * m)
    s, d = supply / supply.sum(), demand / demand.sum()
    if fraction < 1:
        s, d = np.append(s, 1 - fraction), np.append(d, 1 - fraction)
        cost = np.pad(cost, (0, 1))
        cost[n, m] = 2 * cost.max() + 1
    return cheapest_flow(cost, s.tolist(), d.tolist()) / min(1.0, fraction)


def near_prices(cost: np.ndarray, s: np.ndarray, d: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Prices of rows and columns, of which no two sum to more than their cost, near the best: scaled for an entropic flow, then lowered to fit."""
    width = max(float(cost.mean()) * 0.02, 1e-12)
    least = cost.min(1)
    kernel = np.exp((least[:, None] - cost) / width)
    y, low = np.ones(len(d)), 1e-200
    for _ in range(rounds):
        x = s / np.maximum(kernel @ y, low)
        y = d / np.maximum(x @ kernel, low)
    u = least + width * np.log(np.maximum(x, low))
    v = (cost - u[:, None]).min(0)
    return (cost - v).min(1), v


def cheapest_flow(cost: np.ndarray, supply: list, demand: list) -> float:
    """The least cost of a flow from rows to columns of equal sums, all positive: the network simplex method.

    The first flow fills the arcs of least reduced cost under ``near_prices``. Trees stay strongly feasible (an arc without
    flow leads to the root), so that ties don't make it run in circles. An arc that would gain less than 1e-11 of the largest
    cost is left out, which bounds the error.
    """
    n, m = cost.shape
    u, v = near_prices(cost, np.array(supply, float), np.array(demand, float))
    s, d, tiny = list(supply), list(demand), 0 if isinstance(supply[0], int) else 1e-15
    # a node's arc to its parent: rows 0 .. n - 1, columns n .. n + m - 1, then the root
    beside: list[list] = [[] for _ in range(n + m)]
    open_s, open_d = np.ones(n, dtype=bool), np.ones(m, dtype=bool)
    order = np.argsort(cost - u[:, None] - v, axis=None)
    for at in range(0, n * m, 4096):
        if not open_s.any() or not open_d.any():
            break
        i, j = np.divmod(order[at : at + 4096], m)
        keep = open_s[i] & open_d[j]
        for a, b in zip(i[keep].tolist(), j[keep].tolist()):
            x = min(s[a], d[b])
            if x > tiny:
                beside[a].append((n + b, x))
                beside[n + b].append((a, x))
                s[a] -= x
                d[b] -= x
                open_s[a], open_d[b] = s[a] > tiny, d[b] > tiny
    root = n + m
    parent, flow, depth, price = [-1] * (root + 1), [0] * (root + 1), [0] * (root + 1), [0.0] * (root + 1)
    below: list[set] = [set() for _ in range(root + 1)]
    for top in range(root):  # each part of the first flow hangs by a row, a column that rounding left alone by itself
        if parent[top] < 0 and (top < n or not beside[top]):
            parent[top], depth[top], price[top] = root, 1, float(u[top] if top < n else v[top - n])
            below[root].add(top)
            todo = [top]
            while todo:
                a = todo.pop()
                for b, x in beside[a]:
                    if parent[b] < 0:
                        parent[b], flow[b], depth[b] = a, x, depth[a] + 1
                        price[b] = float(cost[min(a, b), max(a, b) - n]) - price[a]
                        below[a].add(b)
                        todo.append(b)
    slack = 1e-11 * max(float(np.abs(cost).max()), 1e-300)
    while True:
        now = np.array(price[:root])
        left = cost - now[:n, None] - now[n:]
        row, col = left.argmin(0), left.argmin(1)
        i, j = np.concatenate([row, np.arange(n)]), np.concatenate([np.arange(m), col])
        gain = left[i, j]
        pick = np.flatnonzero(gain < -slack)
        if not len(pick):
            break
        pick = pick[gain[pick].argsort()]
        for a, b in zip(i[pick].tolist(), (j[pick] + n).tolist()):
            r = float(cost[a, b - n]) - price[a] - price[b]
            if r >= -slack:
                continue
            # the circle of the new arc; flow shrinks on rows' arcs at its start and on columns' arcs at its end
            x, y, way_a, way_b = a, b, [], []
            while x != y:
                if depth[x] >= depth[y]:
                    way_a.append(x)
                    x = parent[x]
                else:
                    way_b.append(y)
                    y = parent[y]
            most, out, start = float("inf"), -1, True
            for x in way_a:
                if x < n and flow[x] < most:
                    most, out = flow[x], x
            for y in way_b:
                if y >= n and flow[y] <= most:
                    most, out, start = flow[y], y, False
            if most:
                for x in way_a:
                    flow[x] += -most if x < n else most
                for y in way_b:
                    flow[y] += most if y < n else -most
            # the part cut off hangs by its end of the new arc
            x, up, carried = (a, b, most) if start else (b, a, most)
            head = x
            while True:
                old, held = parent[x], flow[x]
                below[old].discard(x)
                parent[x], flow[x] = up, carried
                below[up].add(x)
                if x == out:
                    break
                x, up, carried = old, x, held
            todo, shift = [head], r if start else -r
            while todo:
                x = todo.pop()
                depth[x] = depth[parent[x]] + 1
                price[x] += shift if x < n else -shift
                todo += below[x]
    return float(sum(flow[x] * cost[min(x, parent[x]), max(x, parent[x]) - n] for x in range(root) if parent[x] != root))


def euclidean(x: np.ndarray, y: np.ndarray, theta: np.ndarray | None = None) -> np.ndarray:
    """Weighted Euclidean ground distances of all rows."""
    w = np.ones(x.shape[1]) if theta is None else theta
    out, step = np.empty((len(x), len(y))), max(1, 1_000_000 // max(1, y.size))
    for at in range(0, len(x), step):
        out[at : at + step] = np.sqrt((((x[at : at + step, None, :] - y[None, :, :]) ** 2) * w).sum(2))
    return out


def mahalanobis(inverse: np.ndarray) -> Callable:
    """Ground distance of a learned matrix: Euclidean after whitening by its Cholesky factor."""
    factor = np.linalg.cholesky(inverse)
    return lambda x, y: euclidean(x @ factor, y @ factor)


def venue_weights(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds ``w``: each row's share of the scaled fifth root of ``value`` in its group, at least 1e-6.

    The root is scaled to 0 ... 1 between the group's extremes; a group of equal values weighs 1e-6 each. Negative and null values count as 0.
    """
    root = F.pow(F.greatest(F.coalesce(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.2))
    rooted = rows.withColumn("_u", root)
    bounds = rooted.groupBy(*keys).agg(F.min("_u").alias("_lo"), F.sum("_u").alias("_s"), F.count(F.lit(1)).alias("_n"))
    share = F.try_divide(F.col("_u") - F.col("_lo"), F.col("_s") - F.col("_n") * F.col("_lo"))
    joined = rooted.join(bounds, keys)
    return joined.withColumn("w", F.greatest(F.coalesce(share, F.lit(0.0)), F.lit(1e-6))).drop("_u", "_lo", "_s", "_n")


#: Names of the distances between regions that ``region_distance`` takes.
METRICS = ("jsd", "emd", "partial", "cluster")


def region_distance(metric: str, x: np.ndarray, y: np.ndarray, wx: np.ndarray | None = None, wy: np.ndarray | None = None, theta: np.ndarray | None = None, support: np.ndarray | None = None) -> float:
    """The distance of two regions' venue vectors by name.

    ``jsd``: weighted divergence of their histograms in ten bins between ``support`` (2 rows: least and largest);
    ``emd``: least cost of moving all mass, ``partial``: of 0.8 of it; ``cluster``: cheapest assignment of
    three weighted centroids of each (k-means from the three vectors farthest apart). ``theta`` weighs the features.
    """
    wx, wy = (np.ones(len(v)) if w is None else w for v, w in ((x, wx), (y, wy)))
    if metric == "jsd":
        lo, hi = support if support is not None else (np.minimum(x.min(0), y.min(0)), np.maximum(x.max(0), y.max(0)))
        span = np.where(hi > lo, hi - lo, 1.0)
        total = 0.0
        for k in range(x.shape[1]):
            shares = []
            for v, w in ((x, wx), (y, wy)):
                at = np.minimum((v[:, k] - lo[k]) / span[k] * 10, 9).astype(int) if hi[k] > lo[k] else np.full(len(v), 9)
                shares.append(np.bincount(np.maximum(at, 0), w, 10) / w.sum())
            h = [-(s[s > 0] * np.log(s[s > 0])).sum() for s in (*shares, (shares[0] + shares[1]) / 2)]
            total += (1.0 if theta is None else theta[k]) * (h[2] - (h[0] + h[1]) / 2)
        return float(total)
    if metric in ("emd", "partial"):
        return moved(euclidean(x, y, theta), wx, wy, 1.0 if metric == "emd" else 0.8)
    if metric == "cluster":
        return best_assignment(euclidean(_three_centroids(x, wx), _three_centroids(y, wy), theta))
    raise ValueError(f"unknown metric {metric}; known are {', '.join(METRICS)}")


def _three_centroids(v: np.ndarray, w: np.ndarray, steps: int = 20) -> np.ndarray:
    centres = [v[0]]
    for _ in range(2):
        centres.append(v[np.min([((v - c) ** 2).sum(1) for c in centres], axis=0).argmax()])
    centres = np.array(centres)
    for _ in range(steps):
        label = ((v[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([(v[label == k] * w[label == k, None]).sum(0) / w[label == k].sum() if (label == k).any() else centres[k] for k in range(3)])
    return centres


def best_assignment(cost: np.ndarray) -> float:
    """Mean cost of the cheapest one-to-one assignment of k clusters (k small: all orders are tried)."""
    k = len(cost)
    return min(sum(cost[i, p[i]] for i in range(k)) for p in permutations(range(k))) / k


def pair_distances(pairs: DataFrame, members: DataFrame, fraction: float = 1.0, ground: Callable = euclidean, metric: str | None = None) -> DataFrame:
    """(a, b, distance) of pairs (a, b) of sets; ``members``: set, v, w. With ``metric`` by ``region_distance``, else the earth mover's.

    A set is what one region holds; both sets of a pair are one task's input.
    """
    left = pairs.join(members.withColumnRenamed("set", "a"), "a").selectExpr("a", "b", "v", "w")
    right = fresh(pairs.join(members.withColumnRenamed("set", "b"), "b").selectExpr("a", "b", "v", "w"))
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}

    def solve(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame(columns=["a", "b", "distance"], dtype=object)
        p, q = np.stack(x["v"].to_numpy()), np.stack(y["v"].to_numpy())
        wp, wq = x["w"].to_numpy(float), y["w"].to_numpy(float)
        far = region_distance(metric, p, q, wp, wq) if metric else moved(ground(p, q), wp, wq, fraction)
        return pd.DataFrame({"a": [key[0]], "b": [key[1]], "distance": [far]})

    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(solve, f"a {kinds['a']}, b {kinds['b']}, distance double")
