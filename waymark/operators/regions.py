"""Searching regions: density clusters, hulls, circles, disjoint choices, quality."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.lineage import cut
from waymark.operators.graph import components
from waymark.operators.proximity import ball_sums, located, near_spots, points_in_regions


def density_clusters(points: DataFrame, eps_m: float, least: int) -> DataFrame:
    """(lng, lat, core, cluster): density clusters of spots; cluster is null for noise.

    A spot is core if at least ``least`` rows (itself included) are within
    ``eps_m``. Core spots within ``eps_m`` of each other share a cluster, named by its
    smallest core spot (by lng, then lat); a border spot joins the smallest cluster
    of its core neighbours. Neighbour counts are sums, not pairs; only pairs of spots are linked.
    """
    rows = cut(located(points.select("lng", "lat").dropna()))
    spots = rows.distinct().withColumn("key", F.concat_ws(",", "lng", "lat"))
    one = rows.select("lng", "lat", F.lit(0).alias("bin"), F.lit(1).alias("n"))
    near = ball_sums(spots, one, eps_m)
    counted = spots.join(near.select("key", "near"), "key").withColumn("core", F.col("near") >= least)
    core = counted.where("core").select("lng", "lat", F.struct("lng", "lat").alias("node"))
    pairs = near_spots(spots, eps_m).select(F.struct(F.col("lng_a").alias("lng"), F.col("lat_a").alias("lat")).alias("a"), F.struct(F.col("lng_b").alias("lng"), F.col("lat_b").alias("lat")).alias("b"))
    is_core = core.select("node")
    linked = pairs.join(is_core.withColumnRenamed("node", "a"), "a", "left_semi").join(is_core.withColumnRenamed("node", "b"), "b", "left_semi")
    labels = components(is_core, linked)
    mirrored = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beside = mirrored.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_border"))
    out = counted.withColumn("node", F.struct("lng", "lat")).join(labels, "node", "left").join(beside, "node", "left")
    cluster = F.coalesce("label", "_border")
    return out.select("lng", "lat", "core", F.when(cluster.isNotNull(), F.concat_ws(",", cluster["lng"], cluster["lat"])).alias("cluster"))


def local_dbscan(xy: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Labels from 0, -1 for noise, of a candidate set that fits one task.

    Rows are compared with those of the nine squares around them only, and no neighbours are kept. A row without a place is noise.
    """
    n = len(xy)
    label, k = np.full(n, -1), 0
    placed = np.isfinite(xy).all(1)
    if not placed.all():
        label[placed] = local_dbscan(xy[placed], eps, least)
        return label
    if not n:
        return label
    square = np.floor((xy - xy.min(0)) / (eps * (1 + 1e-9))).astype(np.int64) + 1
    wide = int(square[:, 1].max()) + 2
    cell = square[:, 0] * wide + square[:, 1]
    order = cell.argsort(kind="stable")
    ranked = cell[order]

    def around(c: int) -> np.ndarray:
        ends = np.searchsorted(ranked, [c - wide - 1, c - 1, c + wide - 1]), np.searchsorted(ranked, [c - wide + 1, c + 1, c + wide + 1], "right")
        return np.concatenate([order[lo:hi] for lo, hi in zip(*ends)])

    core, beside = np.zeros(n, dtype=bool), {}
    for c in np.unique(cell).tolist():
        beside[c] = near = around(c)
        own = order[np.searchsorted(ranked, c) : np.searchsorted(ranked, c, "right")]
        step = max(1, 1_000_000 // len(near))
        for at in range(0, len(own), step):
            part = own[at : at + step]
            core[part] = (((xy[near][None] - xy[part][:, None]) ** 2).sum(2) <= eps * eps).sum(1) >= least
    for i in range(n):
        if core[i] and label[i] < 0:
            todo, label[i] = [i], k
            while todo:
                p = todo.pop()
                free = beside[int(cell[p])]
                free = free[label[free] < 0]
                free = free[((xy[free] - xy[p]) ** 2).sum(1) <= eps * eps]
                label[free] = k
                todo += free[core[free]].tolist()
            k += 1
    return label


def good_clusters(xy: np.ndarray, eps: float, least: int, widest: float, most: int) -> list[np.ndarray]:
    """Clusters of a candidate set: relaxed up to five times while there is none, split again up to three times while too large."""

    def split(idx: np.ndarray, e: float, m: float, depth: int) -> list[np.ndarray]:
        lab = local_dbscan(xy[idx], e, max(2, int(round(m))))
        out = []
        for k in range(lab.max() + 1 if len(lab) else 0):
            part = idx[lab == k]
            small = len(part) <= most and np.ptp(xy[part], axis=0).max() <= widest
            out += [part] if small or depth >= 3 else split(part, e / 1.4, m * 1.3, depth + 1)
        return out

    for _ in range(6):
        found = split(np.arange(len(xy)), eps, least, 0)
        if found:
            return found
        eps, least = eps * 1.3, least / 1.4
    return []


def hull(xy: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise."""
    pts = sorted(set(map(tuple, xy.tolist())))
    if len(pts) < 3:
        return np.array(pts)

    def half(seq: list) -> list:
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def hull_distance(ring: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Distance of points from a convex ring's area, 0 inside."""
    if len(ring) == 1:
        return np.sqrt(((xy - ring[0]) ** 2).sum(1))
    a, b = ring, np.roll(ring, -1, axis=0)
    edge = b - a
    rel = xy[:, None, :] - a[None]
    t = np.clip((rel * edge).sum(2) / np.maximum((edge**2).sum(1), 1e-12), 0, 1)
    d = np.sqrt(((rel - t[..., None] * edge) ** 2).sum(2)).min(1)
    inside = (edge[:, 0] * rel[..., 1] - edge[:, 1] * rel[..., 0] >= 0).all(1) if len(ring) > 2 else np.zeros(len(xy), dtype=bool)
    return np.where(inside, 0.0, d)


def grown(cluster: np.ndarray, xy: np.ndarray, steps: int = 4) -> list[np.ndarray]:
    """Nested sets of rows of ``xy`` around a cluster: those in its hull, then dilated in equal steps up to its radius."""
    ring = hull(cluster)
    radius = math.sqrt(((cluster - cluster.mean(0)) ** 2).sum(1).max())
    d = hull_distance(ring, xy)
    out: list[np.ndarray] = []
    for k in range(steps + 1):
        rows = np.flatnonzero(d <= radius * k / max(1, steps))
        if len(rows) and (not out or len(rows) > len(out[-1])):
            out.append(rows)
    return out


def circle_centres(boxes: DataFrame, radius_m: float, step_m: float | None = None) -> DataFrame:
    """(city, key, lng, lat): centres in steps of ``step_m`` (a third of the radius by default) over each city's box."""
    step = (step_m or radius_m / 3) / 111_195.0
    lats = F.sequence(F.lit(0), F.floor((F.col("lat_ur") - F.col("lat_bl")) / step).cast("int"))
    wide = step / F.cos(F.radians((F.col("lat_bl") + F.col("lat_ur")) / 2))
    rows = boxes.withColumn("_w", wide).withColumn("i", F.explode(lats))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.floor((F.col("lng_ur") - F.col("lng_bl")) / F.col("_w")).cast("int"))))
    return rows.select(
        "city", F.concat_ws("/", "city", "i", "j").alias("key"), (F.col("lng_bl") + F.col("j") * F.col("_w")).alias("lng"), (F.col("lat_bl") + F.col("i") * F.lit(step)).alias("lat")
    )


# Circles nearer than this many times the sum of their radii are close.
CLOSE = 1.3


def close_circles(x1, y1, r1, x2, y2, r2) -> bool:
    """Nearer than 1.3 times the sum of the radii."""
    return math.hypot(x1 - x2, y1 - y2) < CLOSE * (r1 + r2)


def disjoint_circles(ranked: DataFrame, keys: list[str], top: int = 5) -> DataFrame:
    """Greedy choice of circles that are not close to a better one; ``ranked``: keys, key, x, y, radius, distance (metres).

    Ties by key. A group holds the circles laid over one area, whose number does
    not depend on the data.
    """
    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, "key", "x", "y", "radius", "distance"]) + ", rank int"

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for row in pdf.sort_values(["distance", "key"]).itertuples(index=False):
            if len(kept) < top and not any(close_circles(row.x, row.y, row.radius, o.x, o.y, o.radius) for o in kept):
                kept.append(row)
        out = pd.DataFrame(kept, columns=pdf.columns)[[*keys, "key", "x", "y", "radius", "distance"]]
        return out.assign(rank=range(1, len(out) + 1))

    return ranked.groupBy(*keys).applyInPandas(pick, schema)


def dcg(rel: Column, rank: Column) -> Column:
    """Aggregate: sum of (2 to the relevance, less 1) over log2(rank + 1)."""
    return F.sum((F.pow(F.lit(2.0), rel) - 1) / F.log2(rank + 1))


def square_dcg(rel: Column, rank: Column) -> Column:
    """Aggregate: sum of (relevance squared, less 1) over log2(rank + 1), ranks up to 5."""
    return F.sum((rel * rel - 1) / F.log2(rank + 1))


def cluster_f1(labels: np.ndarray, rows: list, golds: list[set], beta: float = 2.0) -> float:
    """Mean over clusters of the best F-score against a gold set; 0 without clusters."""
    scores = []
    for k in range(labels.max() + 1 if len(labels) else 0):
        part = {r for r, v in zip(rows, labels) if v == k}
        best = 0.0
        for g in golds:
            hit = len(part & g)
            if hit:
                p, r = hit / len(part), hit / len(g)
                best = max(best, (1 + beta**2) * p * r / (beta**2 * p + r))
        scores.append(best)
    return float(np.mean(scores)) if scores else 0.0


def greedy_choice(candidates: DataFrame, want: dict[int, int], k: int, bins: int, share: float = 1.0, seed: int = 1, theta: list[float] | None = None) -> DataFrame:
    """(venue, step, distance): k candidates chosen one by one, each the one that brings the histogram of all chosen nearest to ``want``.

    ``candidates``: venue and bins, one number (dimension times ``bins`` plus bin) per dimension; ``want``: bin number
    to count. What adding a venue costs depends on its bins alone, so a step is one table of (dimension, bin) costs
    and one pass over the candidates for the smallest sum; ties by venue. With ``share`` below 1 a seeded random part of
    the candidates stands for election in each step.
    """
    spark = candidates.sparkSession
    dims = max(want, default=-1) // bins + 1
    goal = np.zeros((dims, bins))
    for b, n in want.items():
        goal[divmod(b, bins)] += n
    goal /= np.maximum(1, goal.sum(1, keepdims=True))
    weight = np.ones(dims) if theta is None else np.asarray(theta, dtype=float)
    entropy = lambda p: -np.where(p > 0, p * np.log(np.where(p > 0, p, 1)), 0).sum(-1)
    have, out = np.zeros((dims, bins)), []
    for step in range(1, k + 1):
        # cost[dim, bin]: the divergence of the dimension once a venue of that bin is added
        p = (have[:, None, :] + np.eye(bins)[None]) / step
        cost = weight[:, None] * (entropy((p + goal[:, None, :]) / 2) - (entropy(p) + entropy(goal)[:, None]) / 2)
        table = F.array(*[F.lit(float(x)) for x in cost.ravel()])
        rest = candidates.where(~F.col("venue").isin([v for v, _, _ in out])) if out else candidates
        if share < 1:
            rest = rest.where(F.pmod(F.xxhash64(F.lit(seed), F.lit(step), "venue"), F.lit(1_000_000)) < share * 1_000_000)
        total = F.aggregate("bins", F.lit(0.0), lambda s, b: s + F.get(table, b))
        best = rest.select(F.round(total, 9).alias("d"), "venue", "bins").groupBy().agg(F.min(F.struct("d", "venue", "bins")).alias("b")).first()["b"]
        if best is None:
            break
        out.append((best["venue"], step, best["d"]))
        for b in best["bins"]:
            have[divmod(b, bins)] += 1
    return spark.createDataFrame(out, "venue string, step int, distance double")


def joined_shapes(shapes: DataFrame, points: DataFrame) -> DataFrame:
    """(part, shapes, points): shapes that share a point, directly or through others, made one, with the points inside any of them.

    ``shapes``: region and ring, ``points``: key, lng, lat. The union is that of the point sets: two shapes
    belong together if a point lies in both, so outlines that only overlap in empty ground stay apart.
    """
    inside = cut(points_in_regions(points.select("key", "lng", "lat"), shapes).distinct())
    first = inside.groupBy("key").agg(F.min("region").alias("a"))
    links = inside.join(first, "key").where(F.col("a") < F.col("region")).select("a", F.col("region").alias("b")).distinct()
    labels = components(inside.select(F.col("region").alias("node")).distinct(), links)
    named = inside.join(labels, inside["region"] == labels["node"]).select(F.col("label").alias("part"), "region", "key")
    return named.groupBy("part").agg(F.count_distinct("region").alias("shapes"), F.count_distinct("key").alias("points"))


def distance_surface(circles: DataFrame, keys: list[str], k: int = 100, power: float = 2.0) -> DataFrame:
    """(keys, ix, iy, distance): distances of circles (keys, x, y, distance) interpolated on a k x k grid between their extremes.

    Inverse-distance weights over the circles in a cell and its eight neighbours; cells without such circles have no row.
    """
    ends = circles.groupBy(*keys).agg(*[f(c).alias(f"_{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    rows = circles.join(ends, keys)
    step = {c: (F.col(f"_hi{c}") - F.col(f"_lo{c}")) / (k - 1) for c in "xy"}
    place = {c: F.when(step[c] > 0, F.round((F.col(c) - F.col(f"_lo{c}")) / step[c])).otherwise(0).cast("int") for c in "xy"}
    near = F.array(*[F.struct((place["x"] + i).alias("ix"), (place["y"] + j).alias("iy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = rows.withColumn("_c", F.explode(near)).where(F.col("_c.ix").between(0, k - 1) & F.col("_c.iy").between(0, k - 1))
    off = {c: F.col(c) - F.col(f"_lo{c}") - F.col(f"_c.i{c}") * step[c] for c in "xy"}
    weight = 1 / F.greatest(F.pow(F.sqrt(off["x"] * off["x"] + off["y"] * off["y"]), F.lit(power)), F.lit(1e-6))
    return spread.groupBy(*keys, F.col("_c.ix").alias("ix"), F.col("_c.iy").alias("iy")).agg((F.sum(F.col("distance") * weight) / F.sum(weight)).alias("distance"))


def random_hexagon(rng: np.random.Generator, x: float, y: float, sides: int = 6) -> np.ndarray:
    """The convex hull of corners around a point, each with its own radius of 150 to 600 m and a jittered angle."""
    radius = rng.integers(150, 601, sides)
    angles = (np.arange(sides) + rng.uniform(-0.16, 0.15, sides)) * 2 * math.pi / sides
    return hull(np.column_stack([x + radius * np.cos(angles), y + radius * np.sin(angles)]))


def weighted_index(rng: np.random.Generator, weights: np.ndarray) -> int:
    """A random row number, row k with the probability of its weight."""
    sums = np.cumsum(weights)
    return int(np.searchsorted(sums, rng.uniform(0, sums[-1]), "right"))


def random_baseline(xy: np.ndarray, golds: list[set], weights: np.ndarray | None = None, draws: int = 100, top: int = 5, seed: int = 1, least: int = 20, most: int = 750, tries: int = 10_000) -> list[float]:
    """Gains of ``top`` disjoint random polygons per draw, by their likeness to the gold sets of row numbers.

    Polygons are laid around venues drawn by weight; one counts if more than ``least`` and fewer than
    ``most`` venues lie in it and none of these in an earlier one. A draw ends early after ``tries`` polygons.
    """
    rng, out = np.random.default_rng(seed), []
    weights = np.ones(len(xy)) if weights is None else weights
    for _ in range(draws):
        used: set = set()
        score, rank = 0.0, 1
        for _ in range(tries):
            if rank > top:
                break
            ring = random_hexagon(rng, *xy[weighted_index(rng, weights)])
            rows = set(np.flatnonzero(hull_distance(ring, xy) == 0).tolist())
            if least < len(rows) < most and not rows & used:
                used |= rows
                rel = max((len(rows & g) / len(rows | g) for g in golds), default=0.0)
                score += rel * rel / math.log2(rank + 1)
                rank += 1
        out.append(score)
    return out
