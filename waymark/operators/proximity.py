"""Points near other points or inside regions, by latitude strips and a longitude sweep.

The plane is cut into latitude strips at quantiles of the points, each strip
into as many segments, at quantiles of their longitude, as its points need, so cells hold
about equally many points wherever those lie. A point belongs to exactly one cell. A target (the
search box around a point, or the bounding box of a region) is copied to
every cell it overlaps. A pair is therefore met in one cell only, that of its
point: no pair is lost at a border and none is found twice.

Inside a cell the points are sorted by longitude. For each target the active points
are a contiguous run of that order, found by two binary searches; latitude and
then the exact test follow. The work of a cell is its size times log plus the
runs themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.lineage import cut

EARTH_RADIUS_M = 6_371_008.8
#: Pairs tested in one NumPy step.
STEP = 1_000_000
TILES = 1_000_000


#: Depths of the searches for a strip and a segment: at most 2**20 cells, whose bounds are a broadcast row of 9 MB.
MAX_DEPTH = (10, 10)


class Grid:
    """Strips, segments and salts: arrays whose size depends on the depths alone."""

    def __init__(self, lat: list[float], lng: list[list[float]], salts: list[list[int]], depth: tuple[int, int]):
        self.lat, self.lng, self.salts, self.depth = lat, lng, salts, depth

    def beside(self, df: DataFrame) -> DataFrame:
        """``df`` with the grid's arrays _lat, _lng and _salts in every row, from one broadcast row."""
        row = df.sparkSession.createDataFrame([(self.lat, self.lng, self.salts)], "_lat array<double>, _lng array<array<double>>, _salts array<array<int>>")
        return df.join(F.broadcast(row))


def _search(df: DataFrame, value: Column, bounds: Column, depth: int, out: str) -> DataFrame:
    """Adds ``out``: how many of the 2**depth - 1 sorted bounds are <= value; unrolled binary search, all in codegen."""
    df = df.withColumn(out, F.lit(0))
    for level in reversed(range(depth)):
        half = 1 << level
        df = df.withColumn(out, F.col(out) + F.when(value >= F.get(bounds, F.col(out) + (half - 1)), half).otherwise(0))
    return df


def _thinned(bounds: list[float] | None, parts: int, size: int, rows: int, per_cell: int) -> tuple[list[float], list[int]]:
    """``size`` sorted bounds of which up to ``parts`` - 1 are finite, picked from equally spaced quantiles, and the salts of their cells.

    A value that fills several quantiles is one bound; its cell gets as many salts as those quantiles' share of ``rows`` needs.
    """
    every = bounds or []
    picked = [every[len(every) * k // parts] for k in range(1, parts)] if every else []
    have = sorted(set(picked))
    repeats = [1] + [picked.count(b) for b in have]
    salts = [max(1, math.ceil(rows * n / parts / (2 * per_cell))) for n in repeats]
    lacking = size - len(have)
    return [float(b) for b in have] + [math.inf] * lacking, salts + [1] * lacking


def located(df: DataFrame) -> DataFrame:
    """Rows whose lng and lat are numbers on the globe; negative zero becomes zero."""
    ok = F.col("lng").between(-180.0, 180.0) & F.col("lat").between(-90.0, 90.0)
    return df.where(ok & ~F.isnan("lng") & ~F.isnan("lat")).withColumns({c: F.col(c) + F.lit(0.0) for c in ("lng", "lat")})


def build_grid(points: DataFrame, per_cell: int = 20_000, max_depth: tuple[int, int] = MAX_DEPTH) -> Grid:
    """Quantile grid of ``points`` (lng, lat), from mergeable sketches over all of them, in two passes.

    What comes to the driver is at most 2**(sum of max_depth) bounds,
    whatever the number of points. Cells that hold many points of one position, or more
    than twice ``per_cell`` at the greatest depths, get salts.
    """
    levels = [1 << x for x in max_depth]
    steps = [[i / n for i in range(1, n)] for n in levels]
    n, quantiles = points.agg(F.count(F.lit(1)), F.percentile_approx("lat", steps[0], 10_000)).first()
    cells = max(1.0, n / per_cell)
    ds = min(max_depth[0], math.ceil(math.log2(cells) / 2) + 1)
    lat = _thinned(quantiles, 1 << ds, (1 << ds) - 1, 0, per_cell)[0]
    bounds = points.sparkSession.createDataFrame([(lat,)], "_lat array<double>")
    strips = _search(points.join(F.broadcast(bounds)), F.col("lat"), F.col("_lat"), ds, "_s")
    few = [i / k for k in [min(levels[1], 4 << math.ceil(math.log2(cells)))] for i in range(1, k)]
    found = {r[0]: r[1:] for r in strips.groupBy("_s").agg(F.count(F.lit(1)), F.percentile_approx("lng", few, 10_000)).collect()}
    parts = {s: min(levels[1], len(few) + 1, max(1, math.ceil(c / per_cell))) for s, (c, _) in found.items()}
    dg = math.ceil(math.log2(max(parts.values(), default=1)))
    lng, salts = [], []
    for s in range(1 << ds):
        c, q = found.get(s, (0, None))
        inner, salted = _thinned(q, parts.get(s, 1), (1 << dg) - 1, c, per_cell)
        lng.append(inner)
        salts.append(salted)
    return Grid(lat, lng, salts, (ds, dg))


def _cells_of_points(points: DataFrame, grid: Grid, by: str) -> DataFrame:
    """Adds _cell; a salted cell's points are spread over its salts by a hash of ``by``."""
    ds, dg = grid.depth
    df = _search(grid.beside(points), F.col("lat"), F.col("_lat"), ds, "_s")
    df = _search(df, F.col("lng"), F.get("_lng", F.col("_s")), dg, "_g")
    salt = F.pmod(F.xxhash64(by), F.get(F.get("_salts", F.col("_s")), F.col("_g")).cast("bigint"))
    return df.withColumn("_cell", F.concat_ws("/", "_s", "_g", salt)).drop("_s", "_g", "_lat", "_lng", "_salts")


def _cells_of_boxes(boxes: DataFrame, grid: Grid) -> DataFrame:
    """One row for each cell and salt that the box (x0, x1, y0, y1) overlaps."""
    ds, dg = grid.depth
    df = _search(grid.beside(boxes), F.col("y0"), F.col("_lat"), ds, "_s0")
    df = _search(df, F.col("y1"), F.col("_lat"), ds, "_s1").drop("_lat", "_lng", "_salts")
    df = grid.beside(df.withColumn("_s", F.explode(F.sequence("_s0", "_s1"))).drop("_s0", "_s1"))
    bounds = F.get("_lng", F.col("_s"))
    df = _search(df, F.col("x0"), bounds, dg, "_g0")
    df = _search(df, F.col("x1"), bounds, dg, "_g1")
    df = df.withColumn("_all", F.get("_salts", F.col("_s"))).drop("_lat", "_lng", "_salts")
    df = df.withColumn("_g", F.explode(F.sequence("_g0", "_g1"))).drop("_g0", "_g1")
    df = df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.get("_all", F.col("_g")) - 1))).drop("_all")
    return df.withColumn("_cell", F.concat_ws("/", "_s", "_g", "_salt")).drop("_s", "_g", "_salt")


def _sweep(points: pd.DataFrame, boxes: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(point rows, box rows) of points inside boxes, in steps of bounded size; points must be sorted by lng."""
    x, y = points["lng"].to_numpy(), points["lat"].to_numpy()
    lo = np.searchsorted(x, boxes["x0"].to_numpy(), "left")
    hi = np.searchsorted(x, boxes["x1"].to_numpy(), "right")
    y0, y1 = boxes["y0"].to_numpy(), boxes["y1"].to_numpy()
    runs = np.maximum(hi - lo, 0)
    total = np.concatenate([[0], np.cumsum(runs)])
    for at in range(0, int(total[-1]), STEP):
        k = np.arange(at, min(at + STEP, int(total[-1])))
        box = np.searchsorted(total, k, "right") - 1
        point = lo[box] + (k - total[box])
        inside = (y[point] >= y0[box]) & (y[point] <= y1[box])
        if inside.any():
            yield point[inside], box[inside]


def great_circle_m(lng1, lat1, lng2, lat2) -> np.ndarray:
    """Metres along the great circle of a sphere (haversine form, accurate for short distances)."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lng2 - lng1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def _boxes(points: DataFrame, radius_m: float, keep: list[str]) -> DataFrame:
    """The search box around each point; one that crosses the antimeridian comes once on each side of it."""
    angle = radius_m / EARTH_RADIUS_M
    dy = math.degrees(angle) * (1 + 1e-9) + 1e-12
    reach = math.sin(min(angle, math.pi / 2))
    top = F.radians(F.least(F.lit(90.0), F.abs("lat") + dy))
    dx = F.when(F.cos(top) > reach, F.degrees(F.asin(F.lit(reach) / F.cos(top))) * (1 + 1e-9) + 1e-12).otherwise(360.0)
    shift = F.array(F.lit(0.0), F.when(F.col("lng") - dx < -180, 360.0), F.when(F.col("lng") + dx > 180, -360.0))
    moved = points.withColumn("_d", F.explode(F.filter(F.array_distinct(shift), lambda d: d.isNotNull())))
    return moved.select(
        *keep, F.col("lng").alias("bx"), F.col("lat").alias("by"),
        (F.col("lng") - dx + F.col("_d")).alias("x0"), (F.col("lng") + dx + F.col("_d")).alias("x1"),
        (F.col("lat") - dy).alias("y0"), (F.col("lat") + dy).alias("y1"),
    )


def near_spots(points: DataFrame, radius_m: float, per_cell: int = 20_000) -> DataFrame:
    """Pairs of different spots at most ``radius_m`` apart: lng_a, lat_a, lng_b, lat_b, metres.

    ``points`` needs lng and lat; other columns are ignored. Rows off the globe
    or with a null are left out. Equal positions are one spot, so any number of
    rows on one spot costs one row here. Each pair comes once, with
    (lng_a, lat_a) < (lng_b, lat_b). The antimeridian and the poles are no borders.
    """
    spots = cut(located(points.select("lng", "lat")).distinct())
    grid = build_grid(spots, per_cell)
    boxes = _boxes(spots, radius_m, [])
    placed = _cells_of_points(spots.withColumn("_id", F.col("lng")), grid, "_id").drop("_id")
    schema = "lng_a double, lat_a double, lng_b double, lat_b double, metres double"

    def sweep(pts: pd.DataFrame, bxs: pd.DataFrame) -> pd.DataFrame:
        pts = pts.sort_values("lng", kind="stable", ignore_index=True)
        px, py, qx, qy = (c.to_numpy() for c in (pts["lng"], pts["lat"], bxs["bx"], bxs["by"]))
        kept = []
        for p, b in _sweep(pts, bxs):
            first = (px[p] < qx[b]) | ((px[p] == qx[b]) & (py[p] < qy[b]))
            p, b = p[first], b[first]
            metres = great_circle_m(px[p], py[p], qx[b], qy[b])
            near = metres <= radius_m
            kept.append((px[p][near], py[p][near], qx[b][near], qy[b][near], metres[near]))
        cols = [np.concatenate(c) for c in zip(*kept)] if kept else [np.empty(0)] * 5
        return pd.DataFrame(dict(zip(("lng_a", "lat_a", "lng_b", "lat_b", "metres"), cols)))

    cells = _cells_of_boxes(boxes, grid)
    found = placed.groupBy("_cell").cogroup(cells.groupBy("_cell")).applyInPandas(lambda p, b: sweep(p, b), schema)
    return found if radius_m < EARTH_RADIUS_M / 4 else found.distinct()


def near_rows(points: DataFrame, key: str, radius_m: float, per_cell: int = 20_000) -> DataFrame:
    """Pairs of rows at most ``radius_m`` apart, a < b by ``key``: columns a, b.

    ``points`` has ``key``, lng and lat. The spots are paired by ``near_spots``;
    the rows of equal or paired spots follow by equi-joins on the position.
    Rows repeated with one key and position count once; a null key or position
    is left out. Two positions of one key are never a pair.
    """
    rows = located(points.select(F.col(key).alias("k"), "lng", "lat").dropna()).distinct()
    left = rows.select(F.col("k").alias("ka"), F.col("lng").alias("lng_a"), F.col("lat").alias("lat_a"))
    right = rows.select(F.col("k").alias("kb"), F.col("lng").alias("lng_b"), F.col("lat").alias("lat_b"))
    spots = near_spots(rows, radius_m, per_cell).drop("metres")
    apart = spots.join(left, ["lng_a", "lat_a"]).join(right, ["lng_b", "lat_b"]).where("ka <> kb")
    apart = apart.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))
    shared = rows.groupBy("lng", "lat").count().where("count > 1").drop("count")
    twins = rows.join(shared, ["lng", "lat"])
    same = twins.alias("p").join(twins.alias("q"), ["lng", "lat"]).where("p.k < q.k")
    return apart.unionByName(same.select(F.col("p.k").alias("a"), F.col("q.k").alias("b"))).distinct()


def near_counts(points: DataFrame, key: str, radius_m: float, per_cell: int = 20_000) -> DataFrame:
    """(key, neighbours) of each row with other rows at most ``radius_m`` away: how many these are.

    Rows are different (key, position); nulls and impossible positions are left out. Spots carry
    the number of their rows, so rows of one spot are never paired.
    """
    rows = cut(located(points.select(F.col(key).alias("_k"), "lng", "lat").dropna()).distinct())
    here = rows.groupBy("lng", "lat").agg(F.count(F.lit(1)).alias("_n"))
    spots = near_spots(rows, radius_m, per_cell)
    ends = [("lng_a", "lat_a", "lng_b", "lat_b"), ("lng_b", "lat_b", "lng_a", "lat_a")]
    both = [spots.select(*[F.col(c).alias(n) for c, n in zip(e, ("lng", "lat", "x", "y"))]) for e in ends]
    beside = both[0].unionByName(both[1]).join(here.select(F.col("lng").alias("x"), F.col("lat").alias("y"), "_n"), ["x", "y"])
    around = beside.groupBy("lng", "lat").agg(F.sum("_n").alias("_m"))
    total = here.join(around, ["lng", "lat"], "left").select("lng", "lat", (F.col("_n") - 1 + F.coalesce("_m", F.lit(0))).alias("neighbours"))
    return rows.join(total.where("neighbours > 0"), ["lng", "lat"]).select(F.col("_k").alias(key), "neighbours")


def on_shared_tiles(centres: DataFrame, points: DataFrame, radius_m: float) -> DataFrame:
    """The centres on a tile that the search box of some point touches; the others have no neighbour. For centres laid over areas that are mostly empty."""
    spots = located(points.select("lng", "lat").dropna()).distinct()
    return _on_tiles(centres, _boxes(spots, radius_m, []))


def ball_sums(centres: DataFrame, points: DataFrame, radius_m: float, scale: float | None = None, per_cell: int = 50_000) -> DataFrame:
    """(key, bin, near, weight): for each centre and bin the points at most ``radius_m`` away.

    ``centres``: key, lng, lat; ``points``: lng, lat, bin (an int) and n (how many
    there are). near is the sum of n, weight the sum of n * exp(-d^2 / scale) with
    d in metres (n itself without ``scale``). Equal (position, bin) points are
    added up first, and only sums per centre, bin and cell leave a task, never
    pairs. Nulls and impossible positions are left out; a centre without
    neighbours gives no row.
    """
    spots = located(points.dropna(subset=["lng", "lat", "bin", "n"]))
    spots = cut(spots.groupBy("lng", "lat", "bin").agg(F.sum("n").cast("double").alias("n")))
    middles = located(centres.select("key", "lng", "lat").dropna()).distinct()
    grid = build_grid(spots.select("lng", "lat"), per_cell)
    cells = _cells_of_boxes(_boxes(middles, radius_m, ["key"]), grid)
    placed = _cells_of_points(spots.withColumn("_by", F.struct("lng", "lat", "bin")), grid, "_by").drop("_by")
    placed = placed.join(cells.select("_cell").distinct(), "_cell", "left_semi")
    kind = centres.schema["key"].dataType.simpleString()

    def sweep(pts: pd.DataFrame, bxs: pd.DataFrame) -> pd.DataFrame:
        pts = pts.sort_values("lng", kind="stable", ignore_index=True)
        px, py, qx, qy, n = (c.to_numpy() for c in (pts["lng"], pts["lat"], bxs["bx"], bxs["by"], pts["n"]))
        bins, code = np.unique(pts["bin"].to_numpy(), return_inverse=True)
        near, weight = np.zeros(len(bxs) * len(bins)), np.zeros(len(bxs) * len(bins))
        for p, b in _sweep(pts, bxs):
            metres = great_circle_m(px[p], py[p], qx[b], qy[b])
            ok = metres <= radius_m
            p, b, metres = p[ok], b[ok], metres[ok]
            at = b * len(bins) + code[p]
            near += np.bincount(at, n[p], len(near))
            weight += np.bincount(at, n[p] * (np.exp(-metres * metres / scale) if scale else 1.0), len(near))
        hit = np.flatnonzero(near)
        return pd.DataFrame({"key": bxs["key"].to_numpy()[hit // len(bins)], "bin": bins[hit % len(bins)], "near": near[hit], "weight": weight[hit]})

    parts = placed.groupBy("_cell").cogroup(cells.groupBy("_cell")).applyInPandas(
        lambda p, b: sweep(p, b), f"key {kind}, bin int, near double, weight double"
    )
    return parts.groupBy("key", "bin").agg(F.sum("near").cast("bigint").alias("near"), F.sum("weight").alias("weight"))


def inside_ring(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Even-odd test of points against one ring of (lng, lat), closed here if open."""
    inside = np.zeros(len(x), dtype=bool)
    x0, y0 = ring[-1]
    for x1, y1 in ring:
        if y0 != y1:
            cross = (y0 > y) != (y1 > y)
            inside ^= cross & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
        x0, y0 = x1, y1
    return inside


def _on_tiles(rows: DataFrame, boxes: DataFrame) -> DataFrame:
    """The rows on the tiles that some box touches; tiles of 1/64 degree, or larger so that boxes have about TILES together."""
    area = boxes.agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))).first()[0] or 0.0
    side = max(1 / 64, math.sqrt(area / TILES))

    def tile(c: str) -> Column:
        return F.floor(F.col(c) / side)

    tiles = boxes.select("y0", "y1", F.explode(F.sequence(tile("x0"), tile("x1"))).alias("_tx")).select("_tx", F.explode(F.sequence(tile("y0"), tile("y1"))).alias("_ty"))
    return rows.withColumns({"_tx": tile("lng"), "_ty": tile("lat")}).join(tiles.distinct(), ["_tx", "_ty"], "left_semi").drop("_tx", "_ty")


def points_in_regions(points: DataFrame, regions: DataFrame, per_cell: int = 50_000) -> DataFrame:
    """Each point's containing regions: columns of ``points`` except lng and lat, plus region.

    ``points``: lng, lat and any id columns; ``regions``: region (its id) and
    ring, an array of lng/lat structs in the plane. Rings may turn either way, be
    concave, overlap, and lack the closing point; fewer than three usable points contain
    nothing. Points exactly on a border may go either way. Points with a null
    or an impossible position are in no region. Repeated rows give repeated results.
    """
    ids = [c for c in points.columns if c not in ("lng", "lat")]
    rows = located(points.dropna(subset=["lng", "lat"]))
    usable = F.filter("ring", lambda p: p["lng"].isNotNull() & p["lat"].isNotNull())
    shapes = regions.select(F.col("region"), usable.alias("ring")).where(F.col("region").isNotNull() & (F.size("ring") > 2))
    boxes = shapes.select(
        "region",
        F.transform("ring", lambda p: p["lng"]).alias("rx"), F.transform("ring", lambda p: p["lat"]).alias("ry"),
    ).select(
        "region", "rx", "ry", F.array_min("rx").alias("x0"), F.array_max("rx").alias("x1"),
        F.array_min("ry").alias("y0"), F.array_max("ry").alias("y1"),
    )
    rows = cut(_on_tiles(rows, boxes))
    grid = build_grid(rows.select("lng", "lat"), per_cell)
    cells = _cells_of_boxes(boxes, grid)
    placed = _cells_of_points(rows.withColumn("_by", F.struct("lng", "lat", *ids)), grid, "_by").drop("_by")
    placed = placed.join(cells.select("_cell").distinct(), "_cell", "left_semi")
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in ids] + ["region string"])

    def sweep(pts: pd.DataFrame, bxs: pd.DataFrame) -> pd.DataFrame:
        pts = pts.sort_values("lng", kind="stable", ignore_index=True)
        x, y = pts["lng"].to_numpy(), pts["lat"].to_numpy()
        rings = [np.column_stack([a, b]) for a, b in zip(bxs["rx"], bxs["ry"])]
        names = bxs["region"].to_numpy()
        at, region = [np.empty(0, dtype=int)], [np.empty(0, dtype=object)]
        for p, b in _sweep(pts, bxs):
            for k in np.unique(b):
                q = p[b == k]
                q = q[inside_ring(x[q], y[q], rings[k])]
                at.append(q)
                region.append(np.full(len(q), names[k], dtype=object))
        out = pts[ids].iloc[np.concatenate(at)].reset_index(drop=True)
        return out.assign(region=np.concatenate(region))

    return placed.groupBy("_cell").cogroup(cells.groupBy("_cell")).applyInPandas(lambda p, b: sweep(p, b), schema)

