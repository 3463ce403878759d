import itertools
import math
import random
import time
import tracemalloc

import numpy as np
import pytest

from waymark.operators import graph, knn, regions, scan, transport


def test_nearest_as_brute_force(spark):
    rng = np.random.default_rng(1)
    q = [("a" if i % 3 else "b", f"q{i:03d}", rng.integers(0, 4, 3).astype(float).tolist()) for i in range(60)]
    t = [("a", f"t{i:03d}", rng.integers(0, 4, 3).astype(float).tolist()) for i in range(90)] + [("c", "x", [0.0] * 3)]
    schema = "g string, id string, v array<double>"
    got = knn.nearest(spark.createDataFrame(q, schema), spark.createDataFrame(t, schema), ["g"], 4, query_block=7, target_block=11).collect()
    want = set()
    for g, i, v in q:
        best = sorted((round(math.dist(v, w), 9), k) for h, k, w in t if h == g)[:4]
        want |= {(i, k, n + 1) for n, (_, k) in enumerate(best)}
    assert {(r["q"], r["t"], r["rank"]) for r in got} == want
    a = spark.createDataFrame([("g", "q", [1.0, 2.0])], schema)
    b = spark.createDataFrame([("g", "t", [1.0, 5.0])], schema)
    pairs = knn.nearest(a, b, ["g"], 1)
    assert [r["percent"] for r in knn.explained(pairs, a, b).orderBy("dim").collect()] == [0.0, 100.0]
    assert knn.nearest(a.limit(0), b, ["g"], 1).count() == 0


def test_nearest_of_one_frame_with_itself(spark):
    df = spark.createDataFrame([(1, i, [float(i)]) for i in range(5)], "g int, id int, v array<double>")
    assert knn.nearest(df, df, ["g"], 1).where("q = t").count() == 5


def test_loops(spark):
    shape = "q string, t string, distance double, size int, same boolean"
    f = spark.createDataFrame([("a", "x", 1.0, 9, True), ("b", "y", 1.0, 9, False), ("c", "y", 3.0, 7, True), ("z", "gone", 1.0, 1, True)], shape)
    b = spark.createDataFrame([("x", "b", 1.0, 5, True), ("y", "b", 2.0, 6, False)], shape)
    got = {r["start"]: tuple(r)[1:] for r in knn.loops(f, b).collect()}
    assert got == {"a": (4, 1.25, 5, 2), "b": (2, 1.5, 6, 0), "c": (3, 2.0, 6, 1)}
    # y comes again on the third step, before an origin venue does
    b = spark.createDataFrame([("y", "b", 2.0, 6, True)], shape)
    assert {r["start"]: r["steps"] for r in knn.loops(f.where("q <> 'a'"), b).collect()} == {"b": 2, "c": 3}


def brute_transport(cost, fraction, parts):
    """All ways to move unit pieces of equal masses."""
    n, m = cost.shape
    units_r, units_c = np.repeat(np.arange(n), parts // n), np.repeat(np.arange(m), parts // m)
    k = round(fraction * parts)
    best = math.inf
    for rows in set(itertools.combinations(units_r, k)):
        for cols in set(itertools.permutations(units_c, k)):
            best = min(best, sum(cost[i, j] for i, j in zip(rows, cols)) / k)
    return best


@pytest.mark.parametrize("fraction", [1.0, 0.5])
def test_transport_as_brute_force(fraction):
    rng = np.random.default_rng(2)
    for n, m in ((2, 3), (3, 2), (2, 2), (6, 3), (1, 6)):
        cost = rng.random((n, m))
        parts = 6
        got = transport.moved(cost, np.ones(n), np.ones(m), fraction)
        assert got == pytest.approx(brute_transport(cost, fraction, parts))


def test_transport_of_many_venues():
    """A region against as many venues as a hull holds in larger tables: on a line the cost is the area between the shares."""
    rng = np.random.default_rng(12)
    began = time.process_time()
    for decimals, equal in ((6, True), (1, True), (6, False)):
        a, b = np.round(rng.random(150), decimals), np.round(rng.random(600) * 2, decimals)
        wa, wb = (np.ones(150), np.ones(600)) if equal else (rng.random(150) + 1e-6, rng.random(600) + 1e-6)
        at = np.sort(np.concatenate([a, b]))
        share = lambda x, w: np.array([w[x <= p].sum() for p in at[:-1]]) / w.sum()
        want = (np.abs(share(a, wa) - share(b, wb)) * np.diff(at)).sum()
        assert transport.moved(np.abs(a[:, None] - b), wa, wb) == pytest.approx(want, abs=1e-9)
    x, y = rng.normal(size=(150, 30)), rng.normal(size=(600, 30))
    cost = transport.euclidean(x, y)
    assert cost == pytest.approx(np.sqrt(((x[:, None] - y[None]) ** 2).sum(2)))
    u, v = transport.near_prices(cost, np.full(150, 1 / 150), np.full(600, 1 / 600))
    far = transport.moved(cost, np.ones(150), np.ones(600))
    assert (u[:, None] + v <= cost + 1e-9).all() and u.mean() + v.mean() <= far <= 1.01 * (u.mean() + v.mean())
    assert time.process_time() - began < 10


def test_transport_laws():
    rng = np.random.default_rng(3)
    x, y = rng.random((12, 4)), rng.random((9, 4))
    wx, wy = rng.random(12) + 0.1, rng.random(9) + 0.1
    c = transport.euclidean(x, y)
    assert transport.moved(c, wx, wy) == pytest.approx(transport.moved(c.T, wy, wx))
    assert transport.moved(transport.euclidean(x, x), wx, wx) == pytest.approx(0)
    assert transport.moved(c, wx, wy, 0.8) <= transport.moved(c, wx, wy) + 1e-12
    a, b = np.sort(rng.random(8)), np.sort(rng.random(8))
    assert transport.moved(np.abs(a[:, None] - b), np.ones(8), np.ones(8)) == pytest.approx(np.abs(a - b).mean())
    inv = np.diag([4.0, 1.0, 1.0, 1.0])
    assert transport.mahalanobis(inv)(x, y) == pytest.approx(transport.euclidean(x, y, np.array([4.0, 1, 1, 1])))
    assert transport.best_assignment(np.array([[1.0, 9], [9, 1]])) == 1.0


def test_components_as_union_find(spark):
    rng = random.Random(4)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    parent = list(range(60))

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = graph.components(spark.range(60).withColumnRenamed("id", "node"), spark.createDataFrame(links, "a bigint, b bigint"))
    assert {r["node"]: r["label"] for r in got.collect()} == {v: root(v) for v in range(60)}


def test_density_clusters_as_local_dbscan(spark):
    rng = np.random.default_rng(5)
    pts = np.concatenate([rng.normal([0, 0], 40, (30, 2)), rng.normal([900, 0], 40, (25, 2)), rng.uniform(-2000, 2000, (15, 2))])
    rows = [(float(x) / 111_195, float(y) / 111_195) for x, y in pts]
    got = regions.density_clusters(spark.createDataFrame(rows + [(None, 1.0)], "lng double, lat double"), 100.0, 5).collect()
    lab = regions.local_dbscan(pts, 100.0, 5)
    core = np.array([(((pts - p) ** 2).sum(1) <= 1e4).sum() >= 5 for p in pts])
    where = {r: i for i, r in enumerate(rows)}
    names = {}
    for r in got:
        i = where[(r["lng"], r["lat"])]
        assert r["core"] == core[i] and (r["cluster"] is None) == (lab[i] < 0)
        if core[i]:
            assert names.setdefault(lab[i], r["cluster"]) == r["cluster"]
    assert len(got) == len(rows)


def test_local_dbscan_without_kept_neighbours():
    rng = np.random.default_rng(13)
    for k in range(20):
        xy = np.round(rng.normal(size=(60, 2)) * 10)
        xy[::17] = np.nan
        near = ((xy[:, None] - xy[None]) ** 2).sum(2) <= 9
        core, want, n = near.sum(1) >= 3, np.full(60, -1), 0
        for i in range(60):
            if core[i] and want[i] < 0:
                part = np.arange(60) == i
                while (more := part | near[part & core].any(0)).sum() > part.sum():
                    part = more
                want[part & (want < 0)] = n
                n += 1
        assert regions.local_dbscan(xy, 3.0, 3).tolist() == want.tolist()
    crowd = rng.random((5_000, 2)) * 100
    tracemalloc.start()
    lab = regions.local_dbscan(crowd, 250.0, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (lab == 0).all() and peak < 100e6


def test_scan_as_brute_force(spark):
    rng = np.random.default_rng(6)
    m, b = rng.integers(0, 5, (8, 8)), rng.integers(1, 6, (8, 8))
    m[2:4, 5:7] += 30
    df = spark.createDataFrame([("c", i, j, int(m[i, j]), int(b[i, j])) for i in range(8) for j in range(8)], "city string, ix int, iy int, m bigint, b bigint")
    got = scan.rectangles(df, ["city"], 8, 3, 5, 20, stripes=2).orderBy("rank").collect()
    every = []
    for x0, y0 in itertools.product(range(8), repeat=2):
        for w, h in itertools.product(range(1, 4), repeat=2):
            if x0 + w <= 8 and y0 + h <= 8:
                mm, bb = m[x0 : x0 + w, y0 : y0 + h].sum(), b[x0 : x0 + w, y0 : y0 + h].sum()
                pm, pb = mm / m.sum(), bb / b.sum()
                if mm >= 5 and bb >= 5 and pm > pb:
                    v = round(pm * math.log(pm / pb) + (1 - pm) * math.log((1 - pm) / (1 - pb)), 9)
                    every.append((-v, x0, y0, x0 + w - 1, y0 + h - 1))
    assert np.array([(-r["value"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in got]) == pytest.approx(np.array(sorted(every)[:20], float))
    assert (got[0]["x0"], got[0]["x1"], got[0]["y0"], got[0]["y1"]) == (2, 3, 5, 6)
    merged = scan.merge(scan.rectangles(df, ["city"], 8, 3, 5, 20), ["city"], 8).orderBy("region_no").collect()
    assert merged[0]["parts"] == 3 and {(2, 5), (3, 6)} <= {(c["x"], c["y"]) for c in merged[0]["cells"]}
    assert scan.tags_of_area(scan.merge(scan.rectangles(df, ["city"], 8, 3, 5, 20), ["city"], 8), "city", [(2, 5), (3, 6)]).count() == 1


def test_hulls_and_growth():
    ring = regions.hull(np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1], [1, 0]], float))
    assert len(ring) == 4
    assert regions.hull_distance(ring, np.array([[1, 1], [3, 1], [3, 3], [-1, 0]], float)) == pytest.approx([0, 1, math.sqrt(2), 1])
    xy = np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1], [2.5, 1], [9, 9]], float)
    nested = [set(x.tolist()) for x in regions.grown(xy[:4], xy)]
    assert nested[0] == {0, 1, 2, 3, 4} and all(a < b for a, b in zip(nested, nested[1:])) and 6 not in nested[-1]


def test_quality(spark):
    from pyspark.sql import functions as F

    assert regions.cluster_f1(np.array([0, 0, 1, -1]), [1, 2, 3, 4], [{1, 2}]) == pytest.approx(0.5)
    assert regions.cluster_f1(np.array([], dtype=int), [], [{1}]) == 0.0
    df = spark.createDataFrame([(1.0, 1), (0.5, 2), (0.0, 3), (0.0, 4), (0.0, 5)], "rel double, rank int")
    got = df.agg(regions.square_dcg(F.col("rel"), F.col("rank")).alias("x")).first()["x"]
    lowest = sum(1 / math.log2(i + 1) for i in range(1, 6))
    assert got + lowest == pytest.approx(1 + 0.25 / math.log2(3))
    xy = np.random.default_rng(7).uniform(0, 3000, (200, 2))
    assert regions.random_baseline(xy, [set(range(20))], draws=3) == regions.random_baseline(xy, [set(range(20))], draws=3)


def test_disjoint_circles(spark):
    rows = [("c", "a", 0.0, 0.0, 100.0, 1.0), ("c", "b", 259.0, 0.0, 100.0, 2.0), ("c", "d", 260.0, 0.0, 100.0, 2.0), ("c", "e", 0.0, 900.0, 100.0, 9.0)]
    df = spark.createDataFrame(rows, "city string, key string, x double, y double, radius double, distance double")
    assert [r["key"] for r in regions.disjoint_circles(df, ["city"]).orderBy("rank").collect()] == ["a", "d", "e"]
