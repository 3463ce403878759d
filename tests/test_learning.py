import itertools
import math

import numpy as np
import pytest

from waymark.functions import geo
from waymark.operators import learning, regions, transport
from waymark.sources.paged import RateLimit


def test_bounded_weights_keep_their_limits_and_beat_random_ones():
    rng = np.random.default_rng(1)
    rows = rng.random((40, 8)) * np.linspace(0.1, 3, 8)
    w = learning.bounded_weights(rows, 16.0)
    scale = 16.0 / w.sum()
    assert np.linalg.norm(w) == pytest.approx(1) and (w[:-1] >= w[1:] - 1e-9).all()
    assert (w * scale >= 2 / 3 - 1e-6).all() and (w * scale <= 6 + 1e-6).all()
    best = np.linalg.norm(rows @ (w * scale))
    for _ in range(300):
        other = learning._into_limits(rng.uniform(2 / 3, 6, 8), 2 / 3, 6.0, 16.0)
        other *= 16.0 / other.sum()
        if (other >= 2 / 3 - 1e-9).all() and (other <= 6 + 1e-9).all():
            assert best <= np.linalg.norm(rows @ other) + 1e-6


def test_rank_weights_order_the_rows():
    rng = np.random.default_rng(2)
    truth = np.array([3.0, -1.0, 0.5, 0.0])
    rows, query = rng.normal(size=(60, 4)), np.repeat(np.arange(6), 10)
    relevance = np.digitize(rows @ truth, [-1, 0, 1])
    w = learning.rank_weights(rows, relevance, query, 1_000.0)
    right = [(rows[i] - rows[j]) @ w > 0 for i, j in itertools.permutations(range(60), 2) if query[i] == query[j] and relevance[i] > relevance[j]]
    assert np.mean(right) > 0.97 and np.linalg.norm(w) == pytest.approx(1)
    assert learning.rank_weights(rows, np.zeros(60), query) == pytest.approx([0.5] * 4)
    out = learning.leave_one_out(lambda keep: learning.rank_weights(rows[keep], relevance[keep], query[keep]), 6, lambda k: query == k, rows)
    assert len(out) == 6 and all(len(w) == 4 for w, _, _ in out)


def cloud(rng, n):
    part = np.repeat([0, 1], n)
    return np.vstack([rng.normal(part[None] * 4.0, 0.3, (2, 2 * n)), np.ones(2 * n)]), part


def test_affine_fit_undoes_a_transform():
    rng = np.random.default_rng(3)
    fixed, a = cloud(rng, 25)
    moving, b = cloud(rng, 30)
    turned = np.linalg.inv(np.array([[0.8, -0.6, 2.0], [0.6, 0.8, -1.0], [0, 0, 1]])) @ moving
    before = learning.alignment_cost(np.eye(3), fixed, turned, a, b)
    transform, cost = learning.affine_fit(fixed, turned, a, b)
    assert cost < before and cost < learning.alignment_cost(np.eye(3), fixed, moving, a, b) + 0.05
    assert cost == pytest.approx(learning.alignment_cost(transform, fixed, turned, a, b))
    assert np.diag(learning.extent(np.array([[0, 2.0], [1, 4.0], [1, 1]]))) == pytest.approx([2, 3, 1])


def test_hessian_as_differences():
    rng = np.random.default_rng(4)
    fixed, a = cloud(rng, 4)
    moving, b = cloud(rng, 5)
    at, h, eps = np.array([[1.1, 0.2, 0.3], [-0.1, 0.9, 0.5], [0, 0, 1.0]]), None, 1e-4

    def cost(step):
        t = at.copy()
        t[:2] += step.reshape(2, 3)
        return learning.alignment_cost(t, fixed, moving, a, b)

    h = learning.alignment_hessian(at, fixed, moving, a, b)
    unit = np.eye(6) * eps
    for i, j in ((0, 0), (1, 4), (2, 5), (3, 3), (0, 5)):
        got = (cost(unit[i] + unit[j]) - cost(unit[i] - unit[j]) - cost(unit[j] - unit[i]) + cost(-unit[i] - unit[j])) / (4 * eps**2)
        assert h[i, j] == pytest.approx(got, abs=1e-3)


def test_mixture_has_its_parts(spark):
    rows = learning.mixture(spark, 3_000, [[0, 0], [5, 5], [-5, 5]]).collect()
    for part, centre in enumerate([[0, 0], [5, 5], [-5, 5]]):
        own = np.array([r["v"] for r in rows if r["part"] == part])
        assert 850 < len(own) < 1_150 and own.mean(0) == pytest.approx(centre, abs=0.1) and own.std(0) == pytest.approx([0.3, 0.3], abs=0.05)


def test_greedy_choice_as_brute_force(spark):
    rng, bins, dims = np.random.default_rng(5), 4, 3
    rows = {f"v{i:02d}": [k * bins + int(rng.integers(bins)) for k in range(dims)] for i in range(20)}
    want = {0: 3, 1: 1, 4: 2, 6: 2, 9: 4}

    def distance(names):
        total = 0.0
        for k in range(dims):
            p = np.bincount([rows[n][k] - k * bins for n in names], minlength=bins) / len(names)
            q = np.array([want.get(k * bins + b, 0) for b in range(bins)]) / 4
            h = [-sum(x * math.log(x) for x in v if x > 0) for v in (p, q, (p + q) / 2)]
            total += h[2] - (h[0] + h[1]) / 2
        return round(total, 9)

    chosen: list = []
    for _ in range(5):
        chosen.append(min((n for n in rows if n not in chosen), key=lambda n: (distance([*chosen, n]), n)))
    df = spark.createDataFrame(list(rows.items()), "venue string, bins array<int>")
    got = [(r["venue"], r["distance"]) for r in regions.greedy_choice(df, want, 5, bins).orderBy("step").collect()]
    assert [n for n, _ in got] == chosen and got[-1][1] == pytest.approx(distance(chosen), abs=1e-8)
    assert len({r[0] for r in regions.greedy_choice(df, want, 3, bins, share=0.5).collect()}) == 3
    assert regions.greedy_choice(df.limit(0), want, 3, bins).count() == 0


def test_region_distances_by_name():
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(12, 4)), rng.normal(size=(9, 4)) + 0.5
    found = {m: transport.region_distance(m, x, y) for m in transport.METRICS}
    assert all(v > 0 for v in found.values()) and found["partial"] <= found["emd"] + 1e-9
    assert all(transport.region_distance(m, x, x) == pytest.approx(0, abs=1e-9) for m in transport.METRICS)
    assert transport.region_distance("jsd", x, y, theta=np.full(4, 2.0)) == pytest.approx(2 * found["jsd"])
    with pytest.raises(ValueError):
        transport.region_distance("other", x, y)


def test_shapes_that_share_points_are_joined(spark):
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    rings = {"a": square(0.0, 0.0, 2.0), "b": square(1.0, 1.0, 2.0), "c": square(2.5, 2.5, 2.0), "far": square(10.0, 10.0, 1.0), "empty": square(20.0, 20.0, 1.0)}
    shapes = spark.createDataFrame(list(rings.items()), "region string, ring array<struct<lng:double,lat:double>>")
    points = spark.createDataFrame([("p", 1.5, 1.5), ("q", 2.8, 2.8), ("r", 4.0, 4.0), ("s", 10.5, 10.5), ("out", 50.0, 50.0)], "key string, lng double, lat double")
    got = {r["part"]: (r["shapes"], r["points"]) for r in regions.joined_shapes(shapes, points).collect()}
    assert got == {"a": (3, 3), "far": (1, 1)}


def test_surface_keeps_the_values_of_its_circles(spark):
    rows = [("c", float(x), float(y), float(x + y)) for x in range(5) for y in range(5)]
    df = spark.createDataFrame(rows, "city string, x double, y double, distance double")
    got = {(r["ix"], r["iy"]): r["distance"] for r in regions.distance_surface(df, ["city"], 5).collect()}
    assert len(got) == 25 and all(got[x, y] == pytest.approx(x + y, abs=0.01) for x in range(5) for y in range(5))


def test_baseline_keeps_its_gate():
    rng = np.random.default_rng(7)
    for _ in range(20):
        ring = regions.random_hexagon(rng, 0.0, 0.0)
        assert 150 <= np.sqrt((ring**2).sum(1)).max() <= 600
    xy = rng.uniform(0, 3000, (1500, 2))
    gains = regions.random_baseline(xy, [set(range(60))], draws=3)
    assert len(gains) == 3 and regions.random_baseline(xy, [set(range(60))], draws=3, least=1_500) == [0.0] * 3
    weights = np.zeros(10)
    weights[3] = 1
    assert {regions.weighted_index(rng, weights) for _ in range(20)} == {3}


def test_rate_limit_waits_for_the_window():
    now = [0.0]
    limit = RateLimit(3, 10.0, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    waits = []
    for _ in range(7):
        waits.append(limit.wait())
        now[0] += 1
    assert waits == [0, 0, 0, 7, 0, 0, 7] and limit.left() == 1


def test_geodesic_lengths(spark):
    from pyspark.sql import functions as F

    # One degree of a meridian at the equator and at the pole, and of the equator, on the ellipsoid.
    rows = [(0.0, -0.5, 0.0, 0.5, 110_574.3), (0.0, 89.0, 0.0, 90.0, 111_693.9), (0.0, 0.0, 1.0, 0.0, 111_319.5), (5.0, 5.0, 5.0, 5.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, want double")
    for r in df.select("want", geo.geodesic_m(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("got")).collect():
        assert r["got"] == pytest.approx(r["want"], rel=3e-5)
