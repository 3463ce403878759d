import math
import random

import numpy as np
import pytest

from waymark.operators import proximity
from waymark.operators.proximity import great_circle_m, inside_ring, near_counts, near_rows, near_spots, points_in_regions

SCHEMA = "k string, lng double, lat double, a string, metres string, _cell string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def brute(rows, radius):
    rows = sorted({r for r in rows if None not in r and abs(r[1]) <= 180 and abs(r[2]) <= 90})
    out = set()
    for i, p in enumerate(rows):
        for q in rows[i + 1:]:
            if p[0] != q[0] and great_circle_m(*(np.array([v]) for v in (p[1], p[2], q[1], q[2])))[0] <= radius:
                out.add((min(p[0], q[0]), max(p[0], q[0])))
    return out


@pytest.mark.parametrize("per_cell", [5, 50_000])
def test_near_rows_as_brute_force(spark, per_cell):
    rng = random.Random(4)
    rows = [(f"r{i}", round(10 + rng.gauss(0, 0.0004), 6), round(50 + rng.gauss(0, 0.0004), 6)) for i in range(150)]
    rows += [(f"hot{i}", 10.0, 50.0) for i in range(40)] + [("hot1", 10.0, 50.0), ("hot2", 10.0001, 50.0)]
    rows += [("n", None, 50.0), ("m", 10.0, None), ("off", 999.0, 50.0), ("nan", float("nan"), 50.0), (None, 10.0, 50.0)]
    got = [(r["a"], r["b"]) for r in near_rows(frame(spark, rows), "k", 20.0, per_cell).collect()]
    assert len(got) == len(set(got)) and set(got) == brute([r for r in rows if r[1] is None or not math.isnan(r[1])], 20.0)
    single = [r for r in rows if r[2:] != (50.0,) or r[0] not in ("hot1", "hot2")]
    want = {}
    for a, b in brute([r for r in single if r[1] is None or not math.isnan(r[1])], 20.0):
        want[a], want[b] = want.get(a, 0) + 1, want.get(b, 0) + 1
    assert {r["k"]: r["neighbours"] for r in near_counts(frame(spark, single), "k", 20.0, per_cell).collect()} == want


def test_antimeridian_and_pole(spark):
    rows = [("a", 179.99999, 0.0), ("b", -179.99999, 0.0), ("c", 0.0, 89.999999), ("d", 180.0, 89.999999), ("e", 0.0, 0.0)]
    assert {(r["a"], r["b"]) for r in near_rows(frame(spark, rows), "k", 5.0).collect()} == {("a", "b"), ("c", "d")}


def test_spots_once(spark):
    rows = [("a", 1.0, 1.0), ("b", 1.0, 1.0), ("c", 1.00001, 1.0)]
    assert near_spots(frame(spark, rows), 5.0).count() == 1


def test_empty(spark):
    assert near_rows(frame(spark, []), "k", 5.0).count() == 0


def square(x, y, s):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]


def test_grid_follows_the_points(spark):
    rng = random.Random(6)
    rows = [(f"r{i}", rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(2000)] + [(f"h{i}", 5.0, 5.0) for i in range(500)]
    grid = proximity.build_grid(frame(spark, rows).select("lng", "lat"), 50)
    sizes = [r["count"] for r in proximity._cells_of_points(frame(spark, rows), grid, "k").groupBy("_cell").count().collect()]
    assert max(sizes) <= 150 and sum(sizes) == 2500


@pytest.mark.parametrize("tiles", [50, 1_000_000])
def test_regions_as_brute_force(spark, monkeypatch, tiles):
    monkeypatch.setattr(proximity, "TILES", tiles)
    rng = random.Random(5)
    rings = {
        "sq": square(0, 0, 1), "rev": square(0.5, 0.5, 1)[::-1], "closed": square(-1, -1, 3) + [(-1, -1)],
        "concave": [(0, 0), (2, 0), (2, 2), (1, 0.5), (0, 2)], "line": [(0, 0), (1, 1)], "none": [],
    }
    points = [(f"p{i}", rng.uniform(-1.5, 2.5), rng.uniform(-1.5, 2.5)) for i in range(300)] + [("hot", 0.7, 0.6)] * 60
    points += [("n", None, 0.5), (None, 0.7, 0.6)]
    df = frame(spark, points).select("k", "lng", "lat")
    regions = spark.createDataFrame(
        [(k, [(float(x), float(y)) for x, y in v]) for k, v in rings.items()] + [("null", None)], "region string, ring array<struct<lng:double,lat:double>>"
    )
    got = sorted(((r["k"] or ""), r["region"]) for r in points_in_regions(df, regions, per_cell=20).collect())
    want = []
    for k, x, y in points:
        for name, ring in rings.items():
            if x is not None and len(ring) > 2 and inside_ring(np.array([x]), np.array([y]), np.array(ring, float))[0]:
                want.append((k or "", name))
    assert got == sorted(want) and ("hot", "sq") in got


def test_regions_empty(spark):
    regions = spark.createDataFrame([], "region string, ring array<struct<lng:double,lat:double>>")
    assert points_in_regions(frame(spark, [("a", 1.0, 1.0)]).select("k", "lng", "lat"), regions).count() == 0
    assert points_in_regions(frame(spark, []).select("k", "lng", "lat"), regions).count() == 0
