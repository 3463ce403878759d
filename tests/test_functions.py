"""Exact values of the small functions, each on one-row frames."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from waymark.functions import clock, geo, nested, stats, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def at(s):
    return F.lit(s).cast("timestamp_ntz")


@pytest.mark.parametrize("t, want", [
    ("2014-03-10 08:00:00", 0), ("2014-03-10 14:00:00", 1), ("2014-03-10 22:00:00", 2), ("2014-03-11 02:00:00", 2),
    ("2014-03-11 06:00:00", 3), ("2014-03-17 02:00:00", 20),
])
def test_human_period(spark, t, want):
    assert one(spark, clock.human_period(at(t))) == want


def test_clock(spark):
    assert one(spark, clock.epoch_us(at("2008-03-09 02:30:00.25"))) == 1205029800250000
    assert one(spark, clock.epoch_us(at("1969-12-31 23:59:59.5"))) == -500000
    assert one(spark, clock.hour_chunk(at("2014-01-01 00:30:00"), 4, 1)) == 5
    assert [one(spark, clock.weekend(at(t))) for t in ("2014-03-14 19:59:00", "2014-03-14 20:00:00", "2014-03-16 20:59:00", "2014-03-16 21:00:00")] == [False, True, True, False]
    assert one(spark, clock.time_cell(at("2008-01-14 23:59:59"))) == 1 and one(spark, clock.time_cell(at("2008-01-15 00:00:00"))) == 2
    assert one(spark, clock.in_season(at("2009-10-01 00:00:00"), "fall", 2009, 2009)) and not one(spark, clock.in_season(at("2009-12-15 00:00:00"), "fall", 2009, 2009))
    assert one(spark, clock.in_season(at("2010-02-01 00:00:00"), "winter", 2009, 2009))
    assert one(spark, clock.period_slice(at("2008-01-01 00:00:00"), "2008-01-02", 1)) is None
    with pytest.raises(ValueError):
        clock.hour_chunk(F.lit(None), 5)


def test_city_time(spark):
    zone = F.lit("America/New_York")
    for utc, local in (("2009-07-25 12:45:00", "2009-07-25 08:45:00"), ("2009-02-25 12:45:00", "2009-02-25 07:45:00")):
        assert one(spark, clock.to_city_time(at(utc), zone)) == datetime.fromisoformat(local)
        assert one(spark, clock.to_utc(at(local), zone)) == datetime.fromisoformat(utc)


def test_projection(spark):
    e, n = geo.local_xy(F.lit(60.15), F.lit(24.91), F.lit(60.19415), F.lit(24.92945))
    assert one(spark, e) == pytest.approx(-1080.3931874725, abs=1e-6) and one(spark, n) == pytest.approx(-4918.8217761851, abs=1e-6)
    la, lo = geo.local_to_geo(e, n, F.lit(60.19415), F.lit(24.92945))
    assert one(spark, la) == pytest.approx(60.15, abs=2e-5) and one(spark, lo) == pytest.approx(24.91, abs=1e-5)
    assert one(spark, geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(180.0), F.lit(0.0))) == pytest.approx(20015114.35, abs=1)


def test_boxes_and_grids(spark):
    assert geo.quarters(((0, 0), (20, 22))) == [((0, 0), (10, 11)), ((0, 11), (10, 22)), ((10, 0), (20, 11)), ((10, 11), (20, 22))]
    assert geo.box_ring((37, -122, 35, -120)) == [(-122, 37), (-120, 37), (-120, 35), (-122, 35), (-122, 37)]

    def cell(lat, lng):
        return tuple(one(spark, c) for c in geo.grid_cell(F.lit(lat), F.lit(lng), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0), 4))

    assert cell(0.0, 0.0) == (0, 0) and cell(1.0, 1.0) == (3, 3) and cell(0.3, 0.8) == (3, 1) and cell(1.01, 0.5) == (None, None)
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2))])
    assert [one(spark, geo.convex_contains(ring, F.lit(x), F.lit(1.0))) for x in (1.0, 2.0, 3.0)] == [True, False, False]
    assert one(spark, geo.css_hex(F.lit(1.0), F.lit(0.0), F.lit(1.0))) == "#ff00ff"
    corners = one(spark, geo.circle_ring(F.lit(48.0), F.lit(2.0), F.lit(100.0)))
    far = [one(spark, geo.haversine_m(F.lit(2.0), F.lit(48.0), F.lit(p["lng"]), F.lit(p["lat"]))) for p in corners[:3]]
    assert len(corners) == 16 and far == pytest.approx([100.0] * 3, rel=5e-3)


def test_texts(spark):
    for t, title, tags in (
        ("Carnitas Crispy Taco with guac #foodporn #tacosrule", "Carnitas Crispy Taco with guac", ["foodporn", "tacosrule"]),
        ("#foodporn #tacosrule", "", ["foodporn", "tacosrule"]), ("no tags", "no tags", []), ("a #b c", "a #b c", []), ("", "", []),
    ):
        got = one(spark, text.title_parts(F.lit(t)))
        assert (got["title"], got["tags"]) == (title, tags)
    got = one(spark, text.machine_tags(F.lit("square {site}:{venue}=4bd1fa4d uploaded:by=x"), "site"))
    assert got["tags"] == ["square"] and got["venue"] == "4bd1fa4d"
    assert one(spark, text.bare_tag(F.lit(" New-York's \\ Best! "))) == "newyorksbest" and one(spark, text.bare_tag(F.lit("!?"))) is None
    assert one(spark, text.letters(F.lit("San_Torvo 9"))) == "santorvo" and one(spark, text.letters(F.lit("42"))) is None
    assert one(spark, text.folded(F.lit(" \tAb "))) == "ab" and one(spark, text.folded(F.lit("  "))) is None
    assert one(spark, text.trailing_url(F.lit("I'm here http://a.bc/x1"))) == "http://a.bc/x1"
    assert one(spark, text.trailing_url(F.lit("see http://b.ad/x"), ["b.ad"])) is None and one(spark, text.trailing_url(F.lit("no link"))) is None
    assert one(spark, text.last_path_part(F.lit("http://h/v/name/4bd1"))) == "4bd1"
    got = one(spark, text.id_and_signature(F.lit("https://h/u/checkin/4bd1ab?s=Xy_z&ref=tw")))
    assert (got["id"], got["signature"]) == ("4bd1ab", "Xy_z")
    assert one(spark, text.photo_url("img.example", F.lit(4), F.lit("24"), F.lit(7), F.lit("ab"))) == "https://farm4.img.example/24/7_ab_z.jpg"
    assert one(spark, text.synthetic_id(F.lit("a"), F.lit(1))) == one(spark, text.synthetic_id(F.lit("a"), F.lit(1)))


def test_nested(spark):
    j = F.lit('{"loc":{"type":"city"},"l":{"t":null},"likes":{"count":2,"groups":[{"type":"others","items":[{"id":"5"},{"id":"6"}]},{"type":"friends","items":[{"id":"7"}]}]}}')
    assert one(spark, nested.nested(j, ["loc", "type"])) == "city" and one(spark, nested.nested(j, ["no"])) is None
    assert one(spark, nested.nested(j, ["l", "t", "a"], "0")) == "0" and one(spark, nested.nested(F.lit("broken"), ["a"])) is None
    assert one(spark, nested.count_of(j, "likes")) == 2 and one(spark, nested.count_of(j, "tips")) == 0
    assert one(spark, nested.other_ids(j, "likes")) == [5, 6] and one(spark, nested.other_ids(j, "tips")) == []
    assert one(spark, nested.padded(F.array(F.lit(1.0)), 3, F.lit(0.0))) == [1.0, 0.0, 0.0]
    rows = spark.createDataFrame([(1, 2), (3, 4)], "a int, b int")
    assert [tuple(r["row"]) for r in nested.columns_of(rows, ["a", "b"]).collect()] == [(1, 2), (3, 4)]
    assert rows.agg(nested.as_map(F.col("a"), F.col("b")).alias("m")).first()["m"] == {1: 2, 3: 4}


def test_statistics(spark):
    import math

    df = spark.createDataFrame([("a", 5), ("a", 5), ("b", 7), ("z", 0)], "k string, c int")
    got = {r["k"]: r["e"] for r in df.groupBy("k").agg(stats.entropy(F.col("c")).alias("e")).collect()}
    assert got["a"] == pytest.approx(math.log(2)) and got["b"] == pytest.approx(0) and got["z"] is None
    two = spark.createDataFrame([(0.5, 1.0), (0.5, 0.0)], "p double, q double")
    js = two.agg(stats.jensen_shannon(F.col("p"), F.col("q")).alias("x"), stats.jensen_shannon(F.col("p"), F.col("p")).alias("o")).first()
    assert 0 < js["x"] < math.log(2) and js["o"] == pytest.approx(0)
    t = spark.createDataFrame([(3, 3), (1, 1), (0, 6)], "t int, b int")
    kl = t.agg(stats.kl_divergence(F.col("t"), F.col("b"), F.lit(10)).alias("x")).first()["x"]
    assert kl == pytest.approx(0.75 * math.log(0.75 / 0.3) + 0.25 * math.log(0.25 / 0.1))
    assert one(spark, stats.f_score(F.lit(0.0), F.lit(0.0))) == 0.0 and one(spark, stats.f_score(F.lit(0.5), F.lit(0.5))) == pytest.approx(0.5)
    a, b = F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))
    empty = F.array().cast("array<int>")
    assert one(spark, stats.jaccard(a, b)) == pytest.approx(1 / 3) and one(spark, stats.jaccard(empty, empty)) == 1.0
    assert one(spark, stats.discrepancy(F.lit(10), F.lit(10), F.lit(100), F.lit(1000), 11)) is None
    assert one(spark, stats.discrepancy(F.lit(10), F.lit(10), F.lit(100), F.lit(1000), 10)) == pytest.approx(0.1 * math.log(10) + 0.9 * math.log(0.9 / 0.99))
