import datetime

from waymark.operators import scan
from waymark.plans import spatial


def test_support_follows_the_total(spark):
    rows = [("a", 0, 0, 30, 60)] + [("a", x, y, 9, 30) for x in range(8) for y in range(8) if x + y]
    rows += [("b", 0, 0, 30, 60), ("b", 7, 7, 30, 600)]
    df = spark.createDataFrame(rows, "tag string, ix int, iy int, m bigint, b bigint")
    got = scan.rectangles(df, ["tag"], 8, 2, None, 500).collect()
    assert min(r["m"] for r in got if r["tag"] == "a") >= scan.support_of(30 + 63 * 9) == 40
    assert min(r["m"] for r in got if r["tag"] == "b") == 30


def test_tag_queries_use_the_fine_grid(spark, tmp_path):
    spark.createDataFrame([("vellmare", 0.0, 0.0, 80.0, 80.0)], "city string, lat_bl double, lng_bl double, lat_ur double, lng_ur double").write.parquet(f"{tmp_path}/city_box.parquet")
    spots = [(2.5, 2.5, "corner")] * 100 + [(x + 0.5, y + 0.5, "middle") for x in range(31, 49) for y in range(31, 49)] + [(x + 0.5, y + 0.5, "all") for x in range(80) for y in range(80)]
    rows = [(f"p{i}", "vellmare", [t], "u", datetime.datetime(2020, 1, 1), (x, y)) for i, (x, y, t) in enumerate(spots)]
    spark.createDataFrame(rows, "_id string, hint string, tags array<string>, uid string, taken timestamp, loc struct<lng:double,lat:double>").write.parquet(f"{tmp_path}/photos.parquet")
    best = {r["tag"]: [r[c] for c in ("x0", "x1", "y0", "y1", "m")] for r in spatial.tag_scan_best(spark, str(tmp_path)).collect()}
    assert best["corner"] == [2, 2, 2, 2, 100] and best["middle"] == [31, 48, 31, 48, 324]
    assert [r["tag"] for r in spatial.tags_of_centre(spark, str(tmp_path)).collect()] == ["middle"]
