import json
import sys
from datetime import datetime

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from waymark.operators import grids, models, profiles, proximity
from waymark.operators import records as rec
from waymark.sinks import writers
from waymark.sources import paged, parse, readers
from waymark.streaming import ingest


def test_records(spark):
    rows = spark.createDataFrame([("a", "9", "x"), ("a", "10", "y"), ("a", None, "z"), ("b", None, "w"), (None, "1", "v"), ("c", "bad", "u")], "_id string, tid string, w string")
    got = {r["_id"]: r["tid"] for r in rec.earliest(rows, "_id", F.expr("try_cast(tid as decimal(38,0))")).collect()}
    assert got == {"a": "9", "b": None, "c": "bad"}
    a = spark.createDataFrame([(x,) for x in "abbb"], "k string")
    b = spark.createDataFrame([(x,) for x in "bcc"], "k string")
    bag = {r["k"]: (r["sum"], r["minus"], r["either"], r["both"]) for r in rec.multiset(a, b, "k").collect()}
    assert bag == {"a": (1, 1, 1, 0), "b": (4, 2, 3, 1), "c": (2, 0, 2, 0)}
    counts = spark.createDataFrame([("a", 2), ("b", 0)], "k string, n int")
    assert [r["k"] for r in rec.elements(counts, "k", "n").collect()] == ["a", "a"]
    pairs = spark.createDataFrame([("v1", "p1"), ("v2", "p2"), ("v2", "p2"), ("v3", "p3"), ("v4", "p3"), (None, "p9"), ("v5", None)], "lid string, place string")
    assert [tuple(r) for r in rec.one_to_one(pairs, "lid", "place").select("lid", "place").collect()] == [("v1", "p1")]
    order = spark.createDataFrame([(x,) for x in "abcdefghij"], "k string")
    assert [r["count"] for r in rec.chunks_of(order, ["k"], 3).groupBy("chunk").count().orderBy("chunk").collect()] == [3, 3, 3, 1]
    known = spark.createDataFrame([("a",)], "k string")
    assert {r["k"] for r in rec.new_rows(a.union(spark.createDataFrame([(None,)], "k string")), "k", known).collect()} == {"b"}


def test_last_known_over_chunks(spark):
    t = [datetime(2014, 1, 1 + i // 3, i) for i in range(8)]
    rows = [("u", str(i), t[i], {0: "a", 4: "b"}.get(i)) for i in range(8)] + [("v", "x", t[0], None), (None, "y", t[0], "q")]
    df = spark.createDataFrame(rows, "uid string, id string, t timestamp_ntz, lid string")
    got = {r["id"]: r["known"] for r in rec.last_known(df, "uid", "t", "id", "lid", F.to_date("t")).collect()}
    assert got == {**{str(i): "a" if i < 4 else "b" for i in range(8)}, "x": None}


def test_readers(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("1\tt1\t48.1\t2.1\td\thello\tp\nbad line\n2\tt2\tx\t2.1\td\th\tp\n")
    assert [r["tid"] for r in readers.checkin_lines(spark, str(tmp_path / "c.tsv")).collect()] == ["t1"]
    (tmp_path / "all_v.csv").write_text(
        "vid;name;city;checkinsCount;likes;usersCount;tipCount;price;mayor;rating;likers;tags;cats;closed;createdAt;lon,lat\n"
        "4b;Bar;Paris;5;;2;1;x;;8.5;1,2;a,b;;;2010-01-02T03:04:05Z;2.5,48.5\n4c;No;Oslo;1;1;1;1;1;1;1;;;;;;1,2\n"
    )
    v = readers.venue_csv(spark, str(tmp_path / "all_*.csv"), ["paris"]).collect()
    assert len(v) == 1 and v[0]["likers"] == [1, 2] and v[0]["cats"] == [] and v[0]["tags"] == ["a", "b"] and v[0]["price"] is None and v[0]["loc"]["lng"] == 2.5
    (tmp_path / "tr.txt").write_text("a;b\nc\n")
    assert [tuple(r) for r in readers.translations(spark, str(tmp_path / "tr.txt")).collect()] == [("a", "b")]
    for n, k in (("one", 1), ("two", 2)):
        (tmp_path / f"tl_{n}.json").write_text(json.dumps([{"id": i} for i in range(k)]))
    assert readers.timelines(spark, str(tmp_path / "tl_*.json")).count() == 2
    (tmp_path / "tags.dat").write_text("tag\tcount\nb\t5\na\t5\nc\t9\n")
    assert [r["key"] for r in readers.ranked_file(spark, str(tmp_path / "tags.dat"), 2).orderBy("rank").collect()] == ["c", "a"]
    (tmp_path / "e.dat").write_text("_background\t0.9\nx\t0.5\ny\t0\nz\t0.1\n")
    assert [r["key"] for r in readers.entropy_file(spark, str(tmp_path / "e.dat")).collect()] == ["z", "x"]
    feature = {"geometry": {"type": "Polygon", "coordinates": [[[1, 2], [3, 4], [5, 6], [1, 2]]]}, "properties": {"venues": ["v"]}}
    (tmp_path / "rome_old.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature]}))
    g = readers.geojson_regions(spark, str(tmp_path / "rome_old.json")).first()
    assert (g["district"], g["city"], g["region_no"], len(g["ring"]), g["venues"]) == ("old", "rome", 0, 4, ["v"])
    tree = {"categories": [{"id": "b", "name": "Food", "categories": [{"id": "a", "name": "Cafe", "categories": []}]}]}
    (tmp_path / "cats.json").write_text(json.dumps(tree))
    c = {r["id"]: (r["depth"], r["path"], r["idx"]) for r in readers.category_tree(spark, str(tmp_path / "cats.json")).collect()}
    assert c == {"b": (1, ["b"], 101), "a": (2, ["b", "a"], 100)}
    (tmp_path / "run.log").write_text(
        "2014-07-08 10:00:00,000 [x] will write: comparaison_paris/rome_latin_200_emd.my\n"
        "2014-07-08 10:00:02,500 [x] comparaison_paris/rome_latin_200_emd.my\nnoise\n"
    )
    d = readers.durations(readers.run_log(spark, str(tmp_path / "run.log"))).first()
    assert (d["seconds"], d["source"], d["target"], d["district"], d["radius"], d["metric"]) == (2.5, "paris", "rome", "latin", 200, "emd")


def test_scan_and_predicates(spark):
    df = spark.createDataFrame([("paris", "v", 1), ("paris", None, 2), ("rome", "v", 3)], "city string, lid string, n int")
    assert [r["n"] for r in readers.scan(df, "paris", fields=["n"]).collect()] == [1]
    assert [tuple(r) for r in readers.entity_ids(df, "lid", first=1).collect()] == [("v", 2)]
    with pytest.raises(ValueError):
        readers.in_place_or_ball("venue")


def test_parsers(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first()["x"]

    c = one(parse.checkin(F.lit('{"user":{"id":"7"},"venue":{"id":"4b"},"createdAt":1205029800,"timeZoneOffset":60}')))
    assert (c["uid"], c["lid"], c["time"]) == (7, "4b", datetime(2008, 3, 9, 3, 30))
    assert one(parse.checkin(F.lit('{"user":{"id":7}}'))) is None and one(parse.checkin(F.lit("junk"))) is None and one(parse.checkin(F.lit(None).cast("string"))) is None
    v = one(parse.venue(F.lit('{"id":"4b","location":{"lng":2,"lat":48},"categories":[{"id":"c1"},{"id":"c2"}],"stats":{"checkinsCount":3},"tags":[" a","a "],"createdAt":0}')))
    assert (v["cat"], v["cats"], v["checkinsCount"], v["tags"], v["rating"]) == ("c1", ["c2"], 3, ["a"], None)
    assert one(parse.venue(F.lit('{"id":"4b","location":{}}'))) is None
    u = one(parse.user(F.lit('{"id":"5","gender":"none","homeCity":"","tips":{"count":4}}')))
    assert (u["id"], u["gender"], u["homeCity"], u["tips"], u["friends"]) == (5, None, None, 4, [])
    good = dict(id="9", owner="o", datetaken="2010-01-02 03:04:05", dateupload="1262400000", tags="bar site:venue=4b", title="Hi #x", farm=1, secret="s", server="2", longitude="2.5", latitude="48")
    p = one(parse.photo(F.lit(json.dumps(good)), "paris", "site"))
    assert (p["_id"], p["tags"], p["venue"], p["title"], p["taken"]) == (9, ["bar", "x"], "4b", "Hi", datetime(2010, 1, 2, 3, 4, 5))
    for bad in ({"id": "x"}, {"datetaken": "soon"}, {"tags": "", "title": "Hi"}, {"latitude": ""}):
        assert one(parse.photo(F.lit(json.dumps(good | bad)), "paris", "site")) is None
    msg = dict(id_str="1", text="t", created_at="Wed Aug 27 13:08:45 +0000 2008", user={"id_str": "3"}, coordinates={"coordinates": [2.3, 48.8]}, entities={"urls": [{"expanded_url": "http://x.y/1"}, {"expanded_url": "http://go.to/2"}]})
    boxes = spark.createDataFrame([("paris", 48.0, 2.0, 49.0, 3.0, "Europe/Paris")], "city string, lat_bl double, lng_bl double, lat_ur double, lng_ur double, zone string")
    lines = [json.dumps(m) for m in (msg, msg | {"coordinates": None}, msg | {"entities": {"urls": []}}, msg | {"created_at": "?"})]
    got = parse.message(spark.createDataFrame([(x,) for x in lines], "j string"), "j", boxes, ["go.to"]).collect()
    assert len(got) == 1 and got[0]["lid"] == "http://go.to/2" and got[0]["time"] == datetime(2008, 8, 27, 15, 8, 45) and got[0]["city"] == "paris"


class Service:
    """1,000 points on a line; pages of 50; the first attempt at some pages fails."""

    def __init__(self):
        self.failed = set()

    def inside(self, box):
        (x0, y0), (x1, y1) = box
        return [i for i in range(1000) if x0 <= i / 1000 < x1 and y0 <= 0.5 < y1]

    def total(self, box):
        return len(self.inside(box))

    def page(self, box, number):
        if number == 1 and box not in self.failed:
            self.failed.add(box)
            raise OSError("busy")
        return [(i, i / 1000) for i in self.inside(box)[(number - 1) * 50 : number * 50]]


def test_paged_source(spark):
    service = Service()
    found = paged.areas(service, ((0, 0), (1, 1)), 200, 5, 50)
    assert all(service.total(a.box) <= 200 for a in found) and sum(service.total(a.box) for a in found) == 1000
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(paged.paged_source(service, ((0, 0), (1, 1)), "id int, x double", most=200, per_page=50))
    assert spark.read.format("paged").load().select("id").distinct().count() == 1000


def test_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 2), (None, 3)], "k string, v int")
    assert writers.insert_new(df, path, "k") == 2 and writers.insert_new(df, path, "k") == 0
    assert writers.insert_new(spark.createDataFrame([("b", 9), ("c", 5)], "k string, v int"), path, "k") == 1
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 0), ("b", 2), ("c", 5)]
    up = writers.updated(df.where("k is not null"), spark.createDataFrame([("b", 7)], "k string, v int"), "k")
    assert sorted(map(tuple, up.collect())) == [("a", 0), ("a", 1), ("b", 7)]
    t = spark.createDataFrame([("x", datetime(2014, 1, 2, 3, 4, 5))], "k string, time timestamp_ntz")
    assert json.loads(t.select(writers.dated_json(t, "time")).first()[0]) == {"k": "x", "time": {"$date": "2014-01-02T03:04:05Z"}}
    writers.write_json_lines(df, str(tmp_path / "j"), F.col("v") > 0)
    assert spark.read.json(str(tmp_path / "j")).where("part = 'local'").count() == 3
    writers.write_tsv(df, str(tmp_path / "s"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "s")).count() == 4
    ring = F.array(*[F.struct(F.lit(x).alias("lng"), F.lit(y).alias("lat")) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0))])
    f = json.loads(spark.range(1).select(writers.feature(ring, {"n": F.lit(3)})).first()[0])
    assert f["geometry"]["coordinates"] == [[[0, 0], [1, 0], [1, 1], [0, 0]]] and f["properties"] == {"n": 3}
    assert spark.range(1).select(writers.rank_line(F.lit(2), F.lit(5), F.array(F.lit(0.5), F.lit(1.5)))).first()[0] == "2 qid:5 1:0.5 2:1.5"
    assert spark.range(1).select(writers.tag_line(F.array(F.lit("a"), F.lit("b")))).first()[0] == "a\tb"
    e = writers.extremes(df.dropna(), "k", "v", 1).first()
    assert (e["low"], e["low_value"], e["high"], e["high_value"]) == ("a", 0, "b", 2)
    assert writers.latex_rows(df.limit(1), ["k", "v"]).first()["line"].endswith(r" \\")


def test_stream(spark, tmp_path):
    schema = "_id string, city string, time timestamp_ntz"
    src = tmp_path / "in"
    for n, rows in enumerate([
        [("a", "p", datetime(2014, 1, 1, 1)), ("a", "p", datetime(2014, 1, 1, 1)), ("b", "q", datetime(2014, 1, 1, 2)), (None, "p", datetime(2014, 1, 1, 2)), ("n", "p", None)],
        [("a", "p", datetime(2014, 1, 1, 1)), ("c", "p", datetime(2014, 1, 1, 3))],
    ]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src / f"f{n}"))
    stream = ingest.file_stream(spark, str(src / "*"), schema, files_per_batch=1)
    clean = ingest.deduplicated(ingest.timed(stream, "time", "1 day"), "_id")
    out = str(tmp_path / "out")
    ingest.run_available(clean, f"t-{tmp_path.name}", out)
    assert sorted(r["_id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
    info = spark.createDataFrame([("p", "Paris")], "city string, name string")
    whole, lost = ingest.enriched(spark.read.parquet(out), info, "city")
    assert whole.count() == 2 and lost.count() == 1
    seen = []
    table = str(tmp_path / "table")

    def sink(batch, number):
        seen.append(number)
        ingest.into_table(table, "_id")(batch, number)
        ingest.into_table(table, "_id")(batch, number)

    ingest.run_available(ingest.file_stream(spark, str(src / "*"), schema, 1), f"u-{tmp_path.name}", sink)
    assert spark.read.parquet(table).count() == 4 and len(seen) >= 2
    batch = ingest.timed(spark.read.schema(schema).parquet(str(src / "*")), "time", "1 day")
    assert {r["city"]: r["n"] for r in ingest.window_counts(batch, "1 day", ["city"]).collect()} == {"p": 5, "q": 1}
    assert ingest.session_counts(batch, "30 minutes", ["city"]).where("city = 'p'").count() == 3


def test_backoff():
    now = [0.0]
    b = ingest.Backoff(first_s=100, most=2, clock=lambda: now[0])
    assert b.fail() == 100 and b.fail() == pytest.approx(161.8) and b.give_up()
    now[0] = 4000
    assert not b.give_up()
    b.reset()
    assert b.fail() == 100


def test_grids_and_balls(spark):
    boxes = spark.createDataFrame([("c", 0.0, 0.0, 1.0, 1.0)], "city string, lat_bl double, lng_bl double, lat_ur double, lng_ur double")
    pts = spark.createDataFrame([("c", 0.1, 0.1), ("c", 0.9, 0.9), ("c", 1.0, 1.0), ("c", 2.0, 0.5), ("d", 0.1, 0.1), ("c", None, 0.5)], "city string, lng double, lat double")
    f = grids.frequency(grids.placed(pts, boxes, "city", 4), ["city"])
    assert {(r["ix"], r["iy"]): r["n"] for r in f.collect()} == {(0, 0): 1, (3, 3): 2}
    assert grids.zero_filled(f, ["city"], 4).count() == 16
    assert {(r["ix"], r["iy"]): r["n"] for r in grids.coarser(f, ["city"]).collect()} == {(0, 0): 1, (1, 1): 2}
    c = spark.createDataFrame([("k", 0.0, 0.0), ("far", 50.0, 0.0), (None, 0.0, 0.0)], "key string, lng double, lat double")
    p = spark.createDataFrame([(0.0, 0.0, 1, 2), (0.001, 0.0, 1, 1), (0.001, 0.0, 2, 1), (0.01, 0.0, 1, 9), (None, 0.0, 1, 1)], "lng double, lat double, bin int, n int")
    got = {(r["key"], r["bin"]): (r["near"], r["weight"]) for r in proximity.ball_sums(c, p, 150.0, 112_000.0).collect()}
    import math

    w = math.exp(-(111.195**2) / 112_000)
    assert set(got) == {("k", 1), ("k", 2)} and got[("k", 1)][0] == 3 and got[("k", 1)][1] == pytest.approx(2 + w, rel=1e-4)
    assert proximity.ball_sums(c.limit(0), p, 150.0).count() == 0 and proximity.ball_sums(c, p.limit(0), 150.0).count() == 0


def test_profiles(spark):
    t = datetime(2014, 3, 14, 21)
    df = spark.createDataFrame([("v", "u", t), ("v", "u", t), ("v", "w", t), ("v", None, t), (None, "u", t), ("x", "u", None)], "lid string, uid string, t timestamp_ntz")
    e = profiles.visitor_entropy(df, "lid", "uid").where("lid = 'v'").first()
    import math

    assert e["n"] == 3 and e["entropy"] == pytest.approx(math.log(3) - 2 * math.log(2) / 3)
    assert profiles.weekend_share(df, "lid", "t").first()["weekend"] is True
    s = profiles.support(df, "lid", "uid", "t").where("lid = 'v'").first()
    assert (s["n"], s["users"], s["days"]) == (4, 2, 0.0)
    a = spark.createDataFrame([("x", 9), ("y", 5), ("z", 1)], "k string, n int")
    b = spark.createDataFrame([("y", 8), ("x", 6), ("w", 2)], "k string, n int")
    m = {r["k"]: (r["status"], r["move"]) for r in profiles.rank_movement(a, b, "k", "n", 3).collect()}
    assert m == {"y": ("+", 1), "x": ("-", -1), "w": ("new", None)}


def test_models(spark):
    rows = [(f"v{i}", b, 1.0 if b == i % 2 else 0.0) for i in range(10) for b in range(2)]
    got, centres = models.time_patterns(spark.createDataFrame(rows, "lid string, bin int, share double"), "lid", 2, k=2, runs=2)
    assert {r["pattern"] for r in got.where("lid in ('v0', 'v2')").collect()} == {1} and centres == [[0.0, 1.0], [1.0, 0.0]]
    x = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(6)], "k int, v array<double>")
    assert models.cluster_numbers(x, "v", range(2, 4))[0][1] >= 0 and len(models.components(x, "k", "v", 1).first()["p"]) == 1
    bags = spark.createDataFrame([(["a", "b"],), (["a", "c"],), (["b", "c"],), (["rare"],)], "tags array<string>")
    words = {r["word"] for r in models.topics(bags, "tags", k=2, least=2, most=1.0, passes=2).collect()}
    assert words <= {"a", "b", "c"} and words


def test_sampling_and_tables(spark):
    df = spark.createDataFrame([(k, i) for k in "ab" for i in range(20)], "k string, i int")
    one = {tuple(r) for r in profiles.sampled(df, 3, 7, ["k"], ["i"]).collect()}
    assert len(one) == 6 and one == {tuple(r) for r in profiles.sampled(df.orderBy(F.desc("i")), 3, 7, ["k"], ["i"]).collect()}
    assert profiles.sampled(df, 5, 1).count() == 5 and profiles.sampled(df.limit(0), 5, 1).count() == 0
    rows = spark.createDataFrame([("x", "a", 1.0), ("x", "a", 3.0), ("x", "b", 5.0), ("y", "a", 9.0)], "city string, metric string, v double")
    got = [(r["city"], r["a"], r["b"], r["mean"]) for r in profiles.score_table(rows, "city", "metric", "v", ["a", "b"]).collect()]
    assert got == [("y", 9.0, None, 9.0), ("x", 2.0, 5.0, 3.5)]
    t = spark.createDataFrame([("u", "p", "s", datetime(2014, 1, 1)), ("u", "q", "s", datetime(2014, 1, 2))], "uid string, city string, tag string, t timestamp_ntz")
    assert profiles.tag_rows(t, "s", start=F.lit("2014-01-02").cast("timestamp_ntz"), user="u", city="q").count() == 1
    assert profiles.tag_rows(t, end=F.lit("2014-01-02").cast("timestamp_ntz")).count() == 1
