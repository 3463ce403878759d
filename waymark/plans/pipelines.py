"""Queries through parsers, streams, learned models and the feature builder."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import clock
from waymark.functions.geo import gaussian_weight, haversine_m
from waymark.functions.text import folded, letters
from waymark.lineage import scratch
from waymark.operators import features as ft
from waymark.operators import models, proximity
from waymark.operators import profiles as pr
from waymark.plans.common import P, V, places, shots, tagged, visits, with_
from waymark.sinks import writers
from waymark.sources import parse
from waymark.sources.tables import table
from waymark.streaming import ingest

QUERIES: dict = {}
SQL: dict = {}
#: The top category of passing events, which are no places.
EVENTS = "Happenings"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""select distinct _id, uid, lid, "time" as time from checkin where uid is not null and lid is not null and "time" is not null and _id is not null""")
def checkin_json(spark: SparkSession, d: str) -> DataFrame:
    """Check-ins written as service JSON (UTC seconds and an offset) and parsed again."""
    t = F.col("time")
    made = F.to_json(F.struct(
        F.struct(F.col("uid").alias("id")).alias("user"), F.struct(F.col("lid").alias("id")).alias("venue"),
        (clock.epoch_s(t) + 5 * 3600).alias("createdAt"), F.lit(-300).alias("timeZoneOffset"),
    ))
    rows = table(spark, d, "checkin").select("_id", parse.checkin(made).alias("c")).where("c is not null and _id is not null")
    return rows.select("_id", "c.uid", "c.lid", "c.time").distinct()


@query("""select _id, min(name) as name, max("checkinsCount") as checkins, max(likes) as likes, count(*) as copies from venue where loc.lng is not null and loc.lat is not null and _id is not null group by _id""")
def venue_json(spark: SparkSession, d: str) -> DataFrame:
    """Venues written as service JSON and parsed again."""
    made = F.to_json(F.struct(
        F.col("_id").alias("id"), "name", F.struct(F.col("loc.lng").alias("lng"), F.col("loc.lat").alias("lat")).alias("location"),
        F.struct("checkinsCount", "usersCount", "tipCount").alias("stats"), F.struct(F.col("likes").alias("count")).alias("likes"), "tags",
    ))
    v = table(spark, d, "venue").select(parse.venue(made).alias("v"), F.col("likes").isNull().alias("none")).where("v is not null")
    out = v.groupBy(F.col("v._id").alias("_id")).agg(
        F.min("v.name").alias("name"), F.max("v.checkinsCount").alias("checkins"), F.max(F.when(~F.col("none"), F.col("v.likes"))).cast("int").alias("likes"), F.count(F.lit(1)).alias("copies")
    )
    return out


@query("""select district || '/' || city || '/' || region_no as region, len(ring) as points, ring[1] = ring[len(ring)] as closed from gold_region""")
def region_features(spark: SparkSession, d: str) -> DataFrame:
    """Gold regions as GeoJSON features, read back: corners as stored and whether the ring was closed."""
    g = table(spark, d, "gold_region")
    text = writers.feature(F.col("ring"), {"name": F.concat_ws("/", "district", "city", "region_no")})
    schema = "geometry struct<coordinates:array<array<array<double>>>>, properties struct<name:string>"
    back = g.select(F.from_json(text, schema).alias("f"), (F.get("ring", 0) == F.element_at("ring", -1)).alias("closed"))
    n = F.size(F.get("f.geometry.coordinates", 0)) - F.when(F.col("closed"), 0).otherwise(1)
    return back.select(F.col("f.properties.name").alias("region"), n.cast("bigint").alias("points"), "closed")


@query(with_(P) + """, t as (select distinct _id as id, nullif(lower(trim(unnest(tags))), '') as tag from photos where _id is not null),
i as (select id, max(cast(tag = 'bridgelover' as int)) as tag_bridgelover, max(cast(tag = 'foodscape' as int)) as tag_foodscape, max(cast(tag = 'snow' as int)) as tag_snow from t where tag is not null group by id)
select p.id, cast(isodow(p.t) - 1 as int) as weekday, cast(hour(p.t) as int) as hour, epoch_us(p.t) // 1000000 as epoch, tag_bridgelover, tag_foodscape, tag_snow from p join i using (id) where p.t is not null""")
def design_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Time features and one indicator for each of three tags, per photo with tags."""
    tags = table(spark, d, "photos").select(F.col("_id").alias("id"), F.explode("tags").alias("tag")).select("id", folded(F.col("tag")).alias("tag")).dropna()
    marks = tags.groupBy("id").agg(F.collect_set(F.when(F.col("tag").isin("bridgelover", "foodscape", "snow"), F.col("tag"))).alias("tags"))
    rows = shots(spark, d, "uid", "city", "t", "lng", "lat").dropna(subset=["t"]).join(marks, "id")
    t = F.col("t")
    rows = writers.indicators(rows, "tags", ["bridgelover", "foodscape", "snow"])
    return rows.select("id", F.weekday(t).alias("weekday"), F.hour(t).alias("hour"), clock.epoch_s(t).alias("epoch"), "tag_bridgelover", "tag_foodscape", "tag_snow")


@query(with_(V) + "select city, cast(t as date) as day, count(*) as n from v where city is not null and t >= '2000-01-01' group by all")
def stream_dedup_window(spark: SparkSession, d: str) -> DataFrame:
    """Check-ins as a file stream, deduplicated in a watermark of 40 days, then counted per city and day."""
    out = scratch(spark, "landed")
    raw = table(spark, d, "checkin")
    stream = ingest.file_stream(spark, f"{d.rstrip('/')}/checkin.parquet*", raw.schema)
    stream = stream.where(F.col("time") >= F.lit("2000-01-01").cast("timestamp_ntz")).select("_id", "city", "time")
    ingest.run_available(ingest.deduplicated(ingest.timed(stream, "time", "40 days"), "_id"), uuid4().hex, out)
    landed = spark.read.parquet(out).select(letters(F.col("city")).alias("city"), F.to_date("time").alias("day")).dropna()
    return landed.groupBy("city", "day").agg(F.count(F.lit(1)).alias("n"))


@query()
def time_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Five daily patterns of the venues with more than five visits."""
    rows = visits(spark, d, "lid", "t")
    busy = rows.dropna().groupBy("lid").agg(F.count(F.lit(1)).alias("n")).where("n > 5").select("lid")
    return models.time_patterns(pr.day_profile(rows.join(busy, "lid", "left_semi"), ["lid"], "t"), "lid", 6, 5, 7)[0]


@query()
def venue_cluster_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Cost and silhouette of three to fifteen clusters of the standardised venue features."""
    z = ft.standardised(ft.cleaned(table(spark, d, "venue_feature"), letters(F.col("city")), "venue_id", "f"))
    rows = models.cluster_numbers(z.select("z"), "z", range(3, 16))
    return spark.createDataFrame([(k, round(c, 4), round(q, 6)) for k, c, q in rows], "k int, cost double, silhouette double")


@query()
def feature_components(spark: SparkSession, d: str) -> DataFrame:
    """Two principal components of the standardised venue features."""
    z = ft.standardised(ft.cleaned(table(spark, d, "venue_feature"), letters(F.col("city")), "venue_id", "f"))
    return models.components(z.withColumn("key", F.struct("city", "venue")), "key", "z", 2).select("key.city", "key.venue", "p")


@query()
def tag_topics(spark: SparkSession, d: str) -> DataFrame:
    """Eighty topics of the photo tags."""
    bags = tagged(spark, d).groupBy("id").agg(F.collect_list("tag").alias("tags"))
    return models.topics(bags, "tags", k=80, least=30, passes=5)


@query()
def venue_features_built(spark: SparkSession, d: str) -> DataFrame:
    """The 31 features of each venue with visits, from the raw tables: counts, entropies, density, surroundings, focus, photogeny, profiles."""
    cats = table(spark, d, "category")
    tops = [r["id"] for r in cats.where("depth = 1").where(F.col("name") != EVENTS).orderBy("id").collect()]
    code = F.create_map(*[F.lit(x) for i, t in enumerate(tops) for x in (t, i)])
    order = F.create_map(*[F.lit(x) for i, r in enumerate(cats.orderBy("id").select("id").collect()) for x in (r["id"], i)])
    v = table(spark, d, "venue").groupBy(F.col("_id").alias("venue")).agg(
        F.max("likes").alias("likes"), F.max("usersCount").alias("users"), F.max("checkinsCount").alias("checkins"), F.max(folded(F.col("cat"))).alias("cat")
    )
    path = cats.select(F.col("id").alias("cat"), F.get("path", 0).alias("top"))
    v = v.join(path, "cat").withColumn("t", F.try_element_at(code, F.col("top"))).where("t is not null")
    where = places(spark, d, "lng", "lat").withColumnRenamed("id", "venue")
    here = proximity.located(where.dropna().join(v.select("venue", "t"), "venue"))
    centres = here.select(F.col("venue").alias("key"), "lng", "lat")
    around = proximity.ball_sums(centres, here.select("lng", "lat", F.col("t").alias("bin"), F.lit(1).alias("n")), 350.0, 112_000.0)
    shares = _spread(around, "key", "weight", len(tops), "c")
    photos = shots(spark, d, "lng", "lat").select("lng", "lat", F.lit(6).alias("bin"), F.lit(1).alias("n"))
    checks = visits(spark, d, "lng", "lat", "t").select("lng", "lat", F.coalesce(clock.hour_chunk(F.col("t"), 4, 1), F.lit(7)).alias("bin"), F.lit(1).alias("n"))
    activity = proximity.ball_sums(centres, photos.unionByName(checks), 350.0, 112_000.0)
    surround = _spread(activity.where("bin < 6"), "key", "weight", 6, "s")
    photo = activity.groupBy("key").agg(F.coalesce(F.sum(F.when(F.col("bin") == 6, F.col("weight"))), F.lit(0.0)).alias("pw"), F.coalesce(F.sum(F.when(F.col("bin") != 6, F.col("weight"))), F.lit(0.0)).alias("cw"))
    density = proximity.ball_sums(centres, here.select("lng", "lat", F.lit(0).alias("bin"), F.lit(1).alias("n")), 875.0, 2 * 175.0**2).select("key", F.col("weight").alias("density"))
    rows = visits(spark, d, "lid", "uid", "t")
    public = pr.visitor_entropy(rows, "lid", "uid").select(F.col("lid").alias("key"), F.col("entropy").alias("publicness"))
    opening = pr.hour_entropy(rows, "lid", "t").select(F.col("lid").alias("key"), F.col("entropy").alias("opening"))
    weekend = pr.weekend_share(rows, "lid", "t").select(F.col("lid").alias("key"), F.col("weekend").cast("double").alias("weekend"))
    own = _spread(pr.day_profile(rows, ["lid"], "t").withColumnRenamed("lid", "key"), "key", "share", 6, "a")
    tied = table(spark, d, "photos").select(F.col("_id").alias("id"), folded(F.col("venue")).alias("key"), F.col("loc.lng").alias("x"), F.col("loc.lat").alias("y")).dropna().distinct()
    focus = _focus(centres, tied)
    out = v.withColumnRenamed("venue", "key")
    for part in (public, opening, weekend, own):
        out = out.join(part, "key")
    for part in (density, shares, surround, photo, focus):
        out = out.join(part, "key", "left")
    most = density.agg(F.max("density").alias("_m"))
    out = out.join(F.broadcast(most))
    number = (F.col("t") + 1) * 100_000 + F.try_element_at(order, F.col("cat"))
    parts = [F.col(c) for c in ("likes", "users", "checkins", "publicness")] + [F.col("density") / F.col("_m"), number]
    parts += [F.get("c", i) for i in range(len(tops))] + [F.col("focus"), F.try_divide("pw", "cw"), F.col("weekend")]
    parts += [F.get("a", i) for i in range(6)] + [F.col("opening")] + [F.coalesce(F.get("s", i), F.lit(1.0)) for i in range(6)]
    return out.select(F.col("key").alias("venue"), F.array(*[F.coalesce(p.cast("double"), F.lit(0.0)) for p in parts]).alias("f"))


def _spread(rows: DataFrame, key: str, value: str, bins: int, name: str) -> DataFrame:
    """(key, name): the shares of the bins as an array."""
    total = F.sum(value)
    return rows.groupBy(key).agg(F.array(*[F.coalesce(F.sum(F.when(F.col("bin") == b, F.col(value))) / total, F.lit(0.0)) for b in range(bins)]).alias(name))


def _focus(centres: DataFrame, tied: DataFrame) -> DataFrame:
    """(key, focus): weighted photos around a venue that name it over those that name another; 0 below 1e-4."""
    every = proximity.ball_sums(centres, tied.select(F.col("x").alias("lng"), F.col("y").alias("lat"), F.lit(0).alias("bin"), F.lit(1).alias("n")), 350.0, 112_000.0)
    metres = haversine_m(F.col("lng"), F.col("lat"), F.col("x"), F.col("y"))
    own = centres.join(tied, "key").withColumn("m", metres).where("m <= 350").groupBy("key").agg(F.sum(gaussian_weight(F.col("m"))).alias("own"))
    both = every.select("key", F.col("weight").alias("all")).join(own, "key", "left").fillna(0.0, ["own"])
    rest = F.col("all") - F.col("own")
    return both.select("key", F.when(rest < 1e-4, 0.0).otherwise(F.col("own") / rest).alias("focus"))
