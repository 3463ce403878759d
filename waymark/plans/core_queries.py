"""The general training-data queries p1, p4 and p5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.text import folded, letters, trimmed
from waymark.operators import heavykeys, proximity
from waymark.operators.sessions import sessions
from waymark.sources.tables import table

SESSION_GAP_S = 7_200
NEAR_M = 5.0


def _outings(spark: SparkSession, d: str) -> DataFrame:
    visits = table(spark, d, "checkin").select(
        F.lit("checkin").alias("kind"), F.col("_id").alias("record"), F.col("uid").cast("string").alias("uid"), F.col("time").alias("at")
    )
    shots = table(spark, d, "photos").select(
        F.lit("photo").alias("kind"), F.col("_id").cast("string").alias("record"), trimmed(F.col("uid")).alias("uid"), F.col("taken").alias("at")
    )
    return sessions(visits.unionByName(shots), ["kind", "uid"], "at", SESSION_GAP_S, record="record")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Outings of at least three records, with the local seconds of the first and last one."""
    out = _outings(spark, d).where("records >= 3")
    return out.select(
        "kind", "uid", F.floor(F.col("start_us") / 1_000_000).alias("start_s"), F.floor(F.col("end_us") / 1_000_000).alias("end_s")
    )


def p1_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Every outing with start, end, duration and number of records."""
    return _outings(spark, d).select(
        "kind", "uid", "session_no",
        F.floor(F.col("start_us") / 1_000_000).alias("start_s"), F.floor(F.col("end_us") / 1_000_000).alias("end_s"),
        F.floor(F.col("duration_us") / 1_000_000).alias("duration_s"), "records",
    )


_SESSIONS_SQL = """
with r as (
  select distinct 'checkin' as kind, cast(_id as varchar) as id, cast(uid as varchar) as uid, "time" as t from checkin where uid is not null and "time" is not null and _id is not null
  union
  select distinct 'photo', cast(_id as varchar), trim(uid), taken from photos where trim(uid) <> '' and taken is not null and _id is not null
), s as (
  select *, epoch_us(t) // 1000000 as u, case when epoch_us(t) - lag(epoch_us(t)) over (partition by kind, uid order by t, id) <= 7200000000 then 0 else 1 end as n from r
), g as (select *, sum(n) over (partition by kind, uid order by t, id rows unbounded preceding) as session_no from s)
select kind, uid, cast(session_no as bigint) as session_no, min(u) as start_s, max(u) as end_s, max(u) - min(u) as duration_s, count(*) as records from g group by kind, uid, session_no
"""
P1_FOUND_SQL = f"select kind, uid, start_s, end_s from ({_SESSIONS_SQL}) where records >= 3"


def _in_some_box(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points inside at least one city box (a fixed table of a few boxes)."""
    b = boxes.select("lat_bl", "lng_bl", "lat_ur", "lng_ur")
    inside = F.col("lat").between(F.col("lat_bl"), F.col("lat_ur")) & F.col("lng").between(F.col("lng_bl"), F.col("lng_ur"))
    return points.join(b, inside, "left_semi")


def _places(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("b"), F.col("loc.lng").alias("lng"), F.col("loc.lat").alias("lat"))


def _boxed_venues(spark: SparkSession, d: str) -> DataFrame:
    return _in_some_box(_places(table(spark, d, "venue"), "_id"), table(spark, d, "city_box"))


def _in_regions(spark: SparkSession, d: str) -> DataFrame:
    parts = [("venue", "venue"), ("photo", "photos"), ("checkin", "checkin")]
    points = [_places(table(spark, d, t), "_id").select(F.lit(k).alias("kind"), "b", "lng", "lat") for k, t in parts]
    gold = table(spark, d, "gold_region").select(F.concat_ws("/", "district", "city", "region_no").alias("region"), "ring")
    found = proximity.points_in_regions(points[0].unionByName(points[1]).unionByName(points[2]), gold)
    return found.where(F.col("b").isNotNull()).select("kind", F.col("region").alias("a"), "b").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Venues on the same spot, and the gold regions of every venue, photo and check-in."""
    near = proximity.near_rows(_boxed_venues(spark, d), "b", NEAR_M).select(F.lit("near").alias("kind"), "a", "b")
    return near.unionByName(_in_regions(spark, d))


def p4_spots(spark: SparkSession, d: str) -> DataFrame:
    """How many other venues are within 5 m of each venue that has any."""
    return proximity.near_counts(_boxed_venues(spark, d), "b", NEAR_M).select(F.col("b").alias("venue"), "neighbours")


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    visits = table(spark, d, "checkin").select(
        F.lit("checkin.lid").alias("field"), F.col("_id").alias("id"), folded(F.col("lid")).alias("key"), F.col("uid").cast("string").alias("value")
    )
    shots = table(spark, d, "photos").select(
        F.lit("photos.hint").alias("field"), F.col("_id").cast("string").alias("id"), letters(F.col("hint")).alias("key"), trimmed(F.col("uid")).alias("value")
    )
    return visits.unionByName(shots).dropna(subset=["id", "key"]).distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Venues on at least 2 % of the check-ins with a venue, cities on at least 10 % of the photos with a city."""
    prof = heavykeys.profile(heavykeys.compress(_keyed(spark, d), ["field", "key"], "value"), ["field", "key"])
    return heavykeys.heavy(prof, "field", {"checkin.lid": 2, "photos.hint": 10}).select("field", "key")


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    """Records, different users and the most frequent user of every venue and city."""
    prof = heavykeys.profile(heavykeys.compress(_keyed(spark, d), ["field", "key"], "value"), ["field", "key"])
    return prof.select("field", "key", "records", F.col("distinct_values").alias("users"), F.col("mode").alias("top_user"), F.col("mode_n").alias("top_user_n"))


def p5_hours(spark: SparkSession, d: str) -> DataFrame:
    """Quartiles of the local second of the day at every venue, one record per check-in."""
    t = F.col("time")
    rows = table(spark, d, "checkin").select(
        F.col("_id"), folded(F.col("lid")).alias("lid"), (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)).alias("s")
    ).dropna().distinct()
    out = heavykeys.percentiles(heavykeys.compress(rows, ["lid"], "s"), ["lid"], [0.25, 0.5, 0.75])
    return out.select("lid", "fraction", F.col("value").cast("bigint").alias("second_of_day"))


_KEYED_SQL = """
with r as (
  select distinct 'checkin.lid' as field, cast(_id as varchar) as id, lower(trim(lid)) as key, cast(uid as varchar) as value from checkin where trim(lid) <> '' and _id is not null
  union
  select distinct 'photos.hint', cast(_id as varchar), regexp_replace(lower(hint), '[^a-z]', '', 'g'), nullif(trim(uid), '') from photos where regexp_replace(lower(hint), '[^a-z]', '', 'g') <> '' and _id is not null
), f as (select field, key, value, count(*) as n from r group by all),
p as (select field, key, sum(n) as records, count(value) as users from f group by all)
"""
P5_FOUND_SQL = _KEYED_SQL + """
select field, key from (select *, sum(records) over (partition by field) as total from p)
where records * (case when field = 'checkin.lid' then 50 else 10 end) >= total
"""
P5_PROFILE_SQL = _KEYED_SQL + """,
m as (select field, key, value, n, row_number() over (partition by field, key order by n desc, value) as k from f where value is not null)
select p.field, p.key, cast(records as bigint) as records, users, m.value as top_user, m.n as top_user_n
from p left join m on m.field = p.field and m.key = p.key and m.k = 1
"""
P5_HOURS_SQL = """
with r as (select distinct _id, lower(trim(lid)) as lid, extract(hour from "time") * 3600 + extract(minute from "time") * 60 + extract(second from "time") as s
  from checkin where trim(lid) <> '' and "time" is not null and _id is not null),
k as (select lid, s, row_number() over (partition by lid order by s) as k, count(*) over (partition by lid) as n from r),
q as (select unnest([0.25, 0.5, 0.75]) as fraction)
select lid, cast(fraction as double) as fraction, cast(s as bigint) as second_of_day from k, q where k = greatest(1, ceil(fraction * n))
"""
P4_SPOTS_SQL = """
with v as (select distinct _id, loc.lng as x, loc.lat as y from venue where loc.lng is not null and loc.lat is not null),
w as (select * from v where exists (select 1 from city_box c where y between lat_bl and lat_ur and x between lng_bl and lng_ur)),
p as (select a._id as a, b._id as b from w a join w b on a._id < b._id and b.y between a.y - 0.0001 and a.y + 0.0001 and floor(a.y * 1000) - floor(b.y * 1000) between -1 and 1
  where 2 * 6371008.8 * asin(sqrt(pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2))) <= 5)
select venue, count(*) as neighbours from (select a as venue from p union all select b from p) group by venue
"""
_EDGES_SQL = """
with g as (select concat_ws('/', district, city, region_no) as a, ring from gold_region),
e as (select a, unnest(ring) as p, unnest(list_concat([ring[len(ring)]], ring[1:len(ring)-1])) as q from g),
r as (select distinct 'venue' as kind, cast(_id as varchar) as b, loc.lng as x, loc.lat as y from venue where loc.lng is not null
  union select distinct 'photo', cast(_id as varchar), loc.lng, loc.lat from photos where loc.lng is not null
  union select distinct 'checkin', cast(_id as varchar), loc.lng, loc.lat from checkin where loc.lng is not null),
box as (select a, min(p.lng) as x0, max(p.lng) as x1, min(p.lat) as y0, max(p.lat) as y1 from e group by a),
c as (select kind, r.b, x, y, box.a from r join box on x between x0 and x1 and y between y0 and y1),
hits as (select kind, c.a, b, sum(case when ((q.lat > y) <> (p.lat > y)) and x < (p.lng - q.lng) * (y - q.lat) / (p.lat - q.lat) + q.lng then 1 else 0 end) as k
  from c join e on e.a = c.a group by kind, c.a, b, x, y)
select distinct kind, a, b from hits where k % 2 = 1
"""
P4_FOUND_SQL = f"""
select kind, a, b from ({_EDGES_SQL})
union all
select 'near', a, b from (
with v as (select distinct _id, loc.lng as x, loc.lat as y from venue where loc.lng is not null and loc.lat is not null),
w as (select * from v where exists (select 1 from city_box c where y between lat_bl and lat_ur and x between lng_bl and lng_ur))
select a._id as a, b._id as b from w a join w b on a._id < b._id and b.y between a.y - 0.0001 and a.y + 0.0001
  where 2 * 6371008.8 * asin(sqrt(pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2))) <= 5)
"""

QUERIES = {
    "p1_found": p1_found, "p1_sessions": p1_sessions, "p4_found": p4_found, "p4_spots": p4_spots,
    "p5_found": p5_found, "p5_profile": p5_profile, "p5_hours": p5_hours,
}
SQL = {
    "p1_found": P1_FOUND_SQL, "p1_sessions": _SESSIONS_SQL, "p4_found": P4_FOUND_SQL, "p4_spots": P4_SPOTS_SQL,
    "p5_found": P5_FOUND_SQL, "p5_profile": P5_PROFILE_SQL, "p5_hours": P5_HOURS_SQL,
}
