"""Queries on duplicates, sets, lookups and texts of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import clock
from waymark.functions.geo import haversine_m
from waymark.functions.stats import jaccard
from waymark.functions.text import bare_tag, folded, letters, title_parts, trimmed
from waymark.operators import records as rec
from waymark.operators.profiles import ranked
from waymark.plans.common import L, T, V, places, tagged, visits, with_
from waymark.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""select _id, tid, msg from (select *, row_number() over (partition by _id order by try_cast(tid as hugeint) is null, try_cast(tid as hugeint), tid nulls first, msg nulls first) as k
from checkin where _id is not null) where k = 1""")
def min_id_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Of the copies of a check-in the one with the smallest number."""
    rows = table(spark, d, "checkin").select("_id", "tid", "msg")
    return rec.earliest(rows, "_id", F.expr("try_cast(tid as decimal(38, 0))"))


@query(with_(V, L) + "select distinct lid from v where lid is not null and lid not in (select id from l)")
def new_ids_anti(spark: SparkSession, d: str) -> DataFrame:
    """Venues of check-ins that the venue table does not have."""
    known = places(spark, d).select(F.col("id").alias("lid"))
    return rec.new_rows(visits(spark, d, "lid").select("lid").distinct(), "lid", known)


_BAGS = with_(T) + """, n as (select tag, count(case when city = 'vellmare' then 1 end) as in_a, count(case when city = 'santorvo' then 1 end) as in_b from g where city in ('vellmare', 'santorvo') group by tag)
"""


def _bags(spark: SparkSession, d: str) -> DataFrame:
    tags = tagged(spark, d, "city")
    return rec.multiset(tags.where("city = 'vellmare'"), tags.where("city = 'santorvo'"), "tag")


@query(_BAGS + "select tag, in_a + in_b as n from n where in_a + in_b > 0")
def multiset_sum(spark: SparkSession, d: str) -> DataFrame:
    return _bags(spark, d).select("tag", F.col("sum").alias("n"))


@query(_BAGS + "select tag, in_a - in_b as n from n where in_a > in_b")
def multiset_except(spark: SparkSession, d: str) -> DataFrame:
    return _bags(spark, d).where("minus > 0").select("tag", F.col("minus").alias("n"))


@query(_BAGS + "select tag, greatest(in_a, in_b) as n from n")
def multiset_union(spark: SparkSession, d: str) -> DataFrame:
    return _bags(spark, d).select("tag", F.col("either").alias("n"))


@query(_BAGS + "select tag, least(in_a, in_b) as n from n where in_a > 0 and in_b > 0")
def multiset_intersect(spark: SparkSession, d: str) -> DataFrame:
    return _bags(spark, d).where("`both` > 0").select("tag", F.col("both").alias("n"))


@query(with_(T) + """, n as (select city, tag, count(*) as n, row_number() over (partition by city order by count(*) desc, tag) as r from g where city in ('vellmare', 'santorvo', 'kastelhaven') group by city, tag)
select tag, cast(r as int) as rank from n where city = 'vellmare' and r <= 200 and tag in (select tag from n where city = 'santorvo' and r <= 200) and tag in (select tag from n where city = 'kastelhaven' and r <= 200)""")
def common_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags among the 200 most frequent of three cities, in the order of the first."""
    n = tagged(spark, d, "city").groupBy("city", "tag").agg(F.count(F.lit(1)).alias("n"))
    tops = [ranked(n.where(F.col("city") == c), [F.desc("n"), F.col("tag")], 200) for c in ("vellmare", "santorvo", "kastelhaven")]
    return rec.in_all(tops, "tag", "rank")


@query(with_(T) + """, n as (select city, tag, row_number() over (partition by city order by count(*) desc, tag) as r from g where city is not null group by city, tag), s as (select city, list(tag) as ts from n where r <= 50 group by city)
select a.city as city_a, b.city as city_b, round(len(list_intersect(a.ts, b.ts)) / len(list_distinct(list_concat(a.ts, b.ts))), 6) as jaccard from s a join s b on a.city < b.city""")
def jaccard_cities(spark: SparkSession, d: str) -> DataFrame:
    """Likeness of the cities' 50 most frequent tags; 20 cities, so 190 pairs."""
    n = tagged(spark, d, "city").where("city is not null").groupBy("city", "tag").agg(F.count(F.lit(1)).alias("n"))
    top = n.withColumn("r", F.row_number().over(Window.partitionBy("city").orderBy(F.desc("n"), "tag"))).where("r <= 50")
    sets = top.groupBy("city").agg(F.collect_set("tag").alias("ts"))
    a, b = (sets.select(F.col("city").alias(f"city_{x}"), F.col("ts").alias(x)) for x in "ab")
    return a.join(b, F.col("city_a") < F.col("city_b")).select("city_a", "city_b", F.round(jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query(with_(T) + """, b as (select id, uid, tag, floor((lng) * 100) as x, floor(lat * 100) as y, floor((epoch_us(t) // 1000000 - 1199145600) / 1209600.0) as c from g where uid is not null and t is not null and lng is not null and lat is not null),
n as (select *, count(*) over (partition by uid, tag, x, y, c) as n from b) select id, tag from n where n >= 3""")
def fortnight_burst_removal(spark: SparkSession, d: str) -> DataFrame:
    """Tags that one user put on at least three photos of one 0.01 degree cell and fortnight."""
    rows = tagged(spark, d, "uid", "t", "lng", "lat")
    bucket = [F.floor(F.col("lng") * 100), F.floor(F.col("lat") * 100), clock.time_cell(F.col("t"))]
    return rec.bulk_uses(rows, ["uid", "tag"], bucket, 3).select("id", "tag")


@query("""with p as (select distinct _id, nullif(lower(trim(lid)), '') as lid, nullif(trim(place), '') as place from checkin where _id is not null), q as (select * from p where lid is not null and place is not null),
a as (select lid, max(place) as place from q group by lid having count(*) = 1), b as (select place from q group by place having count(*) = 1) select lid, place from a where place in (select place from b)""")
def bijective_map(spark: SparkSession, d: str) -> DataFrame:
    """Venues and places that name each other in exactly one check-in."""
    return rec.one_to_one(_lid_place(spark, d), "lid", "place").select("lid", "place")


def _lid_place(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "checkin").select(F.col("_id").alias("id"), folded(F.col("lid")).alias("lid"), trimmed(F.col("place")).alias("place"))
    return rows.where("id is not null").distinct()


@query("""with p as (select distinct _id as id, nullif(lower(trim(lid)), '') as lid, nullif(trim(place), '') as place from checkin where _id is not null),
m as (select place, max(lid) as value from p where lid is not null and place is not null group by place having count(distinct lid) = 1)
select id, coalesce(lid, value) as lid from p left join m using (place)""")
def fill_missing_lid(spark: SparkSession, d: str) -> DataFrame:
    """Check-ins without a venue get it from their place where that names only one."""
    rows = _lid_place(spark, d)
    pairs = rows.dropna(subset=["lid", "place"]).select("lid", "place").distinct()
    mapping = pairs.groupBy("place").agg(F.max("lid").alias("value"), F.count(F.lit(1)).alias("k")).where("k = 1")
    return rec.filled(rows, "lid", "place", mapping).select("id", "lid")


@query(with_(V, L) + """, c as (select id, lng, lat from (select id, lng, lat, row_number() over (partition by id order by lng nulls last, lat nulls last) as k from l) where k = 1)
select v.id, v.lid, c.lng, c.lat from v join c on c.id = v.lid""")
def translate_inner(spark: SparkSession, d: str) -> DataFrame:
    """Check-ins of known venues with the venue's position instead of their own."""
    venue = places(spark, d, "lng", "lat").groupBy(F.col("id").alias("lid")).agg(F.min(F.struct(F.col("lng").isNull(), "lng", F.col("lat").isNull().alias("n"), "lat")).alias("p"))
    return visits(spark, d, "lid").join(venue, "lid").select("id", "lid", F.col("p.lng").alias("lng"), F.col("p.lat").alias("lat"))


@query(with_(V) + """select id, uid, last_value(lid ignore nulls) over (partition by uid order by t, id rows between unbounded preceding and current row) as known from v where uid is not null and t is not null""")
def last_known_venue(spark: SparkSession, d: str) -> DataFrame:
    """Each check-in with the user's last named venue so far."""
    rows = visits(spark, d, "uid", "t", "lid")
    out = rec.last_known(rows, "uid", "t", "id", "lid", F.floor(clock.epoch_s(F.col("t")) / 86_400))
    return out.select("id", "uid", "known")


@query(with_(L) + """select l.id as venue, coalesce(c.name, '???') as category, coalesce(t.name, '???') as top from l left join category c on c.id = l.cat left join category t on t.id = c.path[1]""")
def venue_labels(spark: SparkSession, d: str) -> DataFrame:
    """Name of the venue's category and of its top category."""
    cats = table(spark, d, "category").select(F.col("id").alias("cat"), F.col("name").alias("category"), F.get("path", 0).alias("top_id"))
    tops = cats.select(F.col("cat").alias("top_id"), F.col("category").alias("top"))
    out = places(spark, d, "cat").join(cats, "cat", "left").join(tops, "top_id", "left")
    return out.select(F.col("id").alias("venue"), F.coalesce("category", F.lit("???")).alias("category"), F.coalesce("top", F.lit("???")).alias("top"))


@query("""with recursive s as (select id, name, 0 as level, id as root from category where parent is null union all select c.id, c.name, s.level + 1, s.root from category c join s on c.parent = s.id)
select r.name as root, s.name, s.level from s join category r on r.id = s.root""")
def category_subtrees(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of the top categories by a recursive query over the parents."""
    table(spark, d, "category").select("id", "name", "parent").createOrReplaceTempView("waymark_category")
    return spark.sql("""
        with recursive s(id, name, level, root) as (
          select id, name, 0, id from waymark_category where parent is null
          union all select c.id, c.name, s.level + 1, s.root from waymark_category c join s on c.parent = s.id)
        select r.name as root, s.name, s.level from s join waymark_category r on r.id = s.root""")


@query("""with r as (select distinct _id, nullif(lower(regexp_replace(unnest(tags), '[\\s!"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~]', '', 'g')), '') as tag from photos where _id is not null) select tag, count(*) as n from r where tag is not null group by tag""")
def bare_tags(spark: SparkSession, d: str) -> DataFrame:
    """Records per tag without punctuation and white space."""
    rows = table(spark, d, "photos").select("_id", F.explode("tags").alias("tag")).select("_id", bare_tag(F.col("tag")).alias("tag")).dropna().distinct()
    return rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("""with r as (select distinct _id, title from photos where _id is not null and title is not null), x as (select _id, title, regexp_extract(title, '((?:\\s*#[^\\s#]+)+)\\s*$', 1) as tail from r)
select _id, case when tail = '' then title else trim(regexp_replace(title, '(?:\\s*#[^\\s#]+)+\\s*$', '')) end as title, len(list_filter(string_split_regex(replace(tail, '#', ' '), '\\s+'), lambda w: w <> '')) as tags from x""")
def title_split(spark: SparkSession, d: str) -> DataFrame:
    """Titles without their final hashtags."""
    rows = table(spark, d, "photos").select("_id", "title").dropna().distinct().withColumn("p", title_parts(F.col("title")))
    return rows.select("_id", F.col("p.title").alias("title"), F.size("p.tags").cast("bigint").alias("tags"))


@query("""select nullif(regexp_replace(lower(city), '[^a-z]', '', 'g'), '') as city, count(*) as n, count(distinct city) as spellings from checkin group by 1""")
def name_keys(spark: SparkSession, d: str) -> DataFrame:
    """Rows and spellings of each city name."""
    per = table(spark, d, "checkin").groupBy("city").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(letters(F.col("city")).alias("city")).agg(F.sum("n").alias("n"), F.count("city").alias("spellings")).select("city", "n", "spellings")


@query(with_(V, L) + """, c as (select city as box, (lat_bl + lat_ur) / 2 as y, (lng_bl + lng_ur) / 2 as x from city_box), near as (select distinct l.id, box from l join c on
2 * 6371008.8 * asin(sqrt(pow(sin(radians(l.lat - y) / 2), 2) + cos(radians(y)) * cos(radians(l.lat)) * pow(sin(radians(l.lng - x) / 2), 2))) <= 2000 where l.lng between -180 and 180 and l.lat between -90 and 90)
select box, lid, count(*) as visits from near join v on v.lid = near.id group by box, lid""")
def visits_in_ball(spark: SparkSession, d: str) -> DataFrame:
    """Visits of the venues within 2 km of each city's centre: venues first, then their check-ins."""
    centre = table(spark, d, "city_box").select(F.col("city").alias("box"), ((F.col("lat_bl") + F.col("lat_ur")) / 2).alias("y"), ((F.col("lng_bl") + F.col("lng_ur")) / 2).alias("x"))
    venues = places(spark, d, "lng", "lat").where("lng between -180 and 180 and lat between -90 and 90")
    close = F.abs(F.col("lat") - F.col("y")) < 0.02
    near = venues.join(centre, close & (haversine_m(F.col("lng"), F.col("lat"), F.col("x"), F.col("y")) <= 2000)).select(F.col("id").alias("lid"), "box").distinct()
    per = visits(spark, d, "lid").groupBy("lid").agg(F.count(F.lit(1)).alias("visits"))
    return near.join(per, "lid").select("box", "lid", "visits")


@query("""with r as (select distinct nullif(lower(trim(venue)), '') as venue from photos) select r.venue from r join (select distinct lower(_id) as id from venue) on id = r.venue""")
def photographed_venues(spark: SparkSession, d: str) -> DataFrame:
    """Venue ids that both photos and venues have."""
    a = table(spark, d, "photos").select(folded(F.col("venue")).alias("venue")).dropna()
    return a.intersect(table(spark, d, "venue").select(folded(F.col("_id")).alias("venue")))
