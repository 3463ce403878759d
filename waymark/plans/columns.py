"""Queries on column functions: links, ids, nested fields, shapes, periods and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import clock, geo, nested, stats, text
from waymark.functions.text import letters, trimmed
from waymark.operators import transport
from waymark.plans.common import L, P, T, V, places, shots, tagged, visits, with_
from waymark.plans.matching import _Z as _Z_SQL
from waymark.plans.matching import _z
from waymark.plans.spatial import _TWO, _two
from waymark.sources import parse
from waymark.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}
HOME = "vellmare"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""with m as (select distinct _id, trim(msg) || case when uid % 2 = 0 then ' http://t.example/' || right(_id, uid % 9) else '' end as m from checkin where msg is not null and _id is not null), w as (select _id, regexp_extract(m, '(\\S+)$', 1) as w from m)
select distinct _id, w as link from w where starts_with(w, 'htt') and length(w) <= 23""")
def message_links(spark: SparkSession, d: str) -> DataFrame:
    """The short link at the end of check-ins' messages, to half of which one is added."""
    end = F.when(F.col("uid") % 2 == 0, F.concat(F.lit(" http://t.example/"), F.expr("right(_id, cast(uid % 9 as int))"))).otherwise("")
    rows = table(spark, d, "checkin").select("_id", text.trailing_url(F.concat(F.trim("msg"), end)).alias("link"))
    return rows.dropna().distinct()


@query("""select distinct _id, printf('%x', uid) as id, tid as signature from checkin where uid is not null and _id is not null and regexp_full_match(tid, '[0-9]+')""")
def link_parts(spark: SparkSession, d: str) -> DataFrame:
    """Id and signature read from check-in links."""
    rows = table(spark, d, "checkin").where("uid is not null and _id is not null and tid rlike '^[0-9]+$'")
    link = F.concat(F.lit("https://example.org/u/checkin/"), F.lower(F.hex("uid")), F.lit("?s="), F.col("tid"), F.lit("&ref=tw"))
    return rows.select("_id", text.id_and_signature(link).alias("x")).select("_id", "x.id", "x.signature").distinct()


@query("""select distinct _id, printf('https://farm%d.example.org/%s/%d_%s_z.jpg', farm, server, _id, secret) as url, printf('%d_%s_z.jpg', _id, secret) as name from photos where _id is not null and farm is not null and server is not null and secret is not null""")
def photo_urls(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of the photos' files, and the file names at their ends."""
    p = table(spark, d, "photos").where("_id is not null and farm is not null and server is not null and secret is not null")
    url = text.photo_url("example.org", F.col("farm"), F.col("server"), F.col("_id"), F.col("secret"))
    return p.select("_id", url.alias("url"), text.last_path_part(url).alias("name")).distinct()


@query(with_(V) + "select distinct lid, substr(sha256(lid || '|' || city), 1, 24) as made from v where lid is not null and city is not null")
def synthetic_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids made from venue and city alone."""
    rows = visits(spark, d, "lid", "city").dropna().select("lid", "city").distinct()
    return rows.select("lid", text.synthetic_id(F.col("lid"), F.col("city")).alias("made")).distinct()


@query("""with p as (select distinct _id, venue, list_filter(list_transform(tags, lambda t: regexp_replace(t, '\\s+', '', 'g')), lambda t: t <> '' and t not like '%:%') as w from photos where _id is not null and venue is not null and trim(venue) <> '' and tags is not null and not contains(venue, ' '))
select distinct _id, cast(coalesce(len(w), 0) as int) as words, venue from p""")
def machine_words(spark: SparkSession, d: str) -> DataFrame:
    """Plain words and the venue named by a machine tag in the photos' tag texts."""
    p = table(spark, d, "photos").where("_id is not null and tags is not null").where(trimmed(F.col("venue")).isNotNull() & ~F.contains("venue", F.lit(" ")))
    words = F.transform("tags", lambda t: F.regexp_replace(t, r"\s+", ""))
    line = F.concat_ws(" ", F.array_join(words, " "), F.concat(F.lit("places:venue="), F.col("venue")), F.lit("other:key=1"))
    return p.select("_id", text.machine_tags(line, "places").alias("m")).select("_id", F.size("m.tags").alias("words"), "m.venue").distinct()


@query("select distinct _id as venue, round(loc.lat, 6) as lat, round(loc.lng, 6) as lng from venue v join city_box c on c.city = nullif(regexp_replace(lower(v.city), '[^a-z]', '', 'g'), '') where _id is not null and loc.lng between -180 and 180 and loc.lat between -90 and 90 and abs(loc.lat - lat_bl) < 0.3 and abs(loc.lng - lng_bl) < 0.3")
def projection_back(spark: SparkSession, d: str) -> DataFrame:
    """Positions of venues near their city's box projected to metres and back to degrees."""
    v = table(spark, d, "venue").select(F.col("_id").alias("venue"), letters(F.col("city")).alias("city"), F.col("loc.lng").alias("lng"), F.col("loc.lat").alias("lat")).dropna()
    v = v.join(table(spark, d, "city_box"), "city").where("abs(lat - lat_bl) < 0.3 and abs(lng - lng_bl) < 0.3")
    middle = ((F.col("lat_bl") + F.col("lat_ur")) / 2, (F.col("lng_bl") + F.col("lng_ur")) / 2)
    east, north = geo.local_xy(F.col("lat"), F.col("lng"), *middle)
    # the tangent plane drops the height above it; at 30 km it shifts the position by centimetres
    lat, lng = geo.local_to_geo(east, north, *middle)
    return v.select("venue", F.when(F.abs(lat - F.col("lat")) < 1e-5, F.round("lat", 6)).alias("lat"), F.when(F.abs(lng - F.col("lng")) < 1e-5, F.round("lng", 6)).alias("lng")).distinct()


@query("select city, cast(16 as bigint) as corners, true as true_radius from city_box")
def circle_rings(spark: SparkSession, d: str) -> DataFrame:
    """Circles of 500 m around the cities' middles: their corners, and that each is 500 m away to half a per cent (the sphere is not the ellipsoid)."""
    b = table(spark, d, "city_box").withColumns({"lat": (F.col("lat_bl") + F.col("lat_ur")) / 2, "lng": (F.col("lng_bl") + F.col("lng_ur")) / 2})
    rows = b.select("city", "lat", "lng", F.explode(geo.circle_ring(F.col("lat"), F.col("lng"), F.lit(500.0))).alias("p"))
    metres = geo.haversine_m(F.col("lng"), F.col("lat"), F.col("p.lng"), F.col("p.lat"))
    return rows.groupBy("city").agg(F.count(F.lit(1)).alias("corners"), F.bool_and(F.abs(metres - 500) < 2.5).alias("true_radius"))


@query(with_(L) + f""", b as (select * from city_box where city = '{HOME}')
select count(*) as inside from l, b where lng > lng_bl and lng < lng_ur and lat > lat_bl and lat < lat_ur""")
def inside_outline(spark: SparkSession, d: str) -> DataFrame:
    """Venues strictly inside the outline of a city's box, as a convex ring."""
    b = table(spark, d, "city_box").where(F.col("city") == HOME).first()
    ring = geo.box_ring((b["lat_ur"], b["lng_bl"], b["lat_bl"], b["lng_ur"]), closed=False)
    shape = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ring])
    return places(spark, d, "lng", "lat").where(geo.convex_contains(shape, F.col("lng"), F.col("lat"))).agg(F.count(F.lit(1)).alias("inside"))


@query(with_(P) + f""", b as (select *, (lng_bl + lng_ur) / 2 as xm, (lat_bl + lat_ur) / 2 as ym from city_box where city = '{HOME}'),
q as (select 0 as part, lng_bl as x0, lat_bl as y0, xm as x1, ym as y1 from b union all select 1, lng_bl, ym, xm, lat_ur from b union all select 2, xm, lat_bl, lng_ur, ym from b union all select 3, xm, ym, lng_ur, lat_ur from b)
select part, count(*) as photos from q join p on lat between y0 and y1 and lng between x0 and x1 group by part""")
def box_quarters(spark: SparkSession, d: str) -> DataFrame:
    """Photos in each quarter of a city's box."""
    b = table(spark, d, "city_box").where(F.col("city") == HOME).first()
    parts = geo.quarters(((b["lng_bl"], b["lat_bl"]), (b["lng_ur"], b["lat_ur"])))
    inside = [geo.in_box(F.col("lat"), F.col("lng"), (y0, x0, y1, x1)) for (x0, y0), (x1, y1) in parts]
    hits = F.filter(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(inside)]), lambda i: i.isNotNull())
    return shots(spark, d, "lng", "lat").select(F.explode(hits).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("photos"))


@query(with_(L) + f""", b as (select * from city_box where city = '{HOME}')
select id, cast(floor((lng - lng_bl) / (lng_ur - lng_bl) * 1350) as int) as px, cast(floor((lat_ur - lat) / (lat_ur - lat_bl) * 1206) as int) as py,
printf('#%02x%02x%02x', cast(floor((lng - lng_bl) / (lng_ur - lng_bl) * 255) as int), cast(floor((lat - lat_bl) / (lat_ur - lat_bl) * 255) as int), 127) as colour from l, b where lng between lng_bl and lng_ur and lat between lat_bl and lat_ur""")
def canvas_points(spark: SparkSession, d: str) -> DataFrame:
    """Pixel and colour of each venue on a drawing of a city's box."""
    b = table(spark, d, "city_box").where(F.col("city") == HOME).first()
    box = (b["lat_bl"], b["lng_bl"], b["lat_ur"], b["lng_ur"])
    rows = places(spark, d, "lng", "lat").where(geo.in_box(F.col("lat"), F.col("lng"), box))
    px, py = geo.canvas_pixel(F.col("lat"), F.col("lng"), box, 1_350, 1_206)
    red, green = (F.col("lng") - box[1]) / (box[3] - box[1]), (F.col("lat") - box[0]) / (box[2] - box[0])
    return rows.select("id", px.alias("px"), py.alias("py"), geo.css_hex(red, green, F.lit(0.5)).alias("colour"))


@query("""with u as (select distinct uid from checkin where uid is not null)
select uid as id, cast(uid % 3 as bigint) as "friendsCount", case when uid % 3 > 0 then 2 * uid + 3 else 0 end as friends_sum, case when uid % 2 = 0 then 'female' end as gender, cast(7 as bigint) as tips, cast(0 as bigint) as lists from u""")
def user_json(spark: SparkSession, d: str) -> DataFrame:
    """Users as service JSON with nested groups of friends, brought into shape."""
    u = table(spark, d, "checkin").select("uid").dropna().distinct()
    item = lambda c: F.struct(c.cast("string").alias("id"))
    others = F.struct(F.lit("others").alias("type"), F.array(item(F.col("uid") + 1), item(F.col("uid") + 2)).alias("items"))
    near = F.struct(F.lit("near").alias("type"), F.array(item(F.lit(5))).alias("items"))
    friends = F.struct((F.col("uid") % 3).alias("count"), F.array(near, others).alias("groups"))
    made = F.to_json(F.struct(F.col("uid").alias("id"), friends.alias("friends"), F.when(F.col("uid") % 2 == 0, "female").otherwise("none").alias("gender"), F.struct(F.lit(7).alias("count")).alias("tips")))
    x = u.select(parse.user(made).alias("x"))
    total = F.aggregate("x.friends", F.lit(0).cast("bigint"), lambda s, i: s + i)
    return x.select("x.id", "x.friendsCount", total.alias("friends_sum"), "x.gender", "x.tips", "x.lists")


@query("select path[1] as top, count(*) as members, max(depth) as deepest, 1 as own from category group by path[1]")
def category_maps(spark: SparkSession, d: str) -> DataFrame:
    """The categories below each top category as a map from id to depth, read from tuples of columns."""
    rows = nested.columns_of(table(spark, d, "category").select("id", "depth", F.get("path", 0).alias("top")), ["top", "id", "depth"])
    maps = rows.groupBy("row.top").agg(nested.as_map(F.col("row.id"), F.col("row.depth")).alias("m"))
    return maps.select("top", F.size("m").cast("bigint").alias("members"), F.array_max(F.map_values("m")).alias("deepest"), F.try_element_at("m", F.col("top")).alias("own"))


@query(with_(L) + """, c as (select l.id, len(path) as n from l join category c on c.id = l.cat) select n as steps, 5 as padded, count(*) as venues from c group by n""")
def padded_paths(spark: SparkSession, d: str) -> DataFrame:
    """Venues by the length of their category path, each path lengthened to five."""
    rows = places(spark, d, "cat").join(table(spark, d, "category").select(F.col("id").alias("cat"), "path"), "cat")
    rows = rows.select(F.size("path").alias("steps"), F.size(nested.padded(F.col("path"), 5, F.lit(""))).alias("padded"))
    return rows.groupBy("steps", "padded").agg(F.count(F.lit(1)).alias("venues"))


@query(with_(P) + "select cast(floor((epoch_us(t) // 1000000 - epoch(timestamp '2013-01-01')) / (10 * 86400)) as bigint) as slice, count(*) as photos from p where t >= '2013-01-01' group by 1")
def period_slices(spark: SparkSession, d: str) -> DataFrame:
    """Photos in slices of ten days since the beginning of 2013."""
    rows = shots(spark, d, "t").select(clock.period_slice(F.col("t"), "2013-01-01", 10).alias("slice")).dropna()
    return rows.groupBy("slice").agg(F.count(F.lit(1)).alias("photos"))


@query(with_(T, P) + """, n as (select city, tag, count(*) as n from g where city is not null group by city, tag), t as (select tag, sum(n) as t from n group by tag), c as (select city, count(*) as c from p where city is not null group by city)
select city, tag, round(5 * (n / c) * (n / t) / (4 * (n / t) + n / c), 6) as f2 from n join t using (tag) join c using (city)""")
def tag_f_scores(spark: SparkSession, d: str) -> DataFrame:
    """How well a tag tells a city: F-score of its share of the city's photos (recall) and the city's share of the tag (precision)."""
    n = tagged(spark, d, "city").dropna(subset=["city"]).groupBy("city", "tag").agg(F.count(F.lit(1)).alias("n"))
    t = n.groupBy("tag").agg(F.sum("n").alias("t"))
    c = shots(spark, d, "city").dropna(subset=["city"]).groupBy("city").agg(F.count(F.lit(1)).alias("c"))
    f2 = stats.f_score(F.col("n") / F.col("c"), F.col("n") / F.col("t"))
    return n.join(t, "tag").join(c, "city").select("city", "tag", F.round(f2, 6).alias("f2"))


@query(_TWO + """, s as (select *, sum(m) over (partition by city) as tm, sum(b) over (partition by city) as tb from two), q as (select *, m / tm as pm, b / tb as pb from s where m >= 5 and b >= 5)
select city, ix, iy, round(pm * ln(pm / pb) + case when pm < 1 then (1 - pm) * ln((1 - pm) / (1 - pb)) else 0 end, 6) as value from q where pm > pb and pb < 1""")
def cell_discrepancy(spark: SparkSession, d: str) -> DataFrame:
    """The scan statistic of single cells."""
    w = Window.partitionBy("city")
    rows = _two(spark, d).withColumns({"tm": F.sum("m").over(w), "tb": F.sum("b").over(w)})
    value = stats.discrepancy(F.col("m"), F.col("b"), F.col("tm"), F.col("tb"), 5)
    return rows.select("city", "ix", "iy", F.round(value, 6).alias("value")).dropna()


@query(with_(_Z_SQL) + """, c as (select city, dense_rank() over (order by dim) as k, avg(z) as m from z group by city, dim)
select a.city as a, b.city as b, round(sqrt(sum((a.m - b.m) * (a.m - b.m) / a.k)), 6) as distance, round(sqrt(sum((a.m - b.m) * (a.m - b.m) / a.k)), 6) as mahalanobis from c a join c b on a.k = b.k and a.city < b.city group by a.city, b.city""")
def city_ground_distance(spark: SparkSession, d: str) -> DataFrame:
    """Weighted distances of the cities' mean features (20 cities): Euclidean with weights 1, 1/2, 1/3 ..., and by the same weights as a learned matrix."""
    import numpy as np

    flat = _z(spark, d).select("city", F.posexplode("z").alias("k", "z")).groupBy("city", "k").agg(F.avg("z").alias("m"))
    per = flat.groupBy("city").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda x: x["m"]).alias("v"))
    rows = per.orderBy("city").collect()
    if not rows:
        return spark.createDataFrame([], "a string, b string, distance double, mahalanobis double")
    x = np.array([r["v"] for r in rows])
    theta = 1 / np.arange(1, x.shape[1] + 1)
    d1, d2 = transport.euclidean(x, x, theta), transport.mahalanobis(np.diag(theta))(x, x)
    pairs = [(rows[i]["city"], rows[j]["city"], round(float(d1[i, j]), 6), round(float(d2[i, j]), 6)) for i in range(len(rows)) for j in range(i + 1, len(rows))]
    return spark.createDataFrame(pairs, "a string, b string, distance double, mahalanobis double")
