"""Queries on grids, scans, balls and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.functions.clock import hour_chunk
from waymark.functions.text import letters
from waymark.operators import grids, proximity, scan
from waymark.operators.profiles import pair_moments
from waymark.plans.activity import r6
from waymark.plans.common import L, P, T, V, places, shots, tagged, visits, with_
from waymark.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}
K = 20
# Radius of a surrounding in metres and the scale of its weights, exp(-d^2 / scale).
RADIUS_M = 350.0
SCALE = 112_000.0


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _cells_sql(source: str, k: int, extra: str = "") -> str:
    return f"""select city, {extra} cast(least({k - 1}, floor((lng - lng_bl) / (lng_ur - lng_bl) * {k})) as int) as ix, cast(least({k - 1}, floor((lat - lat_bl) / (lat_ur - lat_bl) * {k})) as int) as iy
from {source} join city_box using (city) where lng between lng_bl and lng_ur and lat between lat_bl and lat_ur"""


def _freq(spark: SparkSession, d: str, what, k: int) -> DataFrame:
    return grids.frequency(grids.placed(what(spark, d, "city", "lng", "lat"), table(spark, d, "city_box"), "city", k), ["city"])


@query(with_(P) + f", c as ({_cells_sql('p', 200)}) select city, ix, iy, count(*) as n from c group by all")
def grid_frequency(spark: SparkSession, d: str) -> DataFrame:
    return _freq(spark, d, shots, 200)


@query(with_(P) + f", c as ({_cells_sql('p', 200)}) select city, ix // 2 as ix, iy // 2 as iy, count(*) as n from c group by all")
def grid_coarsened(spark: SparkSession, d: str) -> DataFrame:
    return grids.coarser(_freq(spark, d, shots, 200), ["city"])


@query(with_(V) + f""", c as ({_cells_sql('v', K)}), f as (select city, ix, iy, count(*) as n from c group by all),
a as (select city, x as ix, y as iy from (select distinct city from f), range({K}) r(x), range({K}) s(y))
select a.city, cast(a.ix as int) as ix, cast(a.iy as int) as iy, coalesce(n, 0) as n from a left join f on f.city = a.city and f.ix = a.ix and f.iy = a.iy""")
def grid_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    return grids.zero_filled(_freq(spark, d, visits, K), ["city"], K)


@query(with_(T) + f""", c as ({_cells_sql('g', 50, 'tag,')}), f as (select city, tag, ix, iy, count(*) as c from c group by all)
select city, tag, cast(sum(c) as bigint) as n, round((ln(sum(c)) - sum(c * ln(c)) / sum(c)) / (2 * ln(50)), 6) as entropy from f group by city, tag""")
def tag_grid_entropy(spark: SparkSession, d: str) -> DataFrame:
    cells = grids.placed(tagged(spark, d, "city", "lng", "lat"), table(spark, d, "city_box"), "city", 50)
    return r6(grids.concentration(grids.frequency(cells, ["city", "tag"]), ["city", "tag"], 50), "entropy")


@query(with_(T, P) + f""", c as ({_cells_sql('g', 50, 'tag,')}), f as (select city, tag, ix, iy, count(*) as t from c group by all),
e as ({_cells_sql('p', 50)}), b as (select city, ix, iy, count(*) as b from e group by all), s as (select city, sum(b) as total, min(b) as least from b group by city),
j as (select f.city, f.tag, t, b, total, least, sum(t) over (partition by f.city, f.tag) as tt from f join b using (city, ix, iy) join s using (city))
select city, tag, cast(sum(t) as bigint) as n, round(sum(t * ln(t / b)) / any_value(tt) + ln(any_value(total) / any_value(tt)), 6) as kl, round(-ln(any_value(least) / any_value(total)), 6) as most from j group by city, tag""")
def tag_kl_background(spark: SparkSession, d: str) -> DataFrame:
    boxes = table(spark, d, "city_box")
    cells = grids.frequency(grids.placed(tagged(spark, d, "city", "lng", "lat"), boxes, "city", 50), ["city", "tag"])
    return r6(grids.divergence(cells, _freq(spark, d, shots, 50), ["city"], "tag"), "kl", "most")


_TWO = with_(V, P) + f""", cp as ({_cells_sql('p', K)}), cv as ({_cells_sql('v', K)}),
two as (select city, ix, iy, sum(m) as m, sum(b) as b from (select city, ix, iy, 1 as m, 0 as b from cp union all select city, ix, iy, 0, 1 from cv) group by all)
"""


def _two(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    return grids.both(_freq(spark, d, shots, k), _freq(spark, d, visits, k), ["city"])


@query(_TWO + """, r as (select city, b / m as r from two where m > 0 and b > 0), l as (select city, quantile_cont(r, 0.05) as lo, quantile_cont(r, 0.95) as hi from r group by city)
select city, count(*) as cells, round(avg(r), 6) as ratio from r join l using (city) where r between lo and hi group by city""")
def trimmed_mean_ratio(spark: SparkSession, d: str) -> DataFrame:
    return r6(grids.trimmed_ratio(_two(spark, d), ["city"]), "ratio")


@query(_TWO + """, a as (select city, ix, iy, m from two where m > 0 and b < 1), l as (select city, quantile_cont(m, 0.995) as p from a group by city),
r as (select a.*, row_number() over (partition by city order by m desc, ix, iy) as r from a join l using (city) where m >= p)
select city, ix, iy, cast(m as bigint) as m from r where r <= 500""")
def standalone_cells(spark: SparkSession, d: str) -> DataFrame:
    return grids.stand_alone(_two(spark, d), ["city"])


@query(_TWO + """, q as (select city, ix, iy, cast(m as bigint) as m, cast(b as bigint) as b, round(ln((m / sum(m) over (partition by city)) / (b / sum(b) over (partition by city))), 6) as log_ratio from two)
select * from q where m > 0 and b > 0""")
def log_ratio_cells(spark: SparkSession, d: str) -> DataFrame:
    two = _two(spark, d)
    total = two.groupBy("city").agg(F.sum("m").alias("tm"), F.sum("b").alias("tb"))
    rows = two.join(total, "city").where("m > 0 and b > 0")
    ratio = F.log((F.col("m") / F.col("tm")) / (F.col("b") / F.col("tb")))
    return rows.select("city", "ix", "iy", "m", "b", F.round(ratio, 6).alias("log_ratio"))


_SCAN = _TWO + f""", ax as (select city, cast(x as int) as x, cast(y as int) as y from (select distinct city from two), range(-1, {K}) r(x), range(-1, {K}) s(y)),
z as (select ax.city, x, y, coalesce(m, 0) as m, coalesce(b, 0) as b from ax left join two on two.city = ax.city and ix = x and iy = y),
s1 as (select city, x, y, sum(m) over (partition by city, x order by y) as m, sum(b) over (partition by city, x order by y) as b from z),
s2 as materialized (select city, x, y, sum(m) over (partition by city, y order by x) as m, sum(b) over (partition by city, y order by x) as b from s1),
tot as (select city, m as tm, b as tb from s2 where x = {K - 1} and y = {K - 1}),
rc as (select a.city, a.x + 1 as x0, b.x as x1, a.y + 1 as y0, b.y as y1, b.m - c.m - e.m + a.m as m, b.b - c.b - e.b + a.b as b
 from s2 a join s2 b on b.city = a.city and b.x - a.x between 1 and 4 and b.y - a.y between 1 and 4 join s2 c on c.city = a.city and c.x = a.x and c.y = b.y join s2 e on e.city = a.city and e.x = b.x and e.y = a.y),
st as (select rc.*, tm, tb, m / tm as pm, b / tb as pb from rc join tot using (city) where m >= 20 and b >= 20),
v as (select *, round(pm * ln(pm / pb) + case when pm < 1 then (1 - pm) * ln((1 - pm) / (1 - pb)) else 0 end, 9) as value from st where pm > pb and pb < 1),
k as (select *, row_number() over (partition by city order by value desc, x0, y0, x1, y1) as rank from v)
"""


@query(_SCAN.replace("v as (select *, round", "vv as (select *, round").replace("from v)\n", "from vv)\n") + "select city, cast(rank as int) as rank, round(value, 6) as value, x0, x1, y0, y1, cast(m as bigint) as m, cast(b as bigint) as b from k where rank <= 50")
def spatial_scan_topk(spark: SparkSession, d: str) -> DataFrame:
    return r6(scan.rectangles(_two(spark, d), ["city"], K, 4, 20, 50), "value")


@query()
def spatial_scan_merged(spark: SparkSession, d: str) -> DataFrame:
    """Merged best regions of each city on a 100 x 100 grid, sides up to a fifth."""
    return scan.merge(scan.rectangles(_two(spark, d, 100), ["city"], 100, 20, 40, 200), ["city"], 100)


@query(with_(V) + """select v.city, c.city as found, count(*) as n from v left join city_box c on lat between lat_bl and lat_ur and lng between lng_bl and lng_ur
where lng is not null and lat is not null group by all""")
def city_range_join(spark: SparkSession, d: str) -> DataFrame:
    """The city box of every check-in position beside its stated city; boxes are a fixed table."""
    box = table(spark, d, "city_box").select(F.col("city").alias("found"), "lat_bl", "lng_bl", "lat_ur", "lng_ur")
    rows = visits(spark, d, "city", "lng", "lat").dropna(subset=["lng", "lat"])
    inside = F.col("lat").between(F.col("lat_bl"), F.col("lat_ur")) & F.col("lng").between(F.col("lng_bl"), F.col("lng_ur"))
    return rows.join(box, inside, "left").groupBy("city", "found").agg(F.count(F.lit(1)).alias("n"))


_DIST = "2 * 6371008.8 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))"


@query(with_(L) + f""", q as (select l.id, lng, lat, path[1] as top from l join category c on c.id = l.cat where lng between -180 and 180 and lat between -90 and 90),
j as (select a.id as venue, b.top as top, {_DIST} as m from q a join q b on b.lat between a.lat - 0.0032 and a.lat + 0.0032),
s as (select venue, top, sum(exp(-m * m / 112000)) as w, count(*) as near from j where m <= 350 group by all)
select venue, c.name as category, near, round(w / sum(w) over (partition by venue), 6) as share from s join category c on c.id = top""")
def category_surroundings(spark: SparkSession, d: str) -> DataFrame:
    """Gaussian-weighted shares of the top categories within 350 m of each venue."""
    cats = table(spark, d, "category")
    rows = places(spark, d, "cat", "lng", "lat").join(cats.select(F.col("id").alias("cat"), F.get("path", 0).alias("top")), "cat")
    tops = {r["id"]: (i, r["name"]) for i, r in enumerate(cats.where("depth = 1").orderBy("id").select("id", "name").collect())}
    code = F.create_map(*[F.lit(x) for t, (i, _) in tops.items() for x in (t, i)])
    points = rows.select("lng", "lat", F.try_element_at(code, F.col("top")).alias("bin"), F.lit(1).alias("n"))
    sums = proximity.ball_sums(rows.select(F.col("id").alias("key"), "lng", "lat"), points, RADIUS_M, SCALE)
    total = sums.groupBy("key").agg(F.sum("weight").alias("_w"))
    name = F.array(*[F.lit(n) for _, n in tops.values()])
    return sums.join(total, "key").select(F.col("key").alias("venue"), F.get(name, F.col("bin")).alias("category"), "near", F.round(F.col("weight") / F.col("_w"), 6).alias("share"))


@query(with_(L, P, V) + f""", q as (select * from l where lng between -180 and 180 and lat between -90 and 90),
o as (select 'photo' as k, lng, lat from p where lng is not null union all select 'checkin', lng, lat from v where lng is not null),
j as (select a.id as venue, k, {_DIST} as m from q a join o b on b.lat between a.lat - 0.0032 and a.lat + 0.0032),
s as (select venue, coalesce(sum(case when k = 'photo' then exp(-m * m / 112000) end), 0) as pw, coalesce(sum(case when k = 'checkin' then exp(-m * m / 112000) end), 0) as cw, count(case when k = 'photo' then 1 end) as photos, count(case when k = 'checkin' then 1 end) as checkins from j where m <= 350 group by venue)
select venue, photos, checkins, round(case when cw > 0 then pw / cw end, 5) as photogenicity from s""")
def photo_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Weighted photos over weighted check-ins within 350 m of each venue."""
    centres = places(spark, d, "lng", "lat").select(F.col("id").alias("key"), "lng", "lat")
    points = shots(spark, d, "lng", "lat").select("lng", "lat", F.lit(0).alias("bin"), F.lit(1).alias("n"))
    points = points.unionByName(visits(spark, d, "lng", "lat").select("lng", "lat", F.lit(1).alias("bin"), F.lit(1).alias("n")))
    s = proximity.ball_sums(centres, points, RADIUS_M, SCALE)
    of = lambda c, b: F.coalesce(F.sum(F.when(F.col("bin") == b, F.col(c))), F.lit(0))
    out = s.groupBy(F.col("key").alias("venue")).agg(of("near", 0).alias("photos"), of("near", 1).alias("checkins"), of("weight", 0).alias("p"), of("weight", 1).alias("c"))
    return out.select("venue", "photos", "checkins", F.round(F.when(F.col("c") > 0, F.col("p") / F.col("c")), 5).alias("photogenicity"))


@query(with_(L, V) + f""", q as (select * from l where lng between -180 and 180 and lat between -90 and 90),
j as (select a.id as venue, cast(((hour(b.t) + 23) % 24) // 4 as int) as bin, {_DIST} as m from q a join v b on b.lat between a.lat - 0.0032 and a.lat + 0.0032 where b.t is not null and b.lng is not null),
s as (select venue, bin, sum(exp(-m * m / 112000)) as w from j where m <= 350 group by all)
select venue, bin, round(w / sum(w) over (partition by venue), 6) as share from s""")
def surrounding_activity(spark: SparkSession, d: str) -> DataFrame:
    """Weighted activity in 4-hour slices within 350 m of each venue."""
    centres = places(spark, d, "lng", "lat").select(F.col("id").alias("key"), "lng", "lat")
    points = visits(spark, d, "lng", "lat", "t").select("lng", "lat", hour_chunk(F.col("t"), 4, 1).alias("bin"), F.lit(1).alias("n"))
    s = proximity.ball_sums(centres, points, RADIUS_M, SCALE)
    total = s.groupBy("key").agg(F.sum("weight").alias("_w"))
    return s.join(total, "key").select(F.col("key").alias("venue"), "bin", F.round(F.col("weight") / F.col("_w"), 6).alias("share"))


@query(with_(L) + f""", q as (select * from l where lng between -180 and 180 and lat between -90 and 90),
j as (select a.id as venue, {_DIST} as m from q a join q b on b.lat between a.lat - 0.0081 and a.lat + 0.0081),
s as (select venue, count(*) as near, sum(exp(-m * m / 61250)) as w from j where m <= 875 group by venue)
select venue, near, round(w / max(w) over (), 6) as density from s""")
def venue_density(spark: SparkSession, d: str) -> DataFrame:
    """Gaussian kernel density of venues, bandwidth 175 m cut at five bandwidths, over the densest venue's."""
    rows = places(spark, d, "lng", "lat")
    points = rows.select("lng", "lat", F.lit(0).alias("bin"), F.lit(1).alias("n"))
    s = proximity.ball_sums(rows.select(F.col("id").alias("key"), "lng", "lat"), points, 875.0, 2 * 175.0**2)
    most = s.agg(F.max("weight").alias("_m"))
    return s.join(F.broadcast(most)).select(F.col("key").alias("venue"), "near", F.round(F.col("weight") / F.col("_m"), 6).alias("density"))


PEAK_CELLS = 128


@query(with_(L) + f""", q as materialized (select * from l where lng between -180 and 180 and lat between -90 and 90),
ends as (select c.city, min(lng) as x0, max(lng) as x1, min(lat) as y0, max(lat) as y1 from q join city_box c on lat between lat_bl and lat_ur and lng between lng_bl and lng_ur group by c.city),
a as (select city, x0 + (x1 - x0) * i / 127 as lng, y0 + (y1 - y0) * j / 127 as lat from ends, range(0, 128) r(i), range(0, 128) s(j)),
j as (select city, a.lng, a.lat, {_DIST} as m from a join q b on floor(a.lat * 100) - floor(b.lat * 100) between -1 and 1 and b.lat between a.lat - 0.0081 and a.lat + 0.0081),
k as (select city, lng, lat, sum(exp(-m * m / 61250)) as w from j where m <= 875 group by city, lng, lat) select city, round(max(w), 6) as peak from k group by city""")
def density_peak(spark: SparkSession, d: str) -> DataFrame:
    """The greatest kernel density of venues on a grid of 128 x 128 points over each city's venues, unnormalised."""
    rows = places(spark, d, "lng", "lat")
    box = table(spark, d, "city_box").select("city", "lat_bl", "lng_bl", "lat_ur", "lng_ur")
    inside = F.col("lat").between(F.col("lat_bl"), F.col("lat_ur")) & F.col("lng").between(F.col("lng_bl"), F.col("lng_ur"))
    ends = rows.join(box, inside).groupBy("city").agg(*[f(c).alias(f"{n}{c}") for c in ("lng", "lat") for n, f in (("lo", F.min), ("hi", F.max))])
    steps = F.sequence(F.lit(0), F.lit(PEAK_CELLS - 1))
    grid = ends.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    at = lambda c, k: F.col(f"lo{c}") + (F.col(f"hi{c}") - F.col(f"lo{c}")) * F.col(k) / (PEAK_CELLS - 1)
    centres = grid.select(F.struct("city", "i", "j").alias("key"), at("lng", "i").alias("lng"), at("lat", "j").alias("lat"))
    centres = centres.withColumn("key", F.concat_ws("/", "key.city", "key.i", "key.j"))
    points = rows.select("lng", "lat", F.lit(0).alias("bin"), F.lit(1).alias("n"))
    sums = proximity.ball_sums(proximity.on_shared_tiles(centres, points, 875.0), points, 875.0, 2 * 175.0**2)
    return sums.groupBy(F.split_part("key", F.lit("/"), F.lit(1)).alias("city")).agg(F.round(F.max("weight"), 6).alias("peak"))


@query(with_(L) + """, q as (select id, cat, lng, lat from l where cat is not null and lng is not null and lat is not null)
select a.cat, count(*) as pairs, round(avg(pow(a.lng - b.lng, 2) + pow(a.lat - b.lat, 2)), 6) as mean_d2 from q a join q b on a.cat = b.cat and (a.id, a.lng, a.lat) < (b.id, b.lng, b.lat) group by a.cat""")
def category_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The mean squared distance, in degrees, of all pairs of venues of one category."""
    rows = places(spark, d, "cat", "lng", "lat")
    return pair_moments(rows, "cat", "lng", "lat").select("cat", "pairs", F.round("mean_d2", 6).alias("mean_d2"))


@query("""with q as (select distinct _id as venue, loc.lng as x1, loc.lat as y1, (lat_bl + lat_ur) / 2 as y2, (lng_bl + lng_ur) / 2 as x2 from venue v
 join city_box c on c.city = nullif(regexp_replace(lower(v.city), '[^a-z]', '', 'g'), '') where _id is not null and loc.lng between -180 and 180 and loc.lat between -90 and 90),
r as (select *, radians((y1 + y2) / 2) as f, radians((y1 - y2) / 2) as g, radians((x1 - x2) / 2) as h from q),
s as (select *, pow(sin(g) * cos(h), 2) + pow(cos(f) * sin(h), 2) as s, pow(cos(g) * cos(h), 2) + pow(sin(f) * sin(h), 2) as c from r),
w as (select *, atan(sqrt(s / c)) as w, sqrt(s * c) / atan(sqrt(s / c)) as r from s where s > 0)
select venue, round(2 * w * 6378137.0 * (1 + (3 * r - 1) / (2 * c) / 298.257223563 * pow(sin(f) * cos(g), 2) - (3 * r + 1) / (2 * s) / 298.257223563 * pow(cos(f) * sin(g), 2)), 3) as metres from w""")
def geodesic_to_centre(spark: SparkSession, d: str) -> DataFrame:
    """Metres along the ellipsoid from each venue to the middle of its city's box."""
    v = table(spark, d, "venue").select(F.col("_id").alias("venue"), letters(F.col("city")).alias("city"), F.col("loc.lng").alias("lng"), F.col("loc.lat").alias("lat"))
    v = proximity.located(v.dropna()).join(table(spark, d, "city_box"), "city")
    metres = geo.geodesic_m(F.col("lng"), F.col("lat"), (F.col("lng_bl") + F.col("lng_ur")) / 2, (F.col("lat_bl") + F.col("lat_ur")) / 2)
    return v.select("venue", F.round(metres, 3).alias("metres")).where("metres > 0").distinct()


@query("""with q as (select distinct _id as venue, loc.lng as lng, loc.lat as lat, (lat_bl + lat_ur) / 2 as lat0, (lng_bl + lng_ur) / 2 as lng0 from venue v
 join city_box c on c.city = nullif(regexp_replace(lower(v.city), '[^a-z]', '', 'g'), '') where _id is not null and loc.lng between -180 and 180 and loc.lat between -90 and 90),
n as (select *, 6378137.0 as a, 1 / 298.257223563 as f from q), e as (select *, f * (2 - f) as e2 from n),
g as (select *, a / sqrt(1 - e2 * pow(sin(radians(lat)), 2)) as r1, a / sqrt(1 - e2 * pow(sin(radians(lat0)), 2)) as r0 from e),
h as (select *, r1 * cos(radians(lat)) * cos(radians(lng)) - r0 * cos(radians(lat0)) * cos(radians(lng0)) as dx, r1 * cos(radians(lat)) * sin(radians(lng)) - r0 * cos(radians(lat0)) * sin(radians(lng0)) as dy,
 r1 * (1 - e2) * sin(radians(lat)) - r0 * (1 - e2) * sin(radians(lat0)) as dz from g)
select venue, round(-sin(radians(lng0)) * dx + cos(radians(lng0)) * dy, 3) as east, round(-sin(radians(lat0)) * cos(radians(lng0)) * dx - sin(radians(lat0)) * sin(radians(lng0)) * dy + cos(radians(lat0)) * dz, 3) as north from h""")
def local_projection(spark: SparkSession, d: str) -> DataFrame:
    """Metres east and north of the centre of the venue's city."""
    v = table(spark, d, "venue").select(F.col("_id").alias("venue"), letters(F.col("city")).alias("city"), F.col("loc.lng").alias("lng"), F.col("loc.lat").alias("lat"))
    v = proximity.located(v.dropna()).join(table(spark, d, "city_box"), "city")
    east, north = geo.local_xy(F.col("lat"), F.col("lng"), (F.col("lat_bl") + F.col("lat_ur")) / 2, (F.col("lng_bl") + F.col("lng_ur")) / 2)
    return v.select("venue", F.round(east, 3).alias("east"), F.round(north, 3).alias("north")).distinct()


#: The survey's scan (SPA-04): cells per side, longest side of a rectangle, rectangles kept of each tag.
SCAN_K, SCAN_SIDE, SCAN_TOP = 80, 20, 2_000


def _tag_regions(spark: SparkSession, d: str, top: int, city: str | None = None) -> DataFrame:
    """The best rectangles of every tag of a city (of one city, if named) against all its photos; the support follows the tag's total."""
    boxes = table(spark, d, "city_box")
    boxes = boxes.where(F.col("city") == city) if city else boxes
    tags = grids.frequency(grids.placed(tagged(spark, d, "city", "lng", "lat"), boxes, "city", SCAN_K), ["city", "tag"])
    known = tags.groupBy("city", "tag").agg(F.sum("n").alias("_t")).where("_t >= 20").select("city", "tag")
    every = _freq(spark, d, shots, SCAN_K).join(known, "city")
    two = grids.both(tags.join(known, ["city", "tag"], "left_semi"), every, ["city", "tag"])
    return scan.rectangles(two, ["city", "tag"], SCAN_K, SCAN_SIDE, None, top, stripes=1)


_TAG_SCAN = with_(T, P) + f""", ct as ({_cells_sql('g', SCAN_K, 'tag,')}), cp as ({_cells_sql('p', SCAN_K)}),
tm as (select city, tag, ix, iy, count(*) as m from ct group by all), tt as (select city, tag, sum(m) as total from tm group by city, tag having sum(m) >= 20), bm as (select city, ix, iy, count(*) as b from cp group by all),
ax as (select city, tag, cast(x as int) as x, cast(y as int) as y from tt, range(-1, {SCAN_K}) r(x), range(-1, {SCAN_K}) s(y)),
z as (select ax.city, ax.tag, x, y, coalesce(m, 0) as m, coalesce(b, 0) as b from ax left join tm on tm.city = ax.city and tm.tag = ax.tag and tm.ix = x and tm.iy = y left join bm on bm.city = ax.city and bm.ix = x and bm.iy = y),
s1 as (select city, tag, x, y, sum(m) over (partition by city, tag, x order by y) as m, sum(b) over (partition by city, tag, x order by y) as b from z),
s2 as materialized (select city, tag, x, y, sum(m) over (partition by city, tag, y order by x) as m, sum(b) over (partition by city, tag, y order by x) as b from s1),
col as materialized (select a.city, a.tag, a.x + 1 as x0, b.x as x1, a.y, b.m - a.m as m, b.b - a.b as b from s2 a join s2 b on b.city = a.city and b.tag = a.tag and b.y = a.y and b.x - a.x between 1 and {SCAN_SIDE}),
tot as (select city, tag, m as tm, b as tb, case when m <= 500 then 20 when m <= 2000 then 40 else 250 end as least from s2 where x = {SCAN_K - 1} and y = {SCAN_K - 1}),
rc as (select a.city, a.tag, a.x0, a.x1, a.y + 1 as y0, b.y as y1, b.m - a.m as m, b.b - a.b as b from col a join col b on b.city = a.city and b.tag = a.tag and b.x0 = a.x0 and b.x1 = a.x1 and b.y - a.y between 1 and {SCAN_SIDE} where b.m - a.m >= 20 and b.b - a.b >= 20),
st as (select rc.*, m / tm as pm, b / tb as pb from rc join tot using (city, tag) where m >= least and b >= least),
v as (select *, round(pm * ln(pm / pb) + case when pm < 1 then (1 - pm) * ln((1 - pm) / (1 - pb)) else 0 end, 9) as value from st where pm > pb and pb < 1),
k as (select *, row_number() over (partition by city, tag order by value desc, x0, y0, x1, y1) as rank from v)
"""


@query(_TAG_SCAN + "select city, tag, round(value, 6) as value, x0, x1, y0, y1, cast(m as bigint) as m, cast(b as bigint) as b from k where rank = 1")
def tag_scan_best(spark: SparkSession, d: str) -> DataFrame:
    """The most unusual region of every tag with at least twenty photos in a city, best tags first; cells of an 80 x 80 grid."""
    best = _tag_regions(spark, d, 1).select("city", "tag", F.round("value", 6).alias("value"), "x0", "x1", "y0", "y1", "m", "b")
    return best.orderBy(F.desc("value"), "city", "tag")


@query()
def tags_of_centre(spark: SparkSession, d: str) -> DataFrame:
    """Tags of the largest city of which a merged region covers most of the middle tenth of each side."""
    merged = scan.merge(_tag_regions(spark, d, SCAN_TOP, "vellmare"), ["tag"], SCAN_K)
    near = range(SCAN_K // 2 - SCAN_K // 20, SCAN_K // 2 + SCAN_K // 20)
    return scan.tags_of_area(merged, "tag", [(x, y) for x in near for y in near]).withColumn("value", F.round("value", 6))


@query()
def tags_by_area(spark: SparkSession, d: str) -> DataFrame:
    """For each tenth by tenth of a city's box the tags of which a merged region covers more than 0.6 of it, with the best value."""
    merged = scan.merge(_tag_regions(spark, d, SCAN_TOP), ["city", "tag"], SCAN_K)
    side = SCAN_K // 10
    cells = merged.select("city", "tag", "region_no", "value", F.explode("cells").alias("c"))
    area = [F.floor(F.col(f"c.{c}") / side).cast("int").alias(f"area_{c}") for c in "xy"]
    covered = cells.groupBy("city", "tag", "region_no", "value", *area).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 0.6 * side * side)
    return covered.groupBy("city", "area_x", "area_y", "tag").agg(F.round(F.max("value"), 6).alias("value"))
