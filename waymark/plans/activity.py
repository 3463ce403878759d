"""Queries on the activity of venues, users and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import clock
from waymark.functions.text import folded
from waymark.operators import profiles as pr
from waymark.plans.common import P, T, V, shots, tagged, visits, with_
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


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


ENTROPY = "round(ln(sum(c)) - sum(c * ln(c)) / sum(c), 6)"


@query(with_(V) + f"""select lid, cast(sum(c) as bigint) as n, {ENTROPY} as entropy
from (select lid, uid, count(*) as c from v where lid is not null and uid is not null group by lid, uid) group by lid""")
def visitor_entropy(spark: SparkSession, d: str) -> DataFrame:
    return r6(pr.visitor_entropy(visits(spark, d, "lid", "uid"), "lid", "uid"), "entropy")


@query(with_(V) + """select lid, cast(sum(c) as bigint) as n, round((ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(24), 6) as entropy
from (select lid, extract(hour from t) as h, count(*) as c from v where lid is not null and t is not null group by lid, h) group by lid""")
def time_of_day_entropy(spark: SparkSession, d: str) -> DataFrame:
    return r6(pr.hour_entropy(visits(spark, d, "lid", "t"), "lid", "t"), "entropy")


@query(with_(V) + """, b as (select city, cast((isodow(t - interval 4 hour) - 1) * 3 + (hour(t - interval 4 hour) // 8) as int) as bin from v where city is not null and t is not null)
select city, bin, count(*) as n, round(count(*) / sum(count(*)) over (partition by city), 6) as share from b group by city, bin""")
def human_period_profile(spark: SparkSession, d: str) -> DataFrame:
    return r6(pr.week_profile(visits(spark, d, "city", "t"), ["city"], "t"), "share")


@query(with_(V) + """, b as (select lid, cast(((hour(t) + 23) % 24) // 4 as int) as bin from v where lid is not null and t is not null)
select lid, bin, count(*) as n, round(count(*) / sum(count(*)) over (partition by lid), 6) as share from b group by lid, bin""")
def activity_profile_4h(spark: SparkSession, d: str) -> DataFrame:
    return r6(pr.day_profile(visits(spark, d, "lid", "t"), ["lid"], "t"), "share")


@query(with_(V) + """, b as (select lid, case when (isodow(t) = 5 and hour(t) >= 20) or isodow(t) = 6 or (isodow(t) = 7 and hour(t) <= 20) then 1.0 else 0.0 end as w from v where lid is not null and t is not null)
select lid, count(*) as n, round(avg(w), 6) as share, avg(w) > 0.5 as weekend from b group by lid""")
def weekend_venues(spark: SparkSession, d: str) -> DataFrame:
    return r6(pr.weekend_share(visits(spark, d, "lid", "t"), "lid", "t"), "share")


_SPANS = with_(P) + """, s as (select uid, min(t) as first, max(t) as last, count(*) as n from p where uid is not null and t is not null group by uid),
u as (select *, epoch_us(last) // 1000000 - epoch_us(first) // 1000000 < 2629728 as tourist from s)
"""


@query(_SPANS + "select uid, first, last, n, tourist from u")
def user_span_status(spark: SparkSession, d: str) -> DataFrame:
    return pr.spans(shots(spark, d, "uid", "t"), "uid", "t")


@query(_SPANS + """select tourist, count(*) as users, cast(sum(n) as bigint) as photos, cast(floor(100.0 * count(*) / (select count(*) from u)) as int) as users_percent,
cast(floor(100.0 * sum(n) / (select sum(n) from u)) as int) as photos_percent, round(quantile_cont(n, 0.9), 6) as p90 from u group by tourist""")
def local_tourist_summary(spark: SparkSession, d: str) -> DataFrame:
    s = pr.spans(shots(spark, d, "uid", "t"), "uid", "t")
    out = s.groupBy("tourist").agg(F.count(F.lit(1)).alias("users"), F.sum("n").alias("photos"), F.expr("round(percentile(n, 0.9), 6)").alias("p90"))
    total = s.agg(F.count(F.lit(1)).alias("_u"), F.sum("n").alias("_p"))
    return out.join(F.broadcast(total)).select(
        "tourist", "users", "photos", F.floor(F.lit(100.0) * F.col("users") / F.col("_u")).cast("int").alias("users_percent"),
        F.floor(F.lit(100.0) * F.col("photos") / F.col("_p")).cast("int").alias("photos_percent"), "p90",
    )


@query(with_(T) + """, s as (select tag, count(*) as n, count(distinct uid) as users, min(t) as first, max(t) as last from g group by tag)
select tag, n, users, first, last, round((epoch_us(last) // 1000000 - epoch_us(first) // 1000000) / 86400.0, 6) as days from s""")
def tag_support(spark: SparkSession, d: str) -> DataFrame:
    return r6(pr.support(tagged(spark, d, "uid", "t"), "tag", "uid", "t"), "days")


@query(with_(T) + """, s as (select tag, count(*) as n, count(distinct uid) as users, (epoch_us(max(t)) // 1000000 - epoch_us(min(t)) // 1000000) / 86400.0 as days from g group by tag)
select tag, n, users, cast(ceil(days * 24) as bigint) as hours from s where n >= 150 and users >= 25 and days > 500""")
def supported_tags(spark: SparkSession, d: str) -> DataFrame:
    out = pr.supported(tagged(spark, d, "uid", "t"), "tag", "uid", "t")
    return out.select("tag", "n", "users", F.ceil(F.round(F.col("days") * 24, 6)).alias("hours"))


@query(with_(T) + "select tag, count(*) as n, cast(row_number() over (order by count(*) desc, tag) as int) as rank from g group by tag order by n desc, tag limit 100")
def tag_count_topk(spark: SparkSession, d: str) -> DataFrame:
    n = tagged(spark, d).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return pr.ranked(n, [F.col("n").desc(), F.col("tag")], 100)


@query(with_(T) + """, a as (select tag, count(*) as n, row_number() over (order by count(*) desc, tag) as r from g where year(t) = 2008 group by tag),
b as (select tag, count(*) as n, row_number() over (order by count(*) desc, tag) as r from g where year(t) = 2009 group by tag)
select b.tag, case when a.r is null then 'new' when a.r > b.r then '+' when a.r < b.r then '-' else '=' end as status, cast(a.r - b.r as int) as move, a.n as n_before, b.n as n_after,
b.n - a.n as change, round((b.n - a.n) / a.n, 6) as relative from b left join a on a.tag = b.tag and a.r <= 200 where b.r <= 200""")
def rank_movement(spark: SparkSession, d: str) -> DataFrame:
    by = tagged(spark, d, "t").withColumn("y", F.year("t")).groupBy("tag", "y").agg(F.count(F.lit(1)).alias("n"))
    return r6(pr.rank_movement(by.where("y = 2008").drop("y"), by.where("y = 2009").drop("y"), "tag", "n", 200), "relative")


@query(with_(T) + f""", k as (select tag, s as step, floor((epoch_us(t) // 1000000 - 1199145600) / 86400.0) as day from g, (select unnest([1, 7, 30, 91, 365]) as s) where t is not null),
c as (select tag, step, floor(day / step) as period, count(*) as c from k group by all)
select tag, step, cast(sum(c) as bigint) as n, {ENTROPY} as entropy from c group by tag, step""")
def period_entropy_scales(spark: SparkSession, d: str) -> DataFrame:
    return r6(pr.period_entropies(tagged(spark, d, "t"), "tag", "t"), "entropy")


@query(with_(T) + f"""select tag, cast(sum(c) as bigint) as n, {ENTROPY} as entropy
from (select tag, isodow(t), hour(t) // 4, count(*) as c from g where t is not null group by all) group by tag""")
def weekday_bucket_entropy(spark: SparkSession, d: str) -> DataFrame:
    return r6(pr.weekday_bucket_entropy(tagged(spark, d, "t"), "tag", "t"), "entropy")


@query(with_(T) + "select uid, count(*) as n from g where tag = 'bridgelover' and uid is not null group by uid")
def users_of_tag(spark: SparkSession, d: str) -> DataFrame:
    return tagged(spark, d, "uid").where("tag = 'bridgelover' and uid is not null").groupBy("uid").agg(F.count(F.lit(1)).alias("n"))


@query(with_(V) + """, a as (select lid, count(*) as n from v where lid is not null group by lid order by n desc, lid limit 50)
select lid, cast(((hour(t) + 23) % 24) // 3 as int) as bin, count(*) as n from v join a using (lid) where t is not null group by lid, bin""")
def venue_activity_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = visits(spark, d, "lid", "t").dropna(subset=["lid"])
    best = rows.groupBy("lid").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "lid").limit(50)
    return pr.histogram(rows.join(best, "lid", "left_semi"), ["lid"], clock.hour_chunk(F.col("t"), 3, 1))


@query("""with r as (select _id, lower(trim(cat)) as cat, max(coalesce(likes, 0)) as likes from venue where trim(cat) <> '' and _id is not null group by all),
u as (select id as cat, path[least(1, len(path))] as category from category),
s as (select category, count(*) as venues, cast(sum(likes) as bigint) as likes from r join u using (cat) group by category)
select s.category, c.name, venues, s.likes, round(venues / sum(venues) over (), 6) as share from s left join category c on c.id = s.category""")
def category_summary(spark: SparkSession, d: str) -> DataFrame:
    venues = table(spark, d, "venue").select("_id", folded(F.col("cat")).alias("cat"), F.coalesce("likes", F.lit(0)).alias("likes")).dropna()
    venues = venues.groupBy("_id", "cat").agg(F.max("likes").alias("likes"))
    return r6(pr.category_summary(venues, table(spark, d, "category"), 1), "share")


@query(with_(V, P) + """, n as (select city, 'checkins' as what, count(*) as n from v where city is not null group by city union all select city, 'photos', count(*) from p where city is not null group by city)
select coalesce(city, 'total') as city, cast(sum(case when what = 'checkins' then n end) as bigint) as checkins, cast(sum(case when what = 'photos' then n end) as bigint) as photos from n group by rollup (city)""")
def status_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = visits(spark, d, "city").select("city", F.lit(1).alias("c"), F.lit(0).alias("p"))
    rows = rows.unionByName(shots(spark, d, "city").select("city", F.lit(0).alias("c"), F.lit(1).alias("p"))).dropna()
    per = rows.groupBy("city").agg(F.sum("c").alias("c"), F.sum("p").alias("p"))
    out = per.rollup("city").agg(F.sum("c").alias("checkins"), F.sum("p").alias("photos"))
    return out.select(F.coalesce("city", F.lit("total")).alias("city"), F.nullif("checkins", F.lit(0)).alias("checkins"), F.nullif("photos", F.lit(0)).alias("photos"))


@query(with_(T) + """, q as (select tag, lng as x, lat as y from g where lng between -180 and 180 and lat between -90 and 90),
c as (select tag, count(*) as n, avg(x) as cx, avg(y) as cy from q group by tag),
o as (select q.tag, n, cx, cy, (x - cx) * (x - cx) + (y - cy) * (y - cy) as d2 from q join c using (tag))
select tag, n, round(cx + 1.3e-8, 6) as cx, round(cy + 1.3e-8, 6) as cy, round(avg(d2), 5) as mean_d2, round(stddev_pop(d2), 4) as std_d2 from o group by tag, n, cx, cy""")
def gravity_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = tagged(spark, d, "lng", "lat").where("lng between -180 and 180 and lat between -90 and 90")
    out = pr.gravity(rows, "tag", "lng", "lat")
    # the shift keeps means of six-digit values away from rounding ties
    out = out.withColumns({c: F.round(F.col(c) + 1.3e-8, 6) for c in ("cx", "cy")})
    return out.withColumns({"mean_d2": F.round("mean_d2", 5), "std_d2": F.round("std_d2", 4)})


@query(with_(P) + """, h as (select round(lng, 3) as lng, round(lat, 3) as lat, count(*) as n from p where lng is not null and lat is not null group by all order by n desc, lng, lat limit 300)
select lng, lat, n, max(n) over () as most from h""")
def heat_dataset(spark: SparkSession, d: str) -> DataFrame:
    rows = shots(spark, d, "lng", "lat").dropna().select(F.round("lng", 3).alias("lng"), F.round("lat", 3).alias("lat"))
    best = rows.groupBy("lng", "lat").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lng", "lat").limit(300)
    return best.withColumn("most", F.max("n").over(Window.partitionBy()))


@query(with_(V) + "select city, floor((epoch_us(t) // 1000000 - 1199145600) / 1209600.0)::bigint + 1 as cell, count(*) as n from v where city is not null and t is not null group by all")
def fortnight_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = visits(spark, d, "city", "t").dropna()
    return rows.groupBy("city", clock.time_cell(F.col("t")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@query(with_(P) + """select case when month(t - interval 14 day) in (12, 1, 2) then 'winter' when month(t - interval 14 day) in (3, 4, 5) then 'spring'
 when month(t - interval 14 day) in (6, 7, 8) then 'summer' else 'fall' end as season, count(*) as n from p where t >= '2008-03-15' and t < '2012-03-15' group by season""")
def season_counts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("t")
    rows = shots(spark, d, "t").where((t >= F.lit("2008-03-15").cast("timestamp_ntz")) & (t < F.lit("2012-03-15").cast("timestamp_ntz")))
    season = F.coalesce(*[F.when(clock.in_season(t, s, 2007, 2012), F.lit(s)) for s in ("winter", "spring", "summer", "fall")])
    return rows.groupBy(season.alias("season")).agg(F.count(F.lit(1)).alias("n"))


@query("""select c.city, strftime(t, '%Y-%m-%d %H') as utc_hour, count(*) as n from (select distinct _id, nullif(regexp_replace(lower(city), '[^a-z]', '', 'g'), '') as city, "time" as lt from checkin where _id is not null) v
join city_box c on c.city = v.city, lateral (select lt - interval 1 minute * utc_offset_min as t) where lt is not null group by all""")
def utc_hours(spark: SparkSession, d: str) -> DataFrame:
    rows = visits(spark, d, "city", "t").join(table(spark, d, "city_box").select("city", "utc_offset_min"), "city").dropna()
    zone = F.format_string("%s%02d:%02d", F.when(F.col("utc_offset_min") < 0, "-").otherwise("+"), F.floor(F.abs("utc_offset_min") / 60).cast("int"), F.abs("utc_offset_min") % 60)
    return rows.groupBy("city", F.substring(clock.to_utc(F.col("t"), zone).cast("string"), 1, 13).alias("utc_hour")).agg(F.count(F.lit(1)).alias("n"))

