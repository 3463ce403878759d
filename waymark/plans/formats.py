"""Queries through the readers and writers: what is written is read again and compared with its source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import clock
from waymark.functions.text import folded, letters
from waymark.lineage import cut, scratch
from waymark.operators import profiles as pr
from waymark.operators import records as rec
from waymark.plans.common import L, P, T, V, places, shots, tagged, visits, with_
from waymark.sinks import writers
from waymark.sources import paged, parse, readers
from waymark.sources.tables import table
from waymark.streaming import ingest

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


_CLEAN = r"regexp_replace({}, '[\t\n\r]', ' ', 'g')"


@query(f"""select distinct uid, tid, loc.lat as lat, loc.lng as lng, {_CLEAN.format("coalesce(msg, '')")} as text from checkin
where uid is not null and loc.lat is not null and loc.lng is not null""".replace("tid,", "coalesce(tid, '') as tid,"))
def checkin_lines(spark: SparkSession, d: str) -> DataFrame:
    """Check-ins as tab-separated lines of seven fields, with lines of other lengths between them, read again."""
    field = lambda c: F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\t\n\r]", " ")
    made = ["uid", "tid", "loc.lat", "loc.lng", "time", "msg", "place"]
    lines = table(spark, d, "checkin").select(F.array(*[field(F.col(c)) for c in made]).alias("f"))
    whole, short = F.array_join("f", "\t"), F.array_join(F.slice("f", 1, 5), "\t")
    out = scratch(spark, "lines")
    lines.select(F.explode(F.array(whole, short)).alias("value")).write.text(out)
    return readers.checkin_lines(spark, out).select("uid", "tid", "lat", "lng", "text").distinct()


_WORD = "nullif(trim(regexp_replace({}, '[;\\s]+', ' ', 'g')), '')"


@query(f"""select _id, {_WORD.format("name")} as name, lower(trim(city)) as city, "checkinsCount", likes, mayor, closed, loc.lng as lng, loc.lat as lat, cast(coalesce(len(list_filter(cats, lambda c: c <> '')), 0) as int) as cats
from venue where _id is not null and lower(trim(city)) in (select city from city_box)""")
def venue_files(spark: SparkSession, d: str) -> DataFrame:
    """Venues as semicolon-separated files without quotes, one folder per city letter, read again through a glob."""
    v = table(spark, d, "venue").where(F.col("_id").isNotNull())
    plain = F.trim(F.regexp_replace("name", r"[;\s]+", " "))
    columns = {
        "vid": F.col("_id"), "name": plain, "city": F.col("city"), **{c: F.col(c) for c in ("checkinsCount", "likes", "usersCount", "tipCount", "price", "mayor", "rating", "closed")},
        "likers": F.array_join(F.transform("likers", lambda x: x.cast("string")), ","), "tags": F.lit(""), "cats": F.array_join("cats", ","), "createdAt": F.lit(""),
        "lon,lat": F.when(F.col("loc.lng").isNotNull() & F.col("loc.lat").isNotNull(), F.concat_ws(",", "loc.lng", "loc.lat")),
    }
    out = scratch(spark, "venues")
    made = v.select(*[c.cast("string").alias(n) for n, c in columns.items()], F.coalesce(F.substring("city", 1, 1), F.lit("-")).alias("part"))
    made.write.partitionBy("part").option("sep", ";").option("quote", "").option("emptyValue", "").option("header", True).csv(out)
    cities = [r[0] for r in table(spark, d, "city_box").select("city").collect()]
    back = readers.venue_csv(spark, f"{out}/part=*", cities)
    return back.select("_id", "name", "city", "checkinsCount", "likes", "mayor", "closed", F.col("loc.lng").alias("lng"), F.col("loc.lat").alias("lat"), F.size("cats").alias("cats"))


@query("""select _id as old, min(trim("shortUrl")) as new from venue where trim("shortUrl") <> '' and "shortUrl" not like '%;%' and _id is not null group by _id""")
def translation_file(spark: SparkSession, d: str) -> DataFrame:
    """Venue ids and their short links as ``old;new`` lines, with others between them, read again."""
    v = table(spark, d, "venue").select("_id", F.trim("shortUrl").alias("u")).where("_id is not null and u <> ''")
    out = scratch(spark, "translations")
    v.select(F.explode(F.array(F.concat_ws(";", "_id", "u"), F.col("_id"))).alias("value")).write.text(out)
    return readers.translations(spark, out)


@query("""select _id, strftime("time", '%Y-%m-%dT%H:%M:%SZ') as at, case when nullif(regexp_replace(lower(city), '[^a-z]', '', 'g'), '') = 'vellmare' then 'local' else 'outside' end as part
from checkin where "time" is not null and _id is not null""")
def dated_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Check-ins as JSON lines with wrapped dates, in folders of local and outside ones, read again."""
    rows = table(spark, d, "checkin").where("time is not null and _id is not null").select("_id", "city", "time")
    out = scratch(spark, "json")
    made = rows.select("_id", "city", writers.dated_json(rows, "time").alias("doc"))
    writers.write_json_lines(made, out, F.coalesce(letters(F.col("city")) == "vellmare", F.lit(False)))
    back = spark.read.schema("_id string, doc string, part string").json(out)
    return back.select("_id", F.get_json_object("doc", "$.time.$date").alias("at"), "part")


@query(with_(T) + """, n as (select tag, count(*) as n from g group by tag) select tag as key, cast(n as double) as n, row_number() over (order by n desc, tag) as rank from n order by n desc, tag limit 1000""")
def ranked_tag_file(spark: SparkSession, d: str) -> DataFrame:
    """The thousand most frequent tags from a tab-separated file of all tag counts."""
    out = scratch(spark, "counts")
    writers.write_tsv(tagged(spark, d).groupBy("tag").agg(F.count(F.lit(1)).alias("n")), out)
    return readers.ranked_file(spark, out, 1_000)


@query(with_(T) + """, c as (select tag, city, count(*) as n from g where city is not null group by tag, city), h as (select tag, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) as value from c group by tag)
select tag as key, value from h where value > 1e-5""")
def entropy_tag_file(spark: SparkSession, d: str) -> DataFrame:
    """Entropies of tags over cities from a two-column file with a background row."""
    out = scratch(spark, "entropies")
    per = pr.entropy_by(tagged(spark, d, "city").dropna(subset=["city"]), ["tag"], ["city"]).select("tag", F.round("entropy", 6).alias("value"))
    extra = spark.createDataFrame([("_background", 3.0)], "tag string, value double")
    per.unionByName(extra).write.option("sep", "\t").csv(out)
    return readers.entropy_file(spark, out)


@query("""select district, city, cast(row_number() over (partition by district, city order by region_no) - 1 as int) as region_no, cast(len(venues) as int) as venues,
cast(len(ring) + cast(ring[1] <> ring[len(ring)] as int) as int) as points, ring[1].lng as lng, ring[1].lat as lat from gold_region""")
def region_files(spark: SparkSession, d: str) -> DataFrame:
    """Gold regions as one feature collection for each city and district, read again."""
    g = table(spark, d, "gold_region")
    feature = writers.feature(F.col("ring"), {"venues": F.col("venues")})
    out = scratch(spark, "regions")
    writers.write_collections(g.select(F.concat_ws("_", "city", "district").alias("name"), "region_no", feature.alias("feature")), out, "name", "feature", "region_no")
    back = readers.geojson_regions(spark, f"{out}/*.json")
    return back.select("district", "city", "region_no", F.size("venues").alias("venues"), F.size("ring").alias("points"), F.get("ring", 0)["lng"].alias("lng"), F.get("ring", 0)["lat"].alias("lat"))


@query("""select city as source, 'vellmare' as target, district, cast(200 as int) as radius, 'emd' as metric, cast(region_no * 60 + 30 as double) as seconds from gold_region""")
def search_durations(spark: SparkSession, d: str) -> DataFrame:
    """Durations of searches from logs, one log per district, whose lines name the start and the end of each."""
    place = F.dense_rank().over(Window.partitionBy("district").orderBy("city", "region_no"))
    g = table(spark, d, "gold_region").select("district", "city", "region_no").withColumn("slot", place)
    at = F.to_timestamp_ntz(F.lit("2014-07-01 00:00:00")) + F.make_dt_interval(hours=F.col("slot"))
    line = lambda t, how: F.concat(F.date_format(t, "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(f" [INFO] {how} comparaison_"), "city", F.lit("/vellmare_"), "district", F.lit("_200_emd.my"))
    lines = F.array(line(at, "will write:"), F.lit("noise"), line(at + F.make_dt_interval(mins=F.col("region_no"), secs=F.lit(30)), "wrote:"))
    out = scratch(spark, "logs")
    g.withColumn("value", F.explode(lines)).select("value", F.col("district").alias("log")).repartition("log").write.partitionBy("log").text(out)
    return readers.durations(readers.run_log(spark, f"{out}/log=*")).select("source", "target", "district", "radius", "metric", "seconds")


@query("""select 'placed' as batch, count(distinct _id) as n from checkin where loc.lng is not null union all
select 'rest', count(distinct _id) - count(distinct case when loc.lng is not null then _id end) from checkin union all select 'again', 0""")
def insert_batches(spark: SparkSession, d: str) -> DataFrame:
    """Rows that three overlapping batches of check-ins add to a table that takes every id once."""
    c = table(spark, d, "checkin").select("_id", "tid", "uid", "lid", "time")
    placed = table(spark, d, "checkin").where("loc.lng is not null").select(*c.columns)
    out = scratch(spark, "table")
    counts = [(name, writers.insert_new(rows, out, "_id")) for name, rows in (("placed", placed), ("rest", c), ("again", c))]
    return spark.createDataFrame(counts, "batch string, n bigint")


@query("""select v._id as venue, coalesce(x.m, v.c) as checkins from (select _id, min("checkinsCount") as c from venue where _id is not null group by _id) v
left join (select _id, max("checkinsCount") as m from venue where closed group by _id) x on v._id = x._id""")
def updated_counts(spark: SparkSession, d: str) -> DataFrame:
    """Venues with the count of the closed copies set where there are any."""
    v = table(spark, d, "venue").where("_id is not null")
    base = v.groupBy(F.col("_id").alias("venue")).agg(F.min("checkinsCount").alias("checkins"))
    changes = v.where("closed").groupBy(F.col("_id").alias("venue")).agg(F.max("checkinsCount").alias("checkins"))
    known = changes.where("checkins is not null")
    return writers.updated(base, known, "venue")


@query(with_(T) + "select id, string_agg(tag, chr(9) order by tag) as line from g group by id")
def tag_lines(spark: SparkSession, d: str) -> DataFrame:
    """The tags of each photo as one line."""
    per = tagged(spark, d).groupBy("id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return per.select("id", writers.tag_line(F.col("tags")).alias("line"))


@query("""select venue_id, category || ' qid:' || len(f) || ' ' || array_to_string(list_transform(f, lambda x, i: i || ':' || cast(cast(round(case when isnan(x) or isinf(x) or x is null then 0 else x end) as bigint) as varchar)), ' ') as line
from (select distinct venue_id, category, f from venue_feature where f is not null and category is not null)""")
def rank_lines(spark: SparkSession, d: str) -> DataFrame:
    """Rounded feature vectors in the format of rank learners."""
    rows = table(spark, d, "venue_feature").where("f is not null and category is not null").select("venue_id", "category", "f").distinct()
    whole = F.transform("f", lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0).otherwise(F.round(x)).cast("bigint"))
    return rows.select("venue_id", writers.rank_line(F.col("category"), F.size("f"), whole).alias("line"))


@query(with_(T) + """, n as (select tag, count(*) as n from g group by tag), a as (select *, row_number() over (order by n, tag) as r from n), b as (select *, row_number() over (order by n desc, tag) as r from n)
select a.r || ' & ' || a.tag || ' & ' || a.n || ' & ' || b.tag || ' & ' || b.n || ' \\\\' as line from a join b using (r) where a.r <= 20""")
def extreme_rows(spark: SparkSession, d: str) -> DataFrame:
    """The twenty rarest and most frequent tags as table rows."""
    n = cut(tagged(spark, d).groupBy("tag").agg(F.count(F.lit(1)).alias("n")))
    return writers.latex_rows(writers.extremes(n, "tag", "n", 20), ["rank", "low", "low_value", "high", "high_value"])


@query(with_(V) + "select distinct id, lid, uid from v where city = 'vellmare' and lid is not null")
def city_scan(spark: SparkSession, d: str) -> DataFrame:
    """A city's check-ins with a venue, and the fields asked for."""
    return readers.scan(visits(spark, d, "lid", "uid", "city"), "vellmare", True, ["id", "lid", "uid"]).distinct()


_FAR = "2 * 6371008.8 * asin(sqrt(pow(sin(radians(loc.lat - y) / 2), 2) + cos(radians(loc.lat)) * cos(radians(y)) * pow(sin(radians(loc.lng - x) / 2), 2)))"


@query(f"""with b as (select (lng_bl + lng_ur) / 2 as x, (lat_bl + lat_ur) / 2 as y from city_box where city = 'vellmare')
select 'checkin' as kind, count(distinct case when lower(trim(city)) = 'vellmare' and lid is not null then _id end) as in_city,
count(distinct case when loc.lat between y - 2000 / 110000.0 and y + 2000 / 110000.0 and {_FAR} <= 2000 then _id end) as in_ball from checkin, b""")
def place_or_ball(spark: SparkSession, d: str) -> DataFrame:
    """Check-ins by the city predicate and by the ball predicate of 2 km around the city's middle."""
    c = table(spark, d, "checkin")
    box = table(spark, d, "city_box").where("city = 'vellmare'").first()
    middle = ((box["lng_bl"] + box["lng_ur"]) / 2, (box["lat_bl"] + box["lat_ur"]) / 2)
    city, ball = readers.in_place_or_ball("checkin", "vellmare"), readers.in_place_or_ball("checkin", ball=(*middle, 2_000.0))
    return c.groupBy(F.lit("checkin").alias("kind")).agg(F.count_distinct(F.when(city, F.col("_id"))).alias("in_city"), F.count_distinct(F.when(ball, F.col("_id"))).alias("in_ball"))


@query(with_(V) + "select uid, count(*) as n from v where uid is not null and city = 'santorvo' group by uid order by n desc, uid limit 500")
def active_users(spark: SparkSession, d: str) -> DataFrame:
    """The 500 most active users of a city."""
    return readers.entity_ids(visits(spark, d, "uid", "city"), "uid", "santorvo", 500)


@query(with_(T) + "select id, tag, uid, t from g where tag = 'street' and city = 'vellmare' and t >= '2013-01-01' and t < '2014-07-01'")
def tag_since(spark: SparkSession, d: str) -> DataFrame:
    """A city's photos of one tag in a time range."""
    rows = tagged(spark, d, "uid", "city", "t")
    stamp = lambda x: F.to_timestamp_ntz(F.lit(f"{x} 00:00:00"))
    return pr.tag_rows(rows, "street", stamp("2013-01-01"), stamp("2014-07-01"), city="vellmare").select("id", "tag", "uid", "t")


@query(with_(P) + "select city, cast(least(count(*), 50) as bigint) as n, true as own from p where city is not null group by city")
def city_samples(spark: SparkSession, d: str) -> DataFrame:
    """Fifty random photos of each city: how many were drawn, and that they are its own."""
    rows = shots(spark, d, "city").dropna(subset=["city"])
    drawn = pr.sampled(rows, 50, 3, ["city"], ["id"])
    return drawn.join(rows.select("id", F.col("city").alias("c")), "id").groupBy("city").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("c") == F.col("city")).alias("own"))


@query(with_(T) + """, w as (select distinct nullif(lower(trim(unnest(tags))), '') as tag from venue) select distinct tag from g where tag not in (select tag from w where tag is not null)""")
def uncovered_tags(spark: SparkSession, d: str) -> DataFrame:
    """Photo tags that no venue has."""
    known = table(spark, d, "venue").select(F.explode("tags").alias("t")).select(folded(F.col("t")).alias("tag"))
    return rec.new_rows(tagged(spark, d).select("tag").distinct(), "tag", known)


@query(with_(L) + "select cat, count(*) as n from l where cat is not null group by cat")
def counted_elements(spark: SparkSession, d: str) -> DataFrame:
    """A bag of categories rebuilt from its counts, and counted again."""
    bag = places(spark, d, "cat").where("cat is not null").groupBy("cat").agg(F.count(F.lit(1)).alias("k"))
    return rec.elements(bag, "cat", "k").groupBy("cat").agg(F.count(F.lit(1)).alias("n"))


@query(with_(P) + ", n as (select count(*) as n from p where t is not null) select i as chunk, least(1000, n - 1000 * i) as rows from n, range(0, 1000000) r(i) where i * 1000 < n")
def photo_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Photos in the order of their times in chunks of a thousand."""
    rows = shots(spark, d, "t").dropna(subset=["t"])
    return rec.chunks_of(rows, ["t", "id"], 1_000).groupBy("chunk").agg(F.count(F.lit(1)).alias("rows"))


@query("""select distinct _id, trim(uid) as uid, taken, loc.lng as lng, loc.lat as lat, title as title, farm, server, secret from photos
where _id is not null and uid is not null and taken is not null and upload is not null and loc.lng is not null and loc.lat is not null and title is not null and title not like '%#%' and farm is not null and server is not null and secret is not null
and len(list_filter(tags, lambda t: t is not null and trim(t) <> '' and t not like '%:%')) > 0""")
def photo_json(spark: SparkSession, d: str) -> DataFrame:
    """Photos as service JSON, brought into shape; those that lack one of the eleven fields drop out."""
    p = table(spark, d, "photos").where(~F.coalesce(F.contains("title", F.lit("#")), F.lit(False)))
    made = F.to_json(F.struct(
        F.col("_id").alias("id"), F.trim("uid").alias("owner"), F.date_format("taken", "yyyy-MM-dd HH:mm:ss").alias("datetaken"), F.unix_timestamp("upload").cast("string").alias("dateupload"),
        F.array_join(F.transform("tags", lambda t: F.regexp_replace(t, r"\s+", "")), " ").alias("tags"), "title", "farm", "secret", "server", F.col("loc.lng").alias("longitude"), F.col("loc.lat").alias("latitude"),
    ))
    x = p.select(parse.photo(made, "vellmare", "venues").alias("x")).where("x is not null")
    return x.select("x._id", "x.uid", "x.taken", F.col("x.loc.lng").alias("lng"), F.col("x.loc.lat").alias("lat"), "x.title", "x.farm", "x.server", "x.secret").distinct()


class Lattice:
    """A search service over the points of a lattice: every result is its column, row and number of the page."""

    def __init__(self, side: int, per_page: int):
        self.side, self.per_page = side, per_page

    def _points(self, box: tuple) -> list[tuple[int, int]]:
        (x0, y0), (x1, y1) = box
        return [(x, y) for x in range(self.side) if x0 <= x < x1 for y in range(self.side) if y0 <= y < y1]

    def total(self, box: tuple) -> int:
        return len(self._points(box))

    def page(self, box: tuple, number: int) -> list[tuple[int, int]]:
        return self._points(box)[(number - 1) * self.per_page : number * self.per_page]


@query("select cast(x as int) as x, cast(y as int) as y from range(0, 60) a(x), range(0, 60) b(y)")
def paged_lattice(spark: SparkSession, d: str) -> DataFrame:
    """All results of a service that answers for a box at most 200 results in pages of 30, by quartering its box."""
    service = Lattice(60, 30)
    source = paged.paged_source(service, ((0.0, 0.0), (64.0, 64.0)), "x int, y int", "lattice", 200, 0, 30)
    spark.dataSource.register(source)
    return spark.read.format("lattice").load()


@query("select cast(i as int) as failure, round(120 * pow(1.618, i), 6) as wait, i + 1 >= 5 as give_up from range(0, 6) r(i)")
def backoff_waits(spark: SparkSession, d: str) -> DataFrame:
    """The waiting times after six failures in one hour, and whether to give up."""
    state, out = ingest.Backoff(clock=lambda: 0.0), []
    for k in range(6):
        wait = state.fail()
        out.append((k, round(float(wait), 6), state.give_up()))
    return spark.createDataFrame(out, "failure int, wait double, give_up boolean")


@query(with_(V) + """, k as (select distinct _id from venue where _id is not null) select 'complete' as part, count(*) as n from v join k on k._id = v.lid where t >= '2000-01-01' union all
select 'rejected', count(*) from v where t >= '2000-01-01' and (lid is null or lid not in (select _id from k))""")
def stream_enriched(spark: SparkSession, d: str) -> DataFrame:
    """Check-ins as a stream joined with the venue table: how many are complete and how many have no venue."""
    out = {name: scratch(spark, name) for name in ("complete", "rejected")}
    raw = table(spark, d, "checkin")
    known = table(spark, d, "venue").select(F.col("_id").alias("lid")).dropna().distinct().withColumn("found", F.lit(True))

    def both(batch: DataFrame, _: int) -> None:
        for name, rows in zip(out, ingest.enriched(batch, known, "lid")):
            writers.insert_new(rows.select("_id"), out[name], "_id")

    stream = ingest.file_stream(spark, f"{d.rstrip('/')}/checkin.parquet*", raw.schema).where(F.col("time") >= F.lit("2000-01-01").cast("timestamp_ntz"))
    ingest.run_available(stream.select("_id", folded(F.col("lid")).alias("lid")), scratch(spark, "enriched").rsplit("/", 1)[1], both)
    parts = [spark.read.schema("_id string").parquet(p).select(F.lit(n).alias("part")) for n, p in out.items() if writers.exists(spark, p)]
    every = spark.createDataFrame([(n, 0) for n in out], "part string, n bigint")
    for x in parts:
        every = every.unionByName(x.groupBy("part").agg(F.count(F.lit(1)).alias("n")))
    return every.groupBy("part").agg(F.sum("n").alias("n"))


@query(with_(V) + """, r as (select *, case when epoch(t) - lag(epoch(t)) over (partition by uid order by t, id) <= 7200 then 0 else 1 end as n from v where uid is not null and t >= '2000-01-01' and city is not null and lid is not null),
s as (select *, sum(n) over (partition by uid order by t, id rows unbounded preceding) as k from r) select count(*) as sessions, cast(sum(n) as bigint) as records from (select uid, k, count(*) as n from s group by uid, k)""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Check-ins with user, city and venue as a stream, in sessions without a pause of two hours: how many, of how many records."""
    raw = table(spark, d, "checkin")
    rows = raw.where("uid is not null and city is not null and lid is not null and _id is not null and time >= '2000-01-01'")
    clean = rows.select("_id", "uid", "time", letters(F.col("city")).alias("c"), folded(F.col("lid")).alias("l")).dropna().select("_id", "uid", "time").distinct()
    landed, out = scratch(spark, "clean"), scratch(spark, "sessions")
    clean.write.parquet(landed)
    stream = ingest.timed(ingest.file_stream(spark, f"{landed}/*.parquet", clean.schema, files_per_batch=100_000), "time", "40 days")
    ingest.run_available(ingest.session_counts(stream, "2 hours", ["uid"]), scratch(spark, "s").rsplit("/", 1)[1], lambda batch, _: batch.write.mode("overwrite").parquet(out), "complete")
    return spark.read.parquet(out).agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("records"))


@query("""select g.district, city, region_no from gold_region g join (select district from gold_region group by district having count(*) >= 2) using (district)""")
def timeline_files(spark: SparkSession, d: str) -> DataFrame:
    """Gold regions (about 50) as one JSON array for each district, read again; arrays of one record are skipped."""
    per = table(spark, d, "gold_region").groupBy("district").agg(F.to_json(F.array_sort(F.collect_list(F.struct("district", "city", "region_no")))).alias("value"))
    out = scratch(spark, "timelines")
    per.select(F.col("district").alias("part"), "value").repartition("part").write.partitionBy("part").text(out)
    return readers.timelines(spark, f"{out}/part=*").select("district", "city", F.col("region_no").cast("int").alias("region_no"))


@query("""with m as (select distinct tid, cast(uid as varchar) as uid, loc.lng as lng, loc.lat as lat, date_trunc('second', "time") as time, 'https://venue.example/' || lid as lid from checkin
 where tid is not null and uid is not null and lid is not null and "time" is not null and loc.lng is not null and loc.lat is not null)
select tid, m.uid, c.city, m.time, m.lid from m join city_box c on m.lat between lat_bl and lat_ur and m.lng between lng_bl and lng_ur""")
def message_json(spark: SparkSession, d: str) -> DataFrame:
    """Check-ins as posted messages with coordinates and links; those inside a city's box are read again."""
    c = table(spark, d, "checkin").where("tid is not null and uid is not null and lid is not null and time is not null and loc.lng is not null and loc.lat is not null")
    links = F.array(F.struct(F.lit("https://other.example/a").alias("expanded_url")), F.struct(F.concat(F.lit("https://venue.example/"), "lid").alias("expanded_url")))
    made = F.to_json(F.struct(
        F.col("tid").alias("id_str"), F.struct(F.array("loc.lng", "loc.lat").alias("coordinates")).alias("coordinates"), F.struct(links.alias("urls")).alias("entities"),
        F.struct(F.col("uid").cast("string").alias("id_str")).alias("user"), F.date_format("time", "EEE MMM dd HH:mm:ss '+0000' yyyy").alias("created_at"), F.col("msg").alias("text"),
    ))
    boxes = table(spark, d, "city_box").withColumn("zone", F.lit("UTC"))
    return parse.message(c.select(made.alias("j")), "j", boxes, ["venue.example"]).select("tid", "uid", "city", "time", "lid").distinct()


@query(with_(V) + """, u as (select _id, min(trim("shortUrl")) as url from venue where trim("shortUrl") <> '' and _id is not null group by _id), b as (select url, min(_id) as new from u group by url)
select distinct id, case when uid % 2 = 0 then lid when u.url is null then 'bad-' || lid else b.new end as lid from v left join u on u._id = v.lid left join b on b.url = u.url where lid is not null and uid is not null""")
def repaired_ids(spark: SparkSession, d: str) -> DataFrame:
    """Venue ids of check-ins, half of them bad, repaired through the links of the bad ids and the venues of the links."""
    v = table(spark, d, "venue").select("_id", F.trim("shortUrl").alias("url")).where("_id is not null and url <> ''")
    first = v.groupBy("_id").agg(F.min("url").alias("new"))
    links = first.select(F.concat(F.lit("bad-"), "_id").alias("old"), "new")
    owners = first.groupBy(F.col("new").alias("old")).agg(F.min("_id").alias("new"))
    rows = visits(spark, d, "lid", "uid").dropna().select("id", F.when(F.col("uid") % 2 == 0, F.col("lid")).otherwise(F.concat(F.lit("bad-"), "lid")).alias("lid"))
    return rec.translated(rec.translated(rows, "lid", links), "lid", owners).select("id", "lid").distinct()
