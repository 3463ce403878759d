"""Readers of the landed file formats."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions.clock import epoch_us
from waymark.functions.geo import haversine_m
from waymark.functions.text import folded

CHECKIN_LINE = "uid bigint, tid string, lat double, lng double, created_at string, text string, place string"


def checkin_lines(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated check-ins of seven fields; lines with more, fewer or ill-typed fields are left out."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") == 7)
    names = [c.split() for c in CHECKIN_LINE.split(", ")]
    rows = lines.select(*[F.expr(f"try_cast(f[{i}] as {kind})").alias(name) for i, (name, kind) in enumerate(names)])
    return rows.dropna(subset=["uid", "tid", "lat", "lng"])


def semicolon_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Semicolon-separated files (a glob takes several) with a header and no quoting."""
    reader = spark.read.option("sep", ";").option("quote", "").option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def venue_csv(spark: SparkSession, path: str, cities: list[str]) -> DataFrame:
    """Venues of the known cities from ``semicolon_csv`` files, with typed columns; empty text is null, lists are comma-separated."""
    raw = semicolon_csv(spark, path)
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    number = lambda c, kind: F.expr(f"try_cast(nullif(trim(`{c}`), '') as {kind})")
    items = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != "")
    lng_lat = F.split(F.col("lon,lat").cast("string") if "lon,lat" in raw.columns else F.lit(""), ",")
    rows = raw.where(F.lower("city").isin([c.lower() for c in cities]))
    return rows.select(
        F.col("vid").alias("_id"), text(F.col("name")).alias("name"), F.lower("city").alias("city"),
        *[number(c, "int").alias(c) for c in ("checkinsCount", "likes", "usersCount", "tipCount", "price")],
        number("mayor", "bigint").alias("mayor"), number("rating", "double").alias("rating"),
        F.transform(items(F.col("likers")), lambda x: x.cast("bigint")).alias("likers"), items(F.col("tags")).alias("tags"), items(F.col("cats")).alias("cats"),
        number("closed", "boolean").alias("closed"), F.try_to_timestamp("createdAt", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("createdAt"),
        F.struct(F.get(lng_lat, 0).cast("double").alias("lng"), F.get(lng_lat, 1).cast("double").alias("lat")).alias("loc"),
    )


def translations(spark: SparkSession, path: str) -> DataFrame:
    """(old, new) of ``old;new`` lines; of a repeated old the smallest new counts."""
    parts = spark.read.text(path).select(F.split("value", ";").alias("f")).where(F.size("f") == 2)
    return parts.groupBy(F.get("f", 0).alias("old")).agg(F.min(F.get("f", 1)).alias("new"))


def timelines(spark: SparkSession, path: str, least: int = 2) -> DataFrame:
    """Records of files with one JSON array each; files with fewer than ``least`` records are skipped."""
    rows = spark.read.option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    full = rows.groupBy("file").count().where(F.col("count") >= least).select("file")
    return rows.join(full, "file", "left_semi")


def ranked_file(spark: SparkSession, path: str, first: int, value: str = "n") -> DataFrame:
    """(key, value, rank) of the first lines of a tab-separated file with a header, by value, ties by key."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    named = rows.select(F.col(rows.columns[0]).alias("key"), F.expr(f"try_cast(`{rows.columns[1]}` as double)").alias(value)).dropna()
    best = named.orderBy(F.desc(value), "key").limit(first)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), "key")))


def entropy_file(spark: SparkSession, path: str, least: float = 1e-5) -> DataFrame:
    """(key, value) of a two-column file without the background row and values up to ``least``, ascending."""
    rows = spark.read.option("sep", "\t").csv(path, schema="key string, value double")
    return rows.where((F.col("key") != "_background") & (F.col("value") > least)).orderBy("value", "key")


def geojson_regions(spark: SparkSession, path: str) -> DataFrame:
    """(district, city, region_no, ring, venues) of ``<city>_<district>.json`` feature collections."""
    point = "array<array<array<double>>>"
    schema = f"features array<struct<geometry:struct<type:string,coordinates:{point}>,properties:struct<venues:array<string>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("_f", F.input_file_name())
    name = F.regexp_extract("_f", r"([^/]+)\.json$", 1)
    one = rows.select(name.alias("_n"), F.posexplode("features").alias("region_no", "x"))
    ring = F.transform(F.get("x.geometry.coordinates", 0), lambda p: F.struct(F.get(p, 0).alias("lng"), F.get(p, 1).alias("lat")))
    return one.select(
        F.substring_index("_n", "_", -1).alias("district"), F.substring_index("_n", "_", 1).alias("city"), "region_no", ring.alias("ring"), F.col("x.properties.venues").alias("venues")
    )


def category_tree(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, depth, parent, path, idx) of a nested category file; idx counts from 100 in the order of the ids.

    The tree is a small dimension of some hundred rows and is flattened on the driver.
    """
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    rows: list[tuple] = []

    def down(nodes: list, depth: int, parent: str | None, above: list[str]) -> None:
        for x in nodes:
            rows.append((x["id"], x["name"], depth, parent, [*above, x["id"]]))
            down(x.get("categories") or [], depth + 1, x["id"], [*above, x["id"]])

    down(json.loads(text).get("categories") or [], 1, None, [])
    order = {r[0]: 100 + i for i, r in enumerate(sorted(rows))}
    return spark.createDataFrame([(*r, order[r[0]]) for r in rows], "id string, name string, depth int, parent string, path array<string>, idx int")


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """(log, at, starting, source, target, district, radius, metric) of logs of searches; other lines are left out.

    A line is ``yyyy-MM-dd HH:mm:ss,SSS [...] [will write:] comparaison_<source>/<target>_<district>_<radius>_<metric>.my``.
    """
    pattern = r"comparaison_(\w+?)/(\w+?)_(\w+?)_(\d+)_(\w+)\.my"
    x = spark.read.text(path).where(F.col("value").rlike(pattern))
    part = lambda i: F.regexp_extract("value", pattern, i)
    when = F.try_to_timestamp(F.trim(F.substring_index("value", "[", 1)), F.lit("yyyy-MM-dd HH:mm:ss,SSS")).cast("timestamp_ntz")
    return x.select(
        F.col("_metadata.file_path").alias("log"), when.alias("at"), F.col("value").contains("will write").alias("starting"), part(1).alias("source"), part(2).alias("target"),
        part(3).alias("district"), part(4).cast("int").alias("radius"), part(5).alias("metric"),
    ).where("at is not null")


def durations(log: DataFrame) -> DataFrame:
    """Seconds of each search: a finishing line takes the last starting line before it in its log, which one process wrote."""
    run = Window.partitionBy("log").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    since = F.last(F.when(F.col("starting"), F.col("at")), ignorenulls=True).over(run)
    rows = log.withColumn("_s", since).where("not starting and _s is not null")
    return rows.withColumn("seconds", (epoch_us(F.col("at")) - epoch_us(F.col("_s"))) / 1e6).drop("_s", "starting")


def scan(df: DataFrame, city: str | None = None, with_venue: bool = True, fields: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """A templated scan: optional city and venue filters and columns, pushed to the files, and a final limit."""
    if city is not None:
        df = df.where(F.col("city") == city)
    if with_venue:
        df = df.where(F.col("lid").isNotNull())
    if fields:
        df = df.select(*fields)
    return df.limit(limit) if limit else df


def entity_ids(checkins: DataFrame, entity: str, city: str | None = None, first: int | None = None) -> DataFrame:
    """(entity, n): different ids with their counts, most frequent first, ties by id."""
    rows = checkins if city is None else checkins.where(F.col("city") == city)
    out = rows.dropna(subset=[entity]).groupBy(entity).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), entity).limit(first) if first else out


def in_place_or_ball(kind: str, city: str | None = None, ball: tuple[float, float, float] | None = None) -> Column:
    """The predicate of a visit scan: a city's rows with a venue, or those within (lng, lat, metres)."""
    if city is not None:
        return (folded(F.col("city")) == city) & (F.col("lid").isNotNull() if kind == "checkin" else F.lit(True))
    if ball is not None:
        x, y, r = ball
        box = F.col("loc.lat").between(y - r / 110_000, y + r / 110_000)
        return box & (haversine_m(F.col("loc.lng"), F.col("loc.lat"), F.lit(x), F.lit(y)) <= r)
    raise ValueError("a city or a ball is needed")
