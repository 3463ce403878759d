"""Writers, and the row formats they write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.lineage import cut
from waymark.operators.records import new_rows


def insert_new(df: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose ``key`` the parquet table at ``path`` does not have yet, each key once; returns how many.

    Of several rows with one key the smallest (by all columns) is kept; null keys are left out.
    """
    spark = df.sparkSession
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*df.columns)).alias("_w"))
    rows = best.select(*[F.col(f"_w.{c}").alias(c) for c in df.columns])
    if exists(spark, path):
        rows = new_rows(rows, key, spark.read.parquet(path))
    rows = cut(rows)
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    return n


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def updated(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``base`` with the columns of ``changes`` (one row per key) set where the key matches; to be written to a new place."""
    columns = [c for c in changes.columns if c != key]
    flagged = changes.select(key, F.struct(*columns).alias("_c"), F.lit(True).alias("_hit"))
    out = base.join(flagged, key, "left")
    return out.select(*[F.when(F.col("_hit"), F.col(f"_c.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def dated_json(df: DataFrame, time: str) -> Column:
    """A row as JSON text with its time wrapped as {"$date": ISO}."""
    text = F.col(time).cast("string")  # without any zone, whatever the session's
    wrapped = F.struct(F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), F.lit("Z")).alias("$date"))
    return F.to_json(F.struct(*[wrapped.alias(c) if c == time else F.col(c) for c in df.columns]))


def write_json_lines(df: DataFrame, path: str, local: Column) -> None:
    """JSON lines, split into the folders ``part=local`` and ``part=outside``."""
    df.withColumn("part", F.when(local, "local").otherwise("outside")).write.mode("overwrite").partitionBy("part").json(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text with a header."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def feature(ring: Column, properties: dict[str, Column]) -> Column:
    """A GeoJSON polygon feature as text; ``ring`` is an array of lng/lat structs, closed here if open."""
    points = F.transform(ring, lambda p: F.array(p["lng"], p["lat"]))
    closed = F.when(F.get(points, 0) == F.element_at(points, -1), points).otherwise(F.concat(points, F.slice(points, 1, 1)))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*[c.alias(n) for n, c in properties.items()]).alias("properties")))


def write_collections(features: DataFrame, path: str, name: str, feature: str, order: str) -> None:
    """One GeoJSON file ``<name>.json`` for each ``name`` with its features in ``order``.

    For outlines drawn by hand, of which a name has at most a few hundred: each file is one task's work.
    """
    made = features.groupBy(name).agg(F.array_sort(F.collect_list(F.struct(order, feature))).alias("_f"))
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform("_f", lambda x: x[feature]), ","), F.lit("]}"))
    spark = features.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    for row in made.select(name, text.alias("_t")).toLocalIterator():
        out = system.create(spark._jvm.org.apache.hadoop.fs.Path(target, f"{row[0]}.json"), True)
        out.write(bytearray(row[1].encode()))
        out.close()


def cell_ring(ix: Column, iy: Column, k: int) -> Column:
    """The corners of a grid cell in the box columns lat_bl, lng_bl, lat_ur, lng_ur."""
    x = lambda i: F.col("lng_bl") + (F.col("lng_ur") - F.col("lng_bl")) * i / k
    y = lambda i: F.col("lat_bl") + (F.col("lat_ur") - F.col("lat_bl")) * i / k
    corner = lambda i, j: F.struct(x(i).alias("lng"), y(j).alias("lat"))
    return F.array(corner(ix, iy), corner(ix + 1, iy), corner(ix + 1, iy + 1), corner(ix, iy + 1))


def tag_line(tags: Column) -> Column:
    """Tags as one tab-separated line."""
    return F.array_join(tags, "\t")


def rank_line(label: Column, group: Column, values: Column) -> Column:
    """``label qid:group 1:v1 2:v2 ...``"""
    parts = F.transform(values, lambda v, i: F.concat((i + 1).cast("string"), F.lit(":"), v.cast("string")))
    return F.concat_ws(" ", label.cast("string"), F.concat(F.lit("qid:"), group.cast("string")), F.array_join(parts, " "))


def indicators(df: DataFrame, tags: str, wanted: list[str]) -> DataFrame:
    """One 0/1 column per wanted tag. The list is given, not collected from the data."""
    return df.select("*", *[F.array_contains(tags, t).cast("int").alias(f"tag_{t}") for t in wanted])


def latex_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Table rows as LaTeX text."""
    return df.select(F.concat(F.concat_ws(" & ", *[F.col(c).cast("string") for c in columns]), F.lit(r" \\")).alias("line"))


def extremes(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """(rank, low, low_value, high, high_value): the n smallest and largest side by side."""
    low, high = df.orderBy(value, key).limit(n), df.orderBy(F.desc(value), key).limit(n)
    a = low.select(F.row_number().over(Window.orderBy(value, key)).alias("rank"), F.col(key).alias("low"), F.col(value).alias("low_value"))
    b = high.select(F.row_number().over(Window.orderBy(F.desc(value), key)).alias("rank"), F.col(key).alias("high"), F.col(value).alias("high_value"))
    return a.join(b, "rank")
