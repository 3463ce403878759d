"""Records of the project's tables, once per id and in one spelling, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.text import folded, letters, trimmed
from waymark.sources.tables import table


def visits(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Check-ins: id and the asked columns of lid, uid, city, t, lng, lat."""
    known = {
        "lid": folded(F.col("lid")), "uid": F.col("uid"), "city": letters(F.col("city")), "t": F.col("time"),
        "lng": F.col("loc.lng"), "lat": F.col("loc.lat"),
    }
    df = table(spark, d, "checkin").select(F.col("_id").alias("id"), *[known[c].alias(c) for c in columns])
    return df.where(F.col("id").isNotNull()).distinct()


def shots(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Photos: id and the asked columns of uid, city, t, lng, lat."""
    known = {
        "uid": trimmed(F.col("uid")), "city": letters(F.col("hint")), "t": F.col("taken"), "lng": F.col("loc.lng"), "lat": F.col("loc.lat"),
    }
    df = table(spark, d, "photos").select(F.col("_id").alias("id"), *[known[c].alias(c) for c in columns])
    return df.where(F.col("id").isNotNull()).distinct()


def places(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Venues: id and the asked columns of cat, lng, lat."""
    known = {"cat": folded(F.col("cat")), "lng": F.col("loc.lng"), "lat": F.col("loc.lat")}
    df = table(spark, d, "venue").select(F.col("_id").alias("id"), *[known[c].alias(c) for c in columns])
    return df.where(F.col("id").isNotNull()).distinct()


def tagged(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row per photo and different tag: id, tag, and the asked columns as in ``shots``."""
    known = {
        "uid": trimmed(F.col("uid")), "city": letters(F.col("hint")), "t": F.col("taken"), "lng": F.col("loc.lng"), "lat": F.col("loc.lat"),
    }
    df = table(spark, d, "photos").select(
        F.col("_id").alias("id"), F.explode("tags").alias("tag"), *[known[c].alias(c) for c in columns]
    ).withColumn("tag", folded(F.col("tag")))
    return df.where(F.col("id").isNotNull() & F.col("tag").isNotNull()).distinct()


V = """v as (select distinct _id as id, nullif(lower(trim(lid)), '') as lid, uid, nullif(regexp_replace(lower(city), '[^a-z]', '', 'g'), '') as city,
  "time" as t, loc.lng as lng, loc.lat as lat from checkin where _id is not null)"""
P = """p as (select distinct _id as id, nullif(trim(uid), '') as uid, nullif(regexp_replace(lower(hint), '[^a-z]', '', 'g'), '') as city,
  taken as t, loc.lng as lng, loc.lat as lat from photos where _id is not null)"""
L = """l as (select distinct _id as id, nullif(lower(trim(cat)), '') as cat, loc.lng as lng, loc.lat as lat from venue where _id is not null)"""
T = """g as (select distinct id, tag, uid, city, t, lng, lat from (select _id as id, nullif(lower(trim(unnest(tags))), '') as tag, nullif(trim(uid), '') as uid,
  nullif(regexp_replace(lower(hint), '[^a-z]', '', 'g'), '') as city, taken as t, loc.lng as lng, loc.lat as lat from photos where _id is not null) where tag is not null)"""


def with_(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"
