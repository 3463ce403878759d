"""Parsing of landed JSON objects: check-ins, messages, venues, users, photos. Bad input gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.clock import to_city_time
from waymark.functions.nested import count_of, nested, other_ids
from waymark.functions.text import machine_tags, title_parts


def checkin(json: Column) -> Column:
    """struct(uid, lid, time) of a check-in; null unless user, venue and time are there. time is local (offset in minutes)."""
    uid, lid = nested(json, ["user", "id"]).try_cast("bigint"), nested(json, ["venue", "id"])
    at, offset = nested(json, ["createdAt"]).try_cast("bigint"), F.coalesce(nested(json, ["timeZoneOffset"], "0").try_cast("bigint"), F.lit(0))
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    local = origin + F.make_dt_interval(secs=(at + offset * 60).cast("decimal(18, 6)"))
    out = F.struct(uid.alias("uid"), lid.alias("lid"), local.alias("time"))
    return F.when(uid.isNotNull() & lid.isNotNull() & at.isNotNull(), out)


def message(df: DataFrame, json: str, boxes: DataFrame, hosts: list[str]) -> DataFrame:
    """Check-ins of posted messages: tid, lid (the first link to one of ``hosts``), uid, city, loc, time (local), msg.

    Messages without coordinates inside a city box, without such a link or with a bad date are left out.
    """
    j = F.col(json)
    point = F.from_json(nested(j, ["coordinates", "coordinates"]), "array<double>")
    links = F.transform(F.from_json(nested(j, ["entities", "urls"], "[]"), "array<struct<expanded_url:string>>"), lambda u: u["expanded_url"])
    wanted = F.filter(links, lambda u: F.greatest(*[u.contains(h) for h in [*hosts, *hosts[:1]]]))
    stamp = F.regexp_replace(nested(j, ["created_at"]), r"^\w{3} ", "")
    utc = F.try_to_timestamp(F.regexp_replace(stamp, r" \+0000 ", " "), F.lit("MMM dd HH:mm:ss yyyy"))
    rows = df.select(
        nested(j, ["id_str"]).alias("tid"), F.get(wanted, 0).alias("lid"), nested(j, ["user", "id_str"]).alias("uid"),
        F.struct(F.get(point, 0).alias("lng"), F.get(point, 1).alias("lat")).alias("loc"), utc.cast("timestamp_ntz").alias("_utc"), nested(j, ["text"]).alias("msg"),
    ).dropna(subset=["lid", "_utc"])
    box = boxes.select("city", "lat_bl", "lng_bl", "lat_ur", "lng_ur", "zone")
    inside = F.col("loc.lat").between(F.col("lat_bl"), F.col("lat_ur")) & F.col("loc.lng").between(F.col("lng_bl"), F.col("lng_ur"))
    return rows.join(box, inside).select("tid", "lid", "uid", "city", "loc", to_city_time(F.col("_utc"), F.col("zone")).alias("time"), "msg")


def venue(json: Column) -> Column:
    """struct of a venue's fields; null without an id or a position."""
    get = lambda *p: nested(json, list(p))
    num = lambda kind, *p: get(*p).try_cast(kind)
    ids = F.transform(F.from_json(F.get_json_object(json, "$.categories"), "array<struct<id:string>>"), lambda c: c["id"])
    tags = F.array_distinct(F.transform(F.from_json(F.get_json_object(json, "$.tags"), "array<string>"), lambda t: F.trim(t)))
    lng, lat = num("double", "location", "lng"), num("double", "location", "lat")
    out = F.struct(
        get("id").alias("_id"), get("name").alias("name"), F.struct(lng.alias("lng"), lat.alias("lat")).alias("loc"),
        F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0))).alias("cats"), F.get(ids, 0).alias("cat"),
        *[num("int", "stats", c).alias(c) for c in ("checkinsCount", "usersCount", "tipCount")],
        num("int", "price", "tier").alias("price"), num("double", "rating").alias("rating"), F.timestamp_seconds(num("bigint", "createdAt")).alias("createdAt"),
        num("bigint", "mayor", "user", "id").alias("mayor"), tags.alias("tags"), get("shortUrl").alias("shortUrl"), get("canonicalUrl").alias("canonicalUrl"),
        count_of(json, "likes").alias("likes"), other_ids(json, "likes").alias("likers"), num("boolean", "closed").alias("closed"),
    )
    return F.when(get("id").isNotNull() & lng.isNotNull() & lat.isNotNull(), out)


def user(json: Column) -> Column:
    """struct of a user's fields; "none" and empty texts become null; null without an id."""
    uid = nested(json, ["id"]).try_cast("bigint")
    out = F.struct(
        uid.alias("id"), nested(json, ["firstName"]).alias("firstName"), nested(json, ["lastName"]).alias("lastName"),
        other_ids(json, "friends").alias("friends"), count_of(json, "friends").alias("friendsCount"),
        F.nullif(nested(json, ["gender"]), F.lit("none")).alias("gender"), F.nullif(nested(json, ["homeCity"]), F.lit("")).alias("homeCity"),
        *[count_of(json, c).alias(c) for c in ("tips", "lists", "badges", "mayorships", "photos", "checkins")],
    )
    return F.when(uid.isNotNull(), out)


PHOTO_KEYS = ("id", "owner", "datetaken", "dateupload", "tags", "title", "farm", "secret", "server", "longitude", "latitude")


def photo(json: Column, hint: str, namespace: str) -> Column:
    """struct of a photo's fields; null if one of its eleven keys is missing, a number or date is bad, or no tag is left."""
    get = lambda k: nested(json, [k])
    title, words = title_parts(get("title")), machine_tags(get("tags"), namespace)
    tags = F.concat(words["tags"], title["tags"])
    number, taken = get("id").try_cast("bigint"), F.try_to_timestamp(get("datetaken"), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    upload, lng, lat = get("dateupload").try_cast("double"), get("longitude").try_cast("double"), get("latitude").try_cast("double")
    good = F.size(tags) > 0
    for c in [*[get(k) for k in PHOTO_KEYS], number, taken, upload, lng, lat]:
        good = good & c.isNotNull()
    out = F.struct(
        number.alias("_id"), get("owner").alias("uid"), taken.alias("taken"), F.timestamp_seconds(upload).alias("upload"), title["title"].alias("title"),
        tags.alias("tags"), words["venue"].alias("venue"), F.struct(lng.alias("lng"), lat.alias("lat")).alias("loc"), get("farm").try_cast("int").alias("farm"),
        get("server").alias("server"), get("secret").alias("secret"), F.lit(hint).alias("hint"),
    )
    return F.when(good, out)


def page_object(html: Column, start: str, end: str) -> Column:
    """The JSON object between two markers of a page's script, null if they are missing."""
    return F.nullif(F.regexp_extract(html, f"(?s){start}(\\{{.*?\\}}){end}", 1), F.lit(""))
