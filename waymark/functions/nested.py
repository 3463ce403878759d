"""Access to nested and repeated fields with defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nested(json: Column, path: list[str], default: str | None = None) -> Column:
    """The text at a path of a JSON string, ``default`` where a key is missing or null."""
    return F.coalesce(F.get_json_object(json, "$" + "".join(f"['{p}']" for p in path)), F.lit(default))


def count_of(json: Column, field: str) -> Column:
    """field.count of a JSON object, 0 if missing."""
    return nested(json, [field, "count"], "0").cast("bigint")


def other_ids(json: Column, field: str) -> Column:
    """The ids of the items in the groups of type "others" of a field; empty if there are none."""
    groups = F.from_json(F.get_json_object(json, f"$['{field}']['groups']"), "array<struct<type:string,items:array<struct<id:string>>>>")
    others = F.filter(groups, lambda g: g["type"] == "others")
    ids = F.flatten(F.transform(others, lambda g: F.transform(g["items"], lambda i: i["id"].cast("bigint"))))
    return F.when(count_of(json, field) > 0, F.coalesce(ids, F.array().cast("array<bigint>"))).otherwise(F.array().cast("array<bigint>"))


def padded(values: Column, size: int, fill: Column) -> Column:
    """An array lengthened to ``size`` with ``fill``; longer ones stay."""
    return F.concat(values, F.array_repeat(fill, F.greatest(F.lit(0), F.lit(size) - F.size(values))))


def columns_of(df: DataFrame, fields: list[str]) -> DataFrame:
    """The named fields of each row as one tuple column ``row``."""
    return df.select(F.struct(*fields).alias("row"))


def as_map(key: Column, value: Column) -> Column:
    """Aggregate: key to value. For small groups."""
    return F.map_from_entries(F.collect_list(F.struct(key, value)))
