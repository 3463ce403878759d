"""Deduplication, set and multiset operations, lookups and translations of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.lineage import cut


def earliest(df: DataFrame, key: str, order: Column) -> DataFrame:
    """One row per ``key``, the one with the smallest ``order`` (nulls last, then by all columns); null keys are left out."""
    rows = df.where(F.col(key).isNotNull())
    whole = F.struct(*[c for c in df.columns])
    best = rows.groupBy(key).agg(F.min(F.struct(order.isNull().alias("n"), order.alias("o"), whole.alias("w"))).alias("_b"))
    return best.select(*[F.col(f"_b.w.{c}").alias(c) for c in df.columns])


def new_rows(candidates: DataFrame, key: str, *known: DataFrame) -> DataFrame:
    """Rows whose key is in none of the ``known`` frames (each with a column ``key``); a null key is new nowhere."""
    out = candidates.where(F.col(key).isNotNull())
    for k in known:
        out = out.join(k.select(key).distinct(), key, "left_anti")
    return out


def multiset(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, in_a, in_b, either, both, sum, minus): multiset algebra of two bags from one shuffle.

    either is the union (the larger count), both the intersection (the smaller),
    minus what a has beyond b. Null is an element like any other.
    """
    rows = a.select(key, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(key, F.lit(0).alias("x"), F.lit(1).alias("y")))
    n = rows.groupBy(key).agg(F.sum("x").alias("in_a"), F.sum("y").alias("in_b"))
    return n.withColumns({
        "either": F.greatest("in_a", "in_b"), "both": F.least("in_a", "in_b"), "sum": F.col("in_a") + F.col("in_b"),
        "minus": F.greatest(F.col("in_a") - F.col("in_b"), F.lit(0)),
    })


def elements(counts: DataFrame, key: str, n: str) -> DataFrame:
    """The bag of a count table: each key n times."""
    return counts.where(F.col(n) > 0).select(F.explode(F.array_repeat(F.col(key), F.col(n).cast("int"))).alias(key))


def bulk_uses(rows: DataFrame, keys: list[str], bucket: list[Column], least: int) -> DataFrame:
    """Rows of (keys) that come at least ``least`` times in one bucket (place cell and period): uploads in bulk.

    The counts come from an aggregation with map-side combining and are joined
    back, so no user's rows are gathered in one task.
    """
    named = rows.withColumns({f"_b{i}": b for i, b in enumerate(bucket)})
    by = [*keys, *[f"_b{i}" for i in range(len(bucket))]]
    mass = named.dropna(subset=by).groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return named.join(mass, by).drop(*by[len(keys):], "_n")


def one_to_one(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b) pairs whose a and whose b each occur in exactly one row (repeated pairs count as several)."""
    rows = pairs.dropna(subset=[a, b])
    only_a = rows.groupBy(a).agg(F.count(F.lit(1)).alias("_n"), F.max(b).alias(b)).where("_n = 1").drop("_n")
    only_b = rows.groupBy(b).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select(b)
    return only_a.join(only_b, b, "left_semi")


def filled(df: DataFrame, target: str, by: str, mapping: DataFrame) -> DataFrame:
    """``target`` where it is null taken from ``mapping`` (by, value; one row per by)."""
    m = mapping.select(F.col(by), F.col("value").alias("_value"))
    return df.join(m, by, "left").withColumn(target, F.coalesce(target, "_value")).drop("_value")


def translated(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """``column`` replaced through ``mapping`` (old, new; one row per old), unmapped values kept."""
    m = mapping.select(F.col("old").alias(column), F.col("new").alias("_new"))
    return df.join(m, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def last_known(df: DataFrame, key: str, at: str, tie: str, value: str, chunk: Column) -> DataFrame:
    """Adds ``known``: the last non-null ``value`` of the key at or before each row (order ``at``, then ``tie``).

    ``chunk`` must not fall as ``at`` rises. The last value of each chunk is
    aggregated, carried over the chunks, and only the rows of one chunk are
    sorted in one task: a hot key is split by time.
    """
    rows = df.withColumn("_c", chunk).dropna(subset=[key, at])
    place = F.struct(F.col(at), F.col(tie))
    ends = rows.where(F.col(value).isNotNull()).groupBy(key, "_c").agg(F.max_by(value, place).alias("_v"))
    chunks = rows.select(key, "_c").distinct().join(ends, [key, "_c"], "left")
    before = Window.partitionBy(key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select(key, "_c", F.last("_v", ignorenulls=True).over(before).alias("_carry"))
    inside = Window.partitionBy(key, "_c").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(carried, [key, "_c"]).withColumn("known", F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_carry")))
    return out.drop("_c", "_carry")


def chunks_of(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Adds ``chunk``: rows numbered in ``order`` in groups of n.

    The rows are sorted by range once; a row's number is its place in its range and the rows of
    the ranges before, so no task sees them all. Ties may go either way.
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    out = ranged.withColumn("_p", part).join(F.broadcast(before), "_p")
    return out.withColumn("chunk", F.floor((F.col("_before") + place) / n)).select(*df.columns, "chunk")


def in_all(lists: list[DataFrame], key: str, rank: str) -> DataFrame:
    """(key, rank) of the first ranked list for keys that all lists have."""
    out = lists[0].select(key, rank)
    for x in lists[1:]:
        out = out.join(x.select(key).distinct(), key, "left_semi")
    return out
