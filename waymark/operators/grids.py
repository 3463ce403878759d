"""Counts on a grid of k x k cells per area, and what follows from them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.geo import grid_cell
from waymark.functions.stats import entropy, kl_divergence


def placed(points: DataFrame, boxes: DataFrame, area: str, k: int) -> DataFrame:
    """``points`` (area, lng, lat) with their cell ix, iy inside the box of their own area; others are left out.

    ``boxes``: area, lat_bl, lng_bl, lat_ur, lng_ur, one row per area.
    """
    b = boxes.select(area, "lat_bl", "lng_bl", "lat_ur", "lng_ur")
    joined = points.join(b, area)
    ix, iy = grid_cell(F.col("lat"), F.col("lng"), F.col("lat_bl"), F.col("lng_bl"), F.col("lat_ur"), F.col("lng_ur"), k)
    return joined.withColumns({"ix": ix, "iy": iy}).where("ix is not null").drop("lat_bl", "lng_bl", "lat_ur", "lng_ur")


def frequency(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ix, iy, n), sparse."""
    return cells.groupBy(*keys, "ix", "iy").agg(F.count(F.lit(1)).alias("n"))


def zero_filled(freq: DataFrame, keys: list[str], k: int) -> DataFrame:
    """All k * k cells of each key; the result has at most that many rows per key, whatever was counted."""
    axis = F.sequence(F.lit(0), F.lit(k - 1))
    full = freq.select(*keys).distinct().withColumn("ix", F.explode(axis)).withColumn("iy", F.explode(axis))
    return full.join(freq, [*keys, "ix", "iy"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def coarser(freq: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of 2 x 2 cells."""
    half = [F.floor(F.col(c) / 2).cast("int").alias(c) for c in ("ix", "iy")]
    return freq.groupBy(*keys, *half).agg(F.sum("n").alias("n"))


def concentration(freq: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, n, entropy): entropy of the cell counts over the largest possible one, 2 ln k."""
    out = freq.groupBy(*keys).agg(F.sum("n").alias("n"), entropy(F.col("n")).alias("entropy"))
    return out.withColumn("entropy", F.col("entropy") / (2 * math.log(k)))


def divergence(freq: DataFrame, background: DataFrame, area: list[str], tag: str) -> DataFrame:
    """(area, tag, n, kl, most): divergence of each tag from the background of its area, and the largest possible one.

    ``most`` is the divergence of a tag that stands on the least frequent background cell alone.
    """
    b = background.select(*area, "ix", "iy", F.col("n").alias("b"))
    total = b.groupBy(*area).agg(F.sum("b").alias("_all"), F.min(F.when(F.col("b") > 0, F.col("b"))).alias("_least"))
    joined = freq.join(b, [*area, "ix", "iy"]).join(total, area)
    out = joined.groupBy(*area, tag).agg(F.sum("n").alias("n"), kl_divergence(F.col("n"), F.col("b"), F.col("_all")).alias("kl"), F.max("_all").alias("_all"), F.max("_least").alias("_least"))
    return out.withColumn("most", -F.log(F.col("_least") / F.col("_all"))).drop("_all", "_least")


def both(measured: DataFrame, background: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ix, iy, m, b): two sparse grids side by side, missing counts 0; one shuffle."""
    m = measured.select(*keys, "ix", "iy", F.col("n").alias("m"), F.lit(0).cast("bigint").alias("b"))
    b = background.select(*keys, "ix", "iy", F.lit(0).cast("bigint").alias("m"), F.col("n").alias("b"))
    return m.unionByName(b).groupBy(*keys, "ix", "iy").agg(F.sum("m").alias("m"), F.sum("b").alias("b"))


def trimmed_ratio(two: DataFrame, keys: list[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(keys, cells, ratio): mean of b / m over cells with both, between the percentiles ``low`` and ``high``."""
    r = two.where("m > 0 and b > 0").withColumn("r", F.col("b") / F.col("m"))
    limits = r.groupBy(*keys).agg(F.percentile("r", F.lit(low)).alias("_lo"), F.percentile("r", F.lit(high)).alias("_hi"))
    some = r.join(limits, keys).where("r between _lo and _hi")
    return some.groupBy(*keys).agg(F.count(F.lit(1)).alias("cells"), F.avg("r").alias("ratio"))


def stand_alone(two: DataFrame, keys: list[str], share: float = 0.995, k: int = 500) -> DataFrame:
    """(keys, ix, iy, m): the k largest measured cells above the percentile that have no background, ties by cell."""
    alone = two.where("m > 0 and b < 1")
    limit = alone.groupBy(*keys).agg(F.percentile("m", F.lit(share)).alias("_p"))
    best = Window.partitionBy(*keys).orderBy(F.desc("m"), "ix", "iy")
    rows = alone.join(limit, keys).where(F.col("m") >= F.col("_p"))
    return rows.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).select(*keys, "ix", "iy", "m")


def nonzero_log_ratio(two: DataFrame, measured: Column, background: Column) -> DataFrame:
    """Cells with both, with ln of the shares' ratio."""
    return two.where((measured > 0) & (background > 0)).withColumn("log_ratio", F.log(measured / background))
