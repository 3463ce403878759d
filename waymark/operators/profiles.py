"""Activity profiles of venues, users and tags: counts, histograms, spans and entropies.

Every operator works on flat rows; nothing collects the visits of a venue
or the photos of a user into one array. Null keys are left out, other columns of
the input are ignored, and an empty input gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import clock
from waymark.functions.stats import entropy, entropy_by

MONTH_S = int(365.24 / 12 * 86_400)


def visitor_entropy(rows: DataFrame, place: str, visitor: str) -> DataFrame:
    """(place, n, entropy): how evenly the visits are spread over visitors."""
    return entropy_by(rows.dropna(subset=[place, visitor]), [place], visitor)


def hour_entropy(rows: DataFrame, place: str, at: str) -> DataFrame:
    """(place, n, entropy): entropy of the 24 hours of the day over ln 24, between 0 and 1."""
    hours = rows.dropna(subset=[place, at]).select(place, F.hour(at).alias("_h"))
    return entropy_by(hours, [place], "_h").withColumn("entropy", F.col("entropy") / math.log(24))


def histogram(rows: DataFrame, keys: list[str], bin_: Column, weight: Column | None = None) -> DataFrame:
    """(keys, bin, n): (weighted) counts per bin; rows without a bin are left out."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return rows.dropna(subset=keys).withColumn("bin", bin_).where(F.col("bin").isNotNull()).groupBy(*keys, "bin").agg(n.alias("n"))


def to_frequency(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Adds ``share``: n over the sum of its group; null where that is 0. The group sum is an aggregation and a join, not a window."""
    total = counts.groupBy(*keys).agg(F.sum(n).alias("_total"))
    return counts.join(total, keys).withColumn("share", F.try_divide(F.col(n), F.col("_total"))).drop("_total")


def day_profile(rows: DataFrame, keys: list[str], at: str, chunk: int = 4, offset: int = 1) -> DataFrame:
    """(keys, bin, n, share): activity in ``chunk``-hour slices of the day, the first from ``offset`` o'clock."""
    return to_frequency(histogram(rows, keys, clock.hour_chunk(F.col(at), chunk, offset)), keys)


def week_profile(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, bin, n, share): activity in the 21 periods of the human week."""
    return to_frequency(histogram(rows, keys, clock.human_period(F.col(at))), keys)


def weekend_share(rows: DataFrame, place: str, at: str) -> DataFrame:
    """(place, n, share, weekend): weekend if strictly more than half of the visits fall on it."""
    out = rows.dropna(subset=[place, at]).groupBy(place).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(clock.weekend(F.col(at)), 1.0).otherwise(0.0)).alias("share")
    )
    return out.withColumn("weekend", F.col("share") > 0.5)


def spans(rows: DataFrame, user: str, at: str) -> DataFrame:
    """(user, first, last, n, tourist): a tourist's records span less than a month."""
    out = rows.dropna(subset=[user, at]).groupBy(user).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("tourist", clock.epoch_s(F.col("last")) - clock.epoch_s(F.col("first")) < MONTH_S)


def support(rows: DataFrame, tag: str, user: str, at: str) -> DataFrame:
    """(tag, n, users, first, last, days): what backs a tag."""
    per = rows.dropna(subset=[tag]).groupBy(tag, user).agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_f"), F.max(at).alias("_l"))
    out = per.groupBy(tag).agg(F.sum("_n").alias("n"), F.count(user).alias("users"), F.min("_f").alias("first"), F.max("_l").alias("last"))
    return out.withColumn("days", (clock.epoch_s(F.col("last")) - clock.epoch_s(F.col("first"))) / 86_400)


def supported(rows: DataFrame, tag: str, user: str, at: str, records: int = 150, users: int = 25, days: float = 500) -> DataFrame:
    """``support`` rows with at least so many records and users over more than so many days."""
    return support(rows, tag, user, at).where((F.col("n") >= records) & (F.col("users") >= users) & (F.col("days") > days))


def period_entropies(rows: DataFrame, tag: str, at: str, steps: tuple[int, ...] = (1, 7, 30, 91, 365), origin: str = "2008-01-01") -> DataFrame:
    """(tag, step, n, entropy) of the periods of each length in days since ``origin``.

    Days are counted first; the longer periods are sums of day counts, so the rows are read and shuffled once.
    """
    days = rows.dropna(subset=[tag, at]).groupBy(tag, clock.time_cell(F.col(at), 1, origin).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    each = days.select(tag, "_n", "_d", F.explode(F.array(*[F.lit(s) for s in steps])).alias("step"))
    periods = each.groupBy(tag, "step", F.floor((F.col("_d") - 1) / F.col("step")).alias("_p")).agg(F.sum("_n").alias("_n"))
    return periods.groupBy(tag, "step").agg(F.sum("_n").alias("n"), entropy(F.col("_n")).alias("entropy"))


def weekday_bucket_entropy(rows: DataFrame, tag: str, at: str) -> DataFrame:
    """(tag, n, entropy) over pairs of weekday and 4-hour slice."""
    slots = rows.dropna(subset=[tag, at]).select(tag, F.weekday(at).alias("_w"), F.floor(F.hour(at) / 4).alias("_b"))
    return entropy_by(slots, [tag], ["_w", "_b"])


def ranked(counts: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows with their rank from 1: a top-k, then a window over these k rows only."""
    best = counts.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("int"))


def rank_movement(before: DataFrame, after: DataFrame, key: str, n: str, k: int) -> DataFrame:
    """(key, status, move, n_before, n_after, change, relative): the top k before and where they went.

    status: new, = , + (risen) or - (fallen); move is the number of ranks, null for new.
    """
    a = ranked(before, [F.col(n).desc(), F.col(key)], k).select(key, F.col("rank").alias("_a"), F.col(n).alias("n_before"))
    b = ranked(after, [F.col(n).desc(), F.col(key)], k).select(key, F.col("rank").alias("_b"), F.col(n).alias("n_after"))
    out = b.join(a, key, "left").withColumn("move", F.col("_a") - F.col("_b"))
    status = F.when(F.col("_a").isNull(), "new").when(F.col("move") > 0, "+").when(F.col("move") < 0, "-").otherwise("=")
    change = F.col("n_after") - F.col("n_before")
    return out.select(key, status.alias("status"), "move", "n_before", "n_after", change.alias("change"), F.try_divide(change, F.col("n_before")).alias("relative"))


def gravity(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, n, cx, cy, mean_d2, std_d2): centroid, mean and population deviation of the squared distance from it."""
    some = rows.dropna(subset=[key, x, y])
    centre = some.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("cx"), F.avg(y).alias("cy"))
    d2 = (F.col(x) - F.col("cx")) * (F.col(x) - F.col("cx")) + (F.col(y) - F.col("cy")) * (F.col(y) - F.col("cy"))
    off = some.select(key, x, y).join(centre, key).groupBy(key, "n", "cx", "cy").agg(F.avg(d2).alias("mean_d2"), F.stddev_pop(d2).alias("std_d2"))
    return off


def pair_moments(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, pairs, mean_d2): the number of pairs of a key's points and their mean squared distance.

    Half the sum of all squared pair distances is n times the squares about the mean, so no pair is formed; null coordinates are left out.
    """
    some = rows.dropna(subset=[key, x, y])
    per = some.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"))
    n = F.col("_n")
    return per.where(n > 1).select(key, (n * (n - 1) / 2).cast("bigint").alias("pairs"), (2 * n / (n - 1) * (F.col("_vx") + F.col("_vy"))).alias("mean_d2"))


def category_summary(venues: DataFrame, categories: DataFrame, depth: int) -> DataFrame:
    """(category, name, venues, likes, share): venues and likes of each category, rolled up to its ancestor at ``depth``.

    ``venues`` has cat and likes; a shallower category stands for itself; unknown categories are left out.
    """
    ancestor = F.element_at("path", F.least(F.lit(depth), F.size("path")))
    up = categories.select(F.col("id").alias("cat"), ancestor.alias("category"))
    rows = venues.join(up, "cat").groupBy("category").agg(F.count(F.lit(1)).alias("venues"), F.sum(F.coalesce("likes", F.lit(0))).alias("likes"))
    names = categories.select(F.col("id").alias("category"), "name")
    whole = Window.partitionBy()
    return rows.join(names, "category", "left").withColumn("share", F.col("venues") / F.sum("venues").over(whole))


def sampled(df: DataFrame, n: int, seed: int, keys: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """n random rows, of each ``keys`` group if given; the same rows for the same seed and values.

    The order is a seeded hash of ``by`` (all columns by default), so no state of
    the cluster enters; the top n are kept per task before anything is shuffled.
    """
    order = [F.xxhash64(F.lit(seed), *(by or df.columns)), *[F.col(c) for c in (by or [])]]
    if not keys:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def tag_rows(rows: DataFrame, tag: str | None = None, start: Column | None = None, end: Column | None = None, user: str | None = None, city: str | None = None) -> DataFrame:
    """Rows of a tag, a half-open time range, a user and a city, each if given: plain filters that reach the files."""
    for given, test in (
        (tag, F.col("tag") == tag), (user, F.col("uid") == user), (city, F.col("city") == city),
    ):
        if given is not None:
            rows = rows.where(test)
    if start is not None:
        rows = rows.where(F.col("t") >= start)
    return rows if end is None else rows.where(F.col("t") < end)


def score_table(scores: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """Mean ``value`` by row and column, with the mean of each row's means, best rows first, ties by name."""
    wide = scores.groupBy(row).pivot(column, columns).agg(F.avg(value))
    named = [F.col(f"`{c}`") for c in columns]
    have = F.filter(F.array(*named), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(have, F.lit(0.0), lambda s, x: s + x), F.size(have))
    return wide.withColumn("mean", mean).orderBy(F.desc("mean"), row)
