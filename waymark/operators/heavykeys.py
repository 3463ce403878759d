"""Per-key results when a few keys hold most rows.

Rows are first compressed to (key, value, frequency) by a hash aggregation
that combines before the shuffle and hashes on key *and* value, so a hot key
is spread over all tasks. Everything per key is then derived from the weighted
values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.lineage import cut

#: Keys whose value bounds are broadcast (20,000 times 64 numbers are 10 MB), and parts of a key beyond.
BROADCAST_KEYS = 20_000
SALTS = 16


def compress(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n): how often each value occurs under each key. Null values are kept."""
    return df.groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def profile(freq: DataFrame, keys: list[str]) -> DataFrame:
    """Records, distinct values and the mode of each key, from ``compress`` output.

    Null values count as records but neither as a distinct value nor as the
    mode. Of equally frequent values the smallest is the mode. All aggregates
    combine before the shuffle and hold one row per key.
    """
    best = F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("m"), F.col("value").alias("v"))))
    return freq.groupBy(*keys).agg(
        F.sum("n").alias("records"), F.count("value").alias("distinct_values"), best.alias("_b")
    ).select(*keys, "records", "distinct_values", F.col("_b.v").alias("mode"), (-F.col("_b.m")).alias("mode_n"))


def heavy(prof: DataFrame, within: str, least_percent: dict[str, int]) -> DataFrame:
    """Keys on at least the given percentage of all records of their ``within`` group; adds group_records.

    ``least_percent`` names the groups asked for. The comparison is in
    integers, so a key exactly on the limit belongs to the result.
    """
    totals = prof.groupBy(within).agg(F.sum("records").alias("group_records"))
    limits = F.create_map(*[F.lit(x) for pair in least_percent.items() for x in pair])
    out = prof.join(totals, within)
    return out.where(F.col("records") * 100 >= F.col("group_records") * F.try_element_at(limits, F.col(within)))


def percentiles(freq: DataFrame, keys: list[str], fractions: list[float], buckets: int = 64) -> DataFrame:
    """Exact nearest-rank percentiles of numeric values for each key: (keys, fraction, value).

    The value of fraction f is the smallest one with at least ceil(f * records)
    weighted records at or below it (f = 0 gives the minimum). Null values are
    left out; keys without values give no row.

    Two steps keep a hot key from being sorted in one task. A mergeable sketch names ``buckets``
    quantiles of each key's different values, so buckets hold about equally many of them however they lie;
    their exact counts name for each fraction the one bucket that holds its rank;
    only the values of those buckets are then ordered. A key's bounds reach its rows
    by broadcast, or beyond ``BROADCAST_KEYS`` keys by a join on the key and a salt.
    """
    rows = freq.where(F.col("value").isNotNull()).select(*keys, F.col("value").cast("double").alias("value"), "n")
    rows = rows.where(~F.isnan("value"))
    cuts = [i / buckets for i in range(1, buckets)]
    bounds = cut(rows.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("value", cuts, 4 * buckets)).alias("_q")))
    if bounds.count() <= BROADCAST_KEYS:
        near = rows.join(F.broadcast(bounds), keys)
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64("value"), F.lit(SALTS)).cast("int"))
        near = salted.join(bounds.withColumn("_salt", salts), [*keys, "_salt"]).drop("_salt")
    bucket = F.size(F.filter("_q", lambda q: q < F.col("value")))
    placed = near.select(*keys, "value", "n", bucket.alias("_b"))
    sums = placed.groupBy(*keys, "_b").agg(F.sum("n").alias("_bn"))
    up_to = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    edges = sums.select(
        *keys, "_b", (F.sum("_bn").over(up_to) - F.col("_bn")).alias("_before"),
        F.sum("_bn").over(up_to).alias("_through"), F.sum("_bn").over(whole).alias("_all"),
    )
    wanted = edges.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    rank = F.greatest(F.lit(1), F.ceil(F.round(F.col("fraction") * F.col("_all"), 9)))
    wanted = wanted.withColumn("_rank", rank).where((F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_through")))
    hit = placed.join(wanted.select(*keys, "_b", "fraction", "_rank", "_before"), [*keys, "_b"])
    order = Window.partitionBy(*keys, "fraction").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    reached = hit.withColumn("_cum", F.sum("n").over(order) + F.col("_before"))
    return reached.where(F.col("_cum") >= F.col("_rank")).groupBy(*keys, "fraction").agg(F.min("value").alias("value"))
