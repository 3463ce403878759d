"""Venue feature vectors: cleaning, standardisation, histograms, correlation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The order of a venue's 31 features.
NAMES = [
    "likes", "users", "checkins", "publicness", "density", "category", "art", "education", "food", "night", "recreation", "shop",
    "professional", "residence", "transport", "focus", "photogeny", "weekend", "activity1", "activity2", "activity3", "activity4",
    "activity5", "activity6", "opening", "surrounding1", "surrounding2", "surrounding3", "surrounding4", "surrounding5", "surrounding6",
]
CATEGORY, WEEKEND = 5, 17
MEASURES = [i for i in range(31) if i != CATEGORY]


def cleaned(df: DataFrame, city: Column, venue: str, f: str) -> DataFrame:
    """(city, venue, top, sub, f): one row per city and venue with all 31 entries.

    Not-a-number and infinite entries become 0, each by itself. Of several rows of
    a venue the smallest array counts. top is the top category of the category code, sub the code.
    """
    number = F.transform(f, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x + F.lit(0.0)))
    rows = df.where((F.size(f) == len(NAMES)) & F.col(venue).isNotNull()).select(city.alias("city"), F.col(venue).alias("venue"), number.alias("f"))
    rows = rows.where("city is not null").groupBy("city", "venue").agg(F.min("f").alias("f"))
    code = F.get("f", CATEGORY).cast("bigint")
    return rows.select("city", "venue", F.floor(code / 100_000).alias("top"), code.alias("sub"), "f")


def logged(f: Column) -> Column:
    """Natural logarithms of the three leading counts, 0 for 0 and below."""
    head = [F.when(F.get(f, i) > 0, F.log(F.get(f, i))).otherwise(F.lit(0.0)) for i in range(3)]
    return F.concat(F.array(*head), F.slice(f, 4, len(NAMES) - 3))


def standardised(rows: DataFrame) -> DataFrame:
    """(city, venue, top, sub, z): measures centred and scaled by their city's population deviation.

    The weekend flag stays as it is, the category is left out; a constant feature becomes 0.
    """
    x = rows.withColumn("f", logged(F.col("f")))
    get = lambda i: F.get("f", i)
    per = x.groupBy("city").agg(
        F.array(*[F.avg(get(i)) for i in MEASURES]).alias("_m"), F.array(*[F.stddev_pop(get(i)) for i in MEASURES]).alias("_s")
    )
    z = []
    for k, i in enumerate(MEASURES):
        spread = F.get("_s", k)
        z.append(get(i) if i == WEEKEND else F.when(spread > 1e-12, (get(i) - F.get("_m", k)) / spread).otherwise(F.lit(0.0)))
    return x.join(per, "city").select("city", "venue", "top", "sub", F.array(*z).alias("z"))


def histogram(rows: DataFrame, keys: list[str], vector: str, weight: Column | None = None, bins: int = 10) -> DataFrame:
    """(keys, dim, bin, p): weighted shares in equal bins between each dimension's extremes over all rows.

    The last bin is closed; a constant dimension has everything in its last bin.
    """
    flat = rows.select(*keys, (F.lit(1.0) if weight is None else weight).alias("_w"), F.posexplode(vector).alias("dim", "x"))
    support = flat.groupBy("dim").agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    bin_ = F.when(span > 0, F.least(F.floor((F.col("x") - F.col("_lo")) / span * bins), F.lit(bins - 1))).otherwise(bins - 1)
    counted = flat.join(F.broadcast(support), "dim").groupBy(*keys, "dim", bin_.cast("int").alias("bin")).agg(F.sum("_w").alias("_n"))
    total = counted.groupBy(*keys, "dim").agg(F.sum("_n").alias("_t"))
    return counted.join(total, [*keys, "dim"]).select(*keys, "dim", "bin", (F.col("_n") / F.col("_t")).alias("p"))


def moments(rows: DataFrame, vector: str, width: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, sums and cross products over all rows, from one aggregation that leaves ``width`` squared numbers."""
    v = [F.get(vector, i) for i in range(width)]
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    sums = [F.sum(c) for c in v] + [F.sum(v[i] * v[j]) for i, j in pairs]
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("s")).first()
    s = np.array([x or 0.0 for x in out["s"]])
    cross = np.zeros((width, width))
    for (i, j), x in zip(pairs, s[width:]):
        cross[i, j] = cross[j, i] = x
    return float(out["n"]), s[:width], cross


def mutual_information(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mi): mutual information of binned a and b over the root of their entropies' product; 0 for a constant."""
    n = pairs.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(*keys).agg(F.sum("n").alias("t"))
    ma, mb = n.groupBy(*keys, "a").agg(F.sum("n").alias("na")), n.groupBy(*keys, "b").agg(F.sum("n").alias("nb"))
    j = n.join(total, keys).join(ma, [*keys, "a"]).join(mb, [*keys, "b"])
    mi = j.groupBy(*keys).agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("i"))

    def h(m: DataFrame, c: str, name: str) -> DataFrame:
        return m.join(total, keys).groupBy(*keys).agg(F.sum(-F.col(c) / F.col("t") * F.log(F.col(c) / F.col("t"))).alias(name))

    both = mi.join(h(ma, "na", "ha"), keys).join(h(mb, "nb", "hb"), keys)
    return both.select(*keys, F.coalesce(F.try_divide(F.col("i"), F.sqrt(F.col("ha") * F.col("hb"))), F.lit(0.0)).alias("mi"))
