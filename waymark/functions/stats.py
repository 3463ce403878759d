"""Statistics over counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entropy(c: Column) -> Column:
    """Aggregate: natural entropy of counts, ln N - sum(c ln c) / N over positive counts; null without any."""
    pos = F.when(c > 0, c.cast("double"))
    n = F.sum(pos)
    return F.when(n > 0, F.log(n) - F.sum(pos * F.log(pos)) / n)


def entropy_by(df: DataFrame, keys: list[str], value: list[str] | str) -> DataFrame:
    """(keys, n, entropy) of the multiplicities of ``value`` in each group: two aggregations, both combined before the shuffle."""
    values = [value] if isinstance(value, str) else value
    counts = df.groupBy(*keys, *values).agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy(*keys).agg(F.sum("_c").alias("n"), entropy(F.col("_c")).alias("entropy"))


def kl_divergence(t: Column, b: Column, total_b: Column) -> Column:
    """Aggregate over the cells of a tag: divergence of its counts t from background counts b with total ``total_b``.

    sum of (t / T) * (ln(t / b) + ln(B / T)); cells with either at 0 add nothing.
    """
    both = (t > 0) & (b > 0)
    tt, bb = F.sum(t).cast("double"), F.max(total_b).cast("double")
    part = F.sum(F.when(both, t * F.log(t / b)).otherwise(0.0))
    mass = F.sum(F.when(both, t).otherwise(0))
    return F.when((tt > 0) & (bb > 0), part / tt + mass / tt * F.log(bb / tt))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Aggregate: Jensen-Shannon divergence of two distributions given per bin, natural log."""

    def h(x: Column) -> Column:
        return F.sum(F.when(x > 0, -x * F.log(x)).otherwise(0.0))

    return h((p + q) / 2) - (h(p) + h(q)) / 2


def f_score(recall: Column, precision: Column, beta: float = 2.0) -> Column:
    """The weighted harmonic mean; 0 when both are 0."""
    b = beta * beta
    return F.coalesce(F.try_divide((1 + b) * recall * precision, b * precision + recall), F.lit(0.0))


def discrepancy(m: Column, b: Column, total_m: Column, total_b: Column, support: int) -> Column:
    """Scan statistic of a region with m measured and b background events.

    Null unless both reach ``support`` and the measured share exceeds the
    background share: m' ln(m'/b') + (1-m') ln((1-m')/(1-b')).
    """
    pm, pb = m / total_m, b / total_b
    inner = pm * F.log(pm / pb) + F.when(pm < 1, (1 - pm) * F.log((1 - pm) / (1 - pb))).otherwise(0.0)
    return F.when((m >= support) & (b >= support) & (pm > pb) & (pb < 1), inner)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over joint members of two arrays; 1 for two empty ones."""
    joint = F.size(F.array_union(a, b))
    return F.when(joint == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / joint)
