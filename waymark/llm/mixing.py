"""Mixing sources to target weights, with capped repetition.

The budget goes down a tree of domains, languages and sources. A node whose
whole capacity is below its share keeps its capacity, and what it lacks goes to
its siblings in proportion to their weights; only what all siblings together
cannot take is left to the parent's siblings. Each leaf then takes a prefix of
its documents in a seeded order, epoch after epoch, up to its budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.lineage import cut

BUCKETS = 4_096
#: Plans up to this many leaves are broadcast (some 10 MB).
BROADCAST_LEAVES = 100_000


def spread(docs: DataFrame, targets: DataFrame, levels: list[str]) -> DataFrame:
    """(levels, weight, max_repeat): ``targets``, which lack some of the ``levels``, divided over the branches ``docs`` have.

    A target's weight is divided in proportion to the tokens of its branches, its max_repeat
    holds in each. A target without tokens is one leaf, ``none`` in the missing levels. A null level of a document is ``none`` too,
    unless the target names the level: such documents belong to no target.
    """
    have = [c for c in levels if c in targets.columns]
    missing = [c for c in levels if c not in targets.columns]
    named = docs.dropna(subset=have).withColumns({c: F.coalesce(F.col(c), F.lit("none")) for c in missing})
    sizes = named.groupBy(*levels).agg(F.sum("tokens").alias("_s")).where("_s > 0")
    rows = targets.join(sizes, have, "left").withColumns({c: F.coalesce(F.col(c), F.lit("none")) for c in missing})
    part = F.col("_s") / F.sum("_s").over(Window.partitionBy(*have))
    return rows.withColumn("weight", F.col("weight") * F.coalesce(part, F.lit(1.0))).select(*levels, "weight", "max_repeat")


def _filled(nodes: DataFrame, path: list[str]) -> DataFrame:
    """Adds ``budget`` to the nodes (_w, _cap) below each ``path``, whose budget is ``_parent``.

    Sorted by capacity over weight, the first i nodes being full leaves the level
    (budget - their capacity) / (other weight) to the rest; it rises while nodes fill up and falls
    after, so its largest value is the true one: min(capacity, weight * level).
    """
    room = (F.col("_w") > 0) & (F.col("_cap") > 0)
    whole = Window.partitionBy(*path)
    order = whole.orderBy(F.when(room, F.col("_cap") / F.col("_w")).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)

    def inside(c: str) -> Column:
        return F.when(room, F.col(c)).otherwise(0.0)

    def before(c: str) -> Column:
        return F.coalesce(F.sum(inside(c)).over(order), F.lit(0.0))

    left = F.least(F.col("_parent"), F.sum(inside("_cap")).over(whole)) - before("_cap")
    rows = nodes.withColumn("_level", F.when(room, left / (F.sum(inside("_w")).over(whole) - before("_w"))))
    level = F.greatest(F.max("_level").over(whole), F.lit(0.0))
    return rows.withColumn("budget", F.when(room, F.least(F.col("_cap"), F.col("_w") * level)).otherwise(0.0)).drop("_level")


def plan(docs: DataFrame, targets: DataFrame, levels: list[str], total: int | None = None) -> DataFrame:
    """One row per leaf: levels, weight, max_repeat, size, cap, want, budget, short.

    ``docs`` has the levels and tokens; ``targets`` the levels, weight and
    max_repeat. ``total`` defaults to the size of
    all leaves. size is exact over all documents, 0 for a leaf without any. A
    leaf is short if want > cap = max_repeat * size. Null or negative weights and
    repetitions count as 0. Documents of other leaves, and of a null level,
    are not part of the mixture. Repeated target rows of one leaf are a
    ValueError. One pass per level of the tree; nothing comes to the driver.
    """
    goal = targets.groupBy(*levels).agg(
        F.max(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).alias("weight"),
        F.max(F.greatest(F.coalesce("max_repeat", F.lit(0)), F.lit(0))).alias("max_repeat"),
        F.count(F.lit(1)).alias("_k"),
    )
    sizes = docs.dropna(subset=levels).groupBy(*levels).agg(F.sum(F.greatest(F.col("tokens"), F.lit(0))).alias("size"))
    leaves = cut(goal.join(sizes, levels, "left").withColumn("size", F.coalesce("size", F.lit(0)).cast("bigint")))
    if leaves.where("_k > 1").limit(1).count():
        raise ValueError("a leaf has several target rows")
    leaves = leaves.drop("_k").withColumn("cap", (F.col("max_repeat") * F.col("size")).cast("double"))
    whole = leaves.agg(F.coalesce(F.sum("size") if total is None else F.lit(total), F.lit(0)).cast("double").alias("_total"))
    leaves = leaves.join(F.broadcast(whole)).withColumn("want", F.col("weight") * F.col("_total"))
    above = leaves.agg(F.least(F.max("_total"), F.sum("want")).alias("_parent"))
    for k in range(len(levels)):
        path = levels[: k + 1]
        useful = F.when(F.col("weight") > 0, F.col("cap")).otherwise(0.0)
        nodes = leaves.groupBy(*path).agg(F.sum("weight").alias("_w"), F.sum(useful).alias("_cap"))
        nodes = nodes.join(F.broadcast(above)) if k == 0 else nodes.join(above, levels[:k])
        above = _filled(nodes, levels[:k]).select(*path, F.col("budget").alias("_parent"))
    planned = leaves.join(above.withColumnRenamed("_parent", "budget"), levels)
    return cut(planned.select(*levels, "weight", "max_repeat", "size", "cap", "want", "budget", (F.col("want") > F.col("cap")).alias("short")))


def select(docs: DataFrame, planned: DataFrame, levels: list[str], key: str, seed: int = 7) -> DataFrame:
    """(levels, key, tokens, copies): how often each document is taken, at least once.

    Every full epoch takes all documents of the leaf; the last epoch takes those
    that end inside the rest of the budget, in the order of a seeded hash (ties
    by ``key``). The order is cut without sorting a leaf in one task: token sums of
    ``BUCKETS`` hash ranges tell which range holds the end, and only that range is
    ordered. Documents without tokens are never taken.
    """
    leaves = planned.select(*levels, "size", "budget")
    leaves = F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves
    epochs = F.when(F.col("size") > 0, F.floor((F.col("budget") + 1e-6) / F.col("size"))).otherwise(0)
    rows = docs.select(*levels, F.col(key).alias("_key"), "tokens").where("tokens > 0").join(leaves, levels)
    rows = rows.withColumn("_full", epochs).withColumn("_rest", F.col("budget") - F.col("_full") * F.col("size"))
    order = F.xxhash64(F.lit(seed), "_full", "_key")
    rows = rows.withColumn("_h", order).withColumn("_b", F.floor((F.col("_h") / 2.0**64 + 0.5) * BUCKETS))
    sums = rows.groupBy(*levels, "_b").agg(F.sum("tokens").alias("_t"))
    before = F.sum("_t").over(Window.partitionBy(*levels).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_t")
    edges = sums.select(*levels, "_b", before.alias("_before"), "_t")
    rows = rows.join(edges, [*levels, "_b"])
    inside = F.col("_before") + F.col("_t") <= F.col("_rest")
    border = ~inside & (F.col("_before") < F.col("_rest"))
    run = F.sum("tokens").over(Window.partitionBy(*levels, "_b").orderBy("_h", "_key").rowsBetween(Window.unboundedPreceding, 0))
    edge = rows.where(border).withColumn("_extra", F.when(F.col("_before") + run <= F.col("_rest"), 1).otherwise(0))
    rest = rows.where(~border).withColumn("_extra", F.when(inside, 1).otherwise(0))
    out = edge.unionByName(rest).withColumn("copies", (F.col("_full") + F.col("_extra")).cast("int"))
    return out.where("copies > 0").select(*levels, F.col("_key").alias(key), "tokens", "copies")


def report(planned: DataFrame, chosen: DataFrame, levels: list[str]) -> DataFrame:
    """The plan with taken tokens, the share really reached, and the largest repetition; null shares if nothing was taken."""
    took = chosen.groupBy(*levels).agg(F.sum(F.col("tokens") * F.col("copies")).alias("taken"), F.max("copies").alias("most_copies"))
    rows = planned.join(took, levels, "left").withColumns({"taken": F.coalesce("taken", F.lit(0)), "most_copies": F.coalesce("most_copies", F.lit(0))})
    return rows.withColumn("share", F.try_divide("taken", F.sum("taken").over(Window.partitionBy())))
