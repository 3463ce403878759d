"""Exact nearest neighbours by blocks, and what is read off them."""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.lineage import cut as checkpointed
from waymark.lineage import fresh

QUERY_BLOCK = 2_000
TARGET_BLOCK = 20_000


def nearest(queries: DataFrame, targets: DataFrame, group: list[str], k: int, query_block: int = QUERY_BLOCK, target_block: int = TARGET_BLOCK) -> DataFrame:
    """(group, q, t, distance, rank): for each query the k nearest targets of its group, ties by t.

    Both sides have group columns, id and v (an array of doubles of one length).
    A group is cut into blocks of queries and of targets by a hash; each pair of
    blocks is one matrix product, of which k rows per query leave the task, so
    no group, however large, is held by one task and no pairs are shuffled.
    Distances are compared to nine digits. Null groups match nothing.
    """
    nq = queries.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("_qn"))
    nt = targets.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / target_block).cast("int").alias("_tn"))
    blocks = nq.join(nt, group)

    def cut(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        placed = df.join(blocks, group).withColumn(own, F.pmod(F.xxhash64("id"), F.col(mine)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(theirs) - 1))).select(*group, "_q", "_t", "id", "v")

    a, b = cut(queries, "_q", "_t", "_qn", "_tn"), fresh(cut(targets, "_t", "_q", "_tn", "_qn"))
    by = [*group, "_q", "_t"]
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in group] + [f"q {kinds['id']}, t {targets.schema['id'].dataType.simpleString()}, distance double"])

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame(columns=[*group, "q", "t", "distance"], dtype=object)
        y = y.sort_values("id", ignore_index=True)
        p, q = np.stack(x["v"].to_numpy()), np.stack(y["v"].to_numpy())
        m = min(k, len(q))
        out_q, out_t, out_d = [], [], []
        norm = (q * q).sum(1)
        step = max(1, 4_000_000 // len(q))
        for at in range(0, len(p), step):
            part = p[at : at + step]
            rough = (part * part).sum(1)[:, None] + norm - 2 * part @ q.T
            edge = np.partition(rough, m - 1, axis=1)[:, m - 1]
            for i in range(len(part)):
                near = np.flatnonzero(rough[i] <= edge[i] + 1e-6 * (1 + abs(edge[i])))
                d = np.round(np.sqrt(((q[near] - part[i]) ** 2).sum(1)), 9)
                best = np.argsort(d, kind="stable")[:m]
                out_q.append(np.full(len(best), at + i))
                out_t.append(near[best])
                out_d.append(d[best])
        i, j = np.concatenate(out_q), np.concatenate(out_t)
        res = {c: x[c].iloc[0] for c in group}
        return pd.DataFrame({**{c: [v] * len(i) for c, v in res.items()}, "q": x["id"].to_numpy()[i], "t": y["id"].to_numpy()[j], "distance": np.concatenate(out_d)})

    found = a.groupBy(*by).cogroup(b.groupBy(*by)).applyInPandas(lambda x, y: compare(x, y), schema)
    order = Window.partitionBy(*group, "q").orderBy("distance", "t")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def first_same(queries: DataFrame, targets: DataFrame, group: list[str], label: str, query_block: int = QUERY_BLOCK, target_block: int = TARGET_BLOCK) -> DataFrame:
    """(group, q, first, size): the rank, among all ``size`` targets of its group, of the nearest target with the query's label.

    Both sides have group columns, id, v and ``label``. The nearest target of the label is found
    first, then the targets before it (nearer, or as near with a smaller id) are counted
    in blocks as in ``nearest``; only a count per query and block leaves a task. A query
    whose group has no target of its label, or whose label is null, gives no row.
    """
    known = nearest(queries, targets, [*group, label], 1, query_block, target_block).select(*group, "q", F.col("t").alias("_id"), F.col("distance").alias("_d"))
    size = targets.groupBy(*group).agg(F.count(F.lit(1)).alias("size"))
    asked = checkpointed(queries.select(*group, F.col("id").alias("q"), "v").join(known, [*group, "q"]))
    nq = asked.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("_qn"))
    blocks = nq.join(size.select(*group, F.ceil(F.col("size") / target_block).cast("int").alias("_tn")), group)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    a = asked.join(blocks, group).withColumn("_q", block("q", "_qn")).withColumn("_t", spread("_tn")).select(*group, "_q", "_t", "q", "v", "_id", "_d")
    b = targets.join(blocks, group).withColumn("_t", block("id", "_tn")).withColumn("_q", spread("_qn")).select(*group, "_q", "_t", "id", "v")
    b = fresh(b)
    by = [*group, "_q", "_t"]
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in group] + [f"q {kinds['id']}, n bigint"])

    def count_before(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x):
            return pd.DataFrame(columns=[*group, "q", "n"], dtype=object)
        n = np.zeros(len(x), dtype=np.int64)
        if len(y):
            p, q, ids = np.stack(x["v"].to_numpy()), np.stack(y["v"].to_numpy()), y["id"].to_numpy()
            first, edge, norm = x["_id"].to_numpy(), x["_d"].to_numpy(), (q * q).sum(1)
            step = max(1, 4_000_000 // len(q))
            for at in range(0, len(p), step):
                part = p[at : at + step]
                rough = (part * part).sum(1)[:, None] + norm - 2 * part @ q.T
                square = edge[at : at + step, None] ** 2
                slack = 1e-6 * (1 + square + norm)
                n[at : at + step] = (rough < square - slack).sum(1)
                for i in range(len(part)):
                    near = np.flatnonzero(np.abs(rough[i] - square[i]) <= slack[i])
                    d = np.round(np.sqrt(((q[near] - part[i]) ** 2).sum(1)), 9)
                    n[at + i] += ((d < edge[at + i]) | ((d == edge[at + i]) & (ids[near] < first[at + i]))).sum()
        return pd.DataFrame({**{c: [x[c].iloc[0]] * len(x) for c in group}, "q": x["q"].to_numpy(), "n": n})

    found = a.groupBy(*by).cogroup(b.groupBy(*by)).applyInPandas(lambda x, y: count_before(x, y), schema)
    rank = found.groupBy(*group, "q").agg((F.sum("n") + 1).cast("int").alias("first"))
    return rank.join(size, group).select(*group, "q", "first", "size")


def explained(pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """(q, t, dim, percent): each dimension's share of the squared distance of a pair; 0 for equal vectors."""
    x = pairs.select("q", "t").join(queries.select(F.col("id").alias("q"), F.col("v").alias("_a")), "q")
    x = x.join(targets.select(F.col("id").alias("t"), F.col("v").alias("_b")), "t")
    square = F.zip_with("_a", "_b", lambda a, b: (a - b) * (a - b))
    x = x.select("q", "t", square.alias("_s")).withColumn("_all", F.aggregate("_s", F.lit(0.0), lambda s, y: s + y))
    x = x.select("q", "t", "_all", F.posexplode("_s").alias("dim", "_d"))
    return x.select("q", "t", "dim", F.coalesce(F.try_divide(F.lit(100.0) * F.col("_d"), F.col("_all")), F.lit(0.0)).alias("percent"))


def candidates(found: DataFrame, at_least: int, at_most: int, per_query: int) -> DataFrame:
    """(t, distance): the nearest of all found targets, each at its smallest distance; ties by t.

    As many as queries times ``per_query``, but at least ``at_least`` and at most ``at_most``.
    """
    n = found.select("q").distinct().count()
    wanted = min(at_most, max(n * per_query, at_least))
    best = found.groupBy("t").agg(F.min("distance").alias("distance"))
    return best.orderBy("distance", "t").limit(wanted)


def loops(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """(start, steps, length, size, matched): alternate nearest neighbours there and back until any venue comes again.

    ``forward`` and ``backward``: q, t, distance of the single nearest neighbours, size (how many it was chosen from)
    and same (whether both have one category). All starts walk at the same time, one join per step, until the last
    has ended. Distances never rise along a walk, so it ends at the first pair of mutual neighbours, after a few steps;
    only ties of equal distance can lengthen it, and a walk cannot be longer than there are venues. length is the mean
    distance of the steps, size the smallest choice, matched the number of steps within one category. A walk that meets
    a venue without neighbours gives no row.
    """
    parts = ["q", "t", "distance", F.col("size").cast("bigint").alias("_size"), F.col("same").cast("int").alias("_same")]
    hops = [checkpointed(x.select(*parts).withColumnsRenamed({"q": "at", "t": "next", "distance": "d"})) for x in (forward, backward)]
    walk = hops[0].select(F.col("at").alias("start"), "at", F.array("at").alias("seen"), F.lit(0.0).alias("sum"), F.lit(None).cast("bigint").alias("size"), F.lit(0).alias("matched"))
    done = None
    for step in count(1):
        moved = walk.join(hops[1 - step % 2], "at").select(
            "start", F.col("next").alias("at"), "seen", (F.col("sum") + F.col("d")).alias("sum"), F.least("size", "_size").alias("size"), (F.col("matched") + F.col("_same")).alias("matched"),
        )
        moved = checkpointed(moved.withColumn("again", F.array_contains("seen", F.col("at"))))
        over = moved.where("again").select("start", F.lit(step).alias("steps"), (F.col("sum") / step).alias("length"), "size", "matched")
        done = over if done is None else done.unionByName(over)
        walk = moved.where("not again").select("start", "at", F.concat("seen", F.array("at")).alias("seen"), "sum", "size", "matched")
        if not walk.limit(1).count():
            break
    return done


def gain(relevance: Column, rank: Column) -> Column:
    """A result's discounted gain at a rank from 1."""
    return relevance / F.log2(rank + 1)
