"""How often two items occur in the same record, by stripes.

Items that are too rare for the wanted pair count are left out first (exactly:
a pair is never more frequent than its rarer item), the others get integers. Each
task turns its records into stripes: for an item an associative array of the
later items of the same records with their counts. Stripes go to their item (those of
a hot item by ranges of the neighbours) and are merged there array by array.
Then each pair gets its lift, its log-likelihood ratio and whether that is significant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.lineage import cut
from waymark.llm.distinct import dictionary

#: Entries of the local associative arrays before they are handed on.
STRIPE_ENTRIES = 1_000_000
#: Pairs formed in one NumPy step.
STEP = 500_000
#: Codes of neighbours in one part of a stripe, so the most entries of a merged array.
PART = 512
#: So many of the most frequent items are broadcast (some 10 MB); the others, each in few rows, are joined by shuffle.
BROADCAST_ITEMS = 100_000
#: The 0.999 quantile of the chi-squared distribution with one degree of freedom.
SIGNIFICANT = 10.828

Entries = tuple[np.ndarray, np.ndarray, np.ndarray]
NONE: Entries = (np.empty(0, dtype=np.int64),) * 3


def _pairs(items: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(earlier, later) item of all pairs in each record, in steps of about STEP pairs; records lie one after the other."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    after = ends - np.arange(len(items)) - 1
    total = np.concatenate([[0], np.cumsum(after)])
    for at in range(0, int(total[-1]), STEP):
        k = np.arange(at, min(at + STEP, int(total[-1])))
        i = np.searchsorted(total, k, "right") - 1
        yield items[i], items[i + 1 + (k - total[i])]


def _added(first: Entries, second: Entries) -> Entries:
    """Both associative arrays (item, other, count) as one, in order."""
    a, b, n = (np.concatenate(x) for x in zip(first, second))
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    if not len(a):
        return a, b, n
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[new], b[new], np.add.reduceat(n, new)


def _stripe_rows(entries: Entries) -> pd.DataFrame:
    """Ordered entries as rows item, part, others, counts."""
    a, b, n = entries
    part = b // PART
    at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (part[1:] != part[:-1])])) if len(a) else np.empty(0, dtype=int)
    lists = {c: pd.Series(np.split(x, at[1:]) if len(at) else [], dtype=object) for c, x in (("others", b), ("counts", n))}
    return pd.DataFrame({"item": a[at], "part": part[at], **lists})


def _baskets(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(items, sizes) of whole records from rows (record, code) in the order of record; items ascend inside a record."""

    def ordered(rec: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return code[np.lexsort((code, rec))], np.unique(rec, return_counts=True)[1]

    rec = code = np.empty(0, dtype=np.int64)
    for batch in batches:
        rec, code = np.concatenate([rec, batch["record"].to_numpy()]), np.concatenate([code, batch["code"].to_numpy()])
        if len(rec):
            last = int(np.searchsorted(rec, rec[-1]))
            yield ordered(rec[:last], code[:last])
            rec, code = rec[last:], code[last:]
    yield ordered(rec, code)


def _stripes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = NONE
    for items, sizes in _baskets(batches):
        for a, b in _pairs(items, sizes):
            held = _added(held, (a, b, np.ones(len(a), dtype=np.int64)))
            if len(held[0]) > STRIPE_ENTRIES:
                yield _stripe_rows(held)
                held = NONE
    yield _stripe_rows(held)


def _merger(least: int):
    """Merges the stripes of each item and part, which come in that order; counts below ``least`` are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(entries: Entries) -> pd.DataFrame:
            enough = entries[2] >= least
            return _stripe_rows(tuple(x[enough] for x in entries)).drop(columns="part")

        held = NONE
        for batch in batches:
            if not len(batch):
                continue
            sizes = batch["others"].str.len().to_numpy()
            other, count = (np.concatenate(batch[c].to_numpy()).astype(np.int64) for c in ("others", "counts"))
            held = _added(held, (np.repeat(batch["item"].to_numpy(), sizes), other, count))
            open_ = (held[0] == held[0][-1]) & (held[1] // PART == held[1][-1] // PART)
            yield done(tuple(x[~open_] for x in held))
            held = tuple(x[open_] for x in held)
        yield done(held)

    return run


def _llr(k11: Column, a: Column, b: Column, n: Column) -> Column:
    """Twice the log-likelihood ratio of a 2 x 2 table with cell k11 and margins a, b of n."""

    def part(k: Column, row: Column, column: Column) -> Column:
        return F.when(k > 0, k * F.log(k * n / (row * column))).otherwise(0.0)

    rest_a, rest_b = n - a, n - b
    cells = part(k11, a, b) + part(a - k11, a, rest_b) + part(b - k11, rest_a, b) + part(n - a - b + k11, rest_a, rest_b)
    return 2 * cells


def _look_up(df: DataFrame, column: str, few: DataFrame, rest: DataFrame | None) -> DataFrame:
    """``df`` joined on ``column`` with the frequent items by broadcast and, if there are, with the rest by shuffle."""
    if rest is None:
        return df.join(F.broadcast(few), column)
    tried = df.join(F.broadcast(few.withColumn("_hit", F.lit(True))), column, "left")
    missed = tried.where(F.col("_hit").isNull()).select(df.columns)
    return tried.where("_hit").drop("_hit").unionByName(missed.join(rest, column))


def pairs(recs: DataFrame, least: int = 1, significant: float = SIGNIFICANT) -> DataFrame:
    """Pairs of different items in one record, item_a < item_b.

    ``recs`` has id (unique) and terms (array without nulls); a repeated term
    counts once. Columns: item_a, item_b, n_ab, n_a, n_b, n (records with an
    item), lift = n_ab * n / (n_a * n_b), llr, significant (llr of at least that and a lift above 1).
    Pairs in fewer than ``least`` records are left out, all others are complete.
    """
    items = recs.select(F.monotonically_increasing_id().alias("record"), "terms").select("record", F.explode(F.array_distinct("terms")).alias("term"))
    counts = items.groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).where(F.col("n_term") >= least)
    coded = cut(dictionary(counts, "term").withColumnRenamed("value", "term").join(counts, "term"))
    few, rest = coded, None
    if coded.count() > BROADCAST_ITEMS:
        few = cut(coded.orderBy(F.desc("n_term"), "term").limit(BROADCAST_ITEMS))
        rest = coded.join(few.select("term"), "term", "left_anti")
    codes = [None if x is None else x.select("term", "code") for x in (few, rest)]
    rows = _look_up(items, "term", *codes).select("record", "code")
    if rest is not None:
        # a broadcast join leaves a record's rows together, a shuffled one does not
        rows = rows.repartition("record").sortWithinPartitions("record")
    shape = "others array<bigint>, counts array<bigint>"
    stripes = rows.mapInPandas(_stripes, f"item bigint, part bigint, {shape}")
    merged = stripes.repartition("item", "part").sortWithinPartitions("item", "part").mapInPandas(_merger(least), f"item bigint, {shape}")
    named = merged.select("item", F.inline(F.arrays_zip("others", "counts"))).withColumnsRenamed({"item": "i0", "others": "i1", "counts": "n_ab"})
    for k in range(2):
        ends = [None if x is None else x.select(F.col("code").alias(f"i{k}"), F.struct(F.col("term").alias("t"), F.col("n_term").alias("k")).alias(f"e{k}")) for x in (few, rest)]
        named = _look_up(named, f"i{k}", *ends)
    total = recs.where(F.size("terms") > 0).agg(F.count(F.lit(1)).alias("n"))
    ends = F.array_sort(F.array("e0", "e1"))
    out = named.crossJoin(F.broadcast(total)).select("n_ab", "n", ends[0].alias("a"), ends[1].alias("b"))
    out = out.select(F.col("a.t").alias("item_a"), F.col("b.t").alias("item_b"), "n_ab", F.col("a.k").alias("n_a"), F.col("b.k").alias("n_b"), "n")
    num = [F.col(c).cast("double") for c in ("n_ab", "n_a", "n_b", "n")]
    out = out.withColumns({"lift": num[0] * num[3] / (num[1] * num[2]), "llr": _llr(*num)})
    return out.withColumn("significant", (F.col("llr") >= significant) & (F.col("lift") > 1))
