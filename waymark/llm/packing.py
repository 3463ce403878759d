"""Packing items whole into containers of fixed capacity, certified by lower bounds.

Items are hashed to partitions and packed there by best-fit decreasing. Dual
feasible functions give each partition a lower bound of its container
count; a partition that meets it is finished. The others keep their full
containers and give up those with gaps; the documents of the gaps are
exchanged, that is hashed anew to fewer partitions, and packed again, until
the bound is met, one partition is left, or a round no longer helps: its
partitions together waste as many containers as those of the round before, and no fewer
documents lie in gaps. ``certificate`` tells which of these ended a container's round.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.lineage import cut

PER_PARTITION = 20_000


def lower_bound(count: np.ndarray, capacity: int) -> int:
    """The largest bound of two families of dual feasible functions, in integers.

    ``count`` has the number of items of each size 0 ... capacity.

    With threshold e <= capacity / 2: items above capacity - e count whole, those
    below e not at all, others by size. With factor k: size s counts
    floor((k + 1) s / capacity) / k, or s itself where (k + 1) s divides evenly.
    """
    size = np.arange(capacity + 1)
    upto, sums = np.cumsum(count), np.cumsum(count * size)
    e = np.arange(1, capacity // 2 + 1)
    whole = upto[-1] - upto[capacity - e]
    bounds = whole * capacity + sums[capacity - e] - sums[e - 1]
    best = max(int(-(-bounds.max() // capacity)) if len(e) else 0, int(-(-sums[-1] // capacity)))
    for k in range(1, 33):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, int(-(-int((count * value).sum()) // (capacity * k))))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of each item; ``sizes`` must not rise. Time is linear in the items times capacity / word size."""
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps, made = 0, 0
    out = np.empty(len(sizes), dtype=np.int64)
    for i, s in enumerate(sizes.tolist()):
        fitting = gaps >> s
        if fitting:
            gap = s + (fitting & -fitting).bit_length() - 1
            b = open_by_gap[gap].pop()
            if not open_by_gap[gap]:
                gaps &= ~(1 << gap)
        else:
            gap, b, made = capacity, made, made + 1
        left = gap - s
        if left:
            open_by_gap[left].append(b)
            gaps |= 1 << left
        out[i] = b
    return out


def _pack_partition(pdf: pd.DataFrame, capacity: int, r: int) -> pd.DataFrame:
    """Packs one partition; ``gap`` marks the containers that may go into the exchange."""
    pdf = pdf.sort_values(["size", "item", "piece"], ascending=[False, True, True], ignore_index=True)
    size = pdf["size"].to_numpy()
    bins = best_fit_decreasing(size, capacity)
    used = int(bins.max()) + 1
    bound = lower_bound(np.bincount(size, minlength=capacity + 1), capacity)
    left = capacity - np.bincount(bins, weights=size, minlength=used)
    gap = (left > left.mean() / 4) & (used > bound)
    names = np.array([f"r{r}-{int(pdf['_p'].iloc[0])}-{b}" for b in range(used)], dtype=object)
    start = pd.Series(size).groupby(bins).cumsum().to_numpy() - size
    return pdf[["item", "piece", "size", "cut", "_p"]].assign(container=names[bins], start=start, gap=gap[bins], bound=bound, used=used)


def _packer(capacity: int, r: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _pack_partition(pdf, capacity, r)

    return run


def pieces(df: DataFrame, item: str, size: str, capacity: int) -> DataFrame:
    """(item, piece, size, cut): an item above the capacity becomes full pieces and a rest; sizes below 1 are left out."""
    s = F.col(size).cast("bigint")
    rows = df.select(F.col(item).alias("item"), s.alias("_s")).where(F.col("item").isNotNull() & (F.col("_s") > 0))
    n = F.ceil(F.col("_s") / capacity).cast("int")
    rows = rows.select("item", "_s", F.posexplode(F.array_repeat(F.lit(0), n)).alias("piece", "_z"))
    return rows.select(
        "item", "piece", F.least(F.lit(capacity), F.col("_s") - F.col("piece").cast("bigint") * capacity).cast("bigint").alias("size"),
        (F.col("_s") > capacity).alias("cut"),
    )


def pack(df: DataFrame, item: str, size: str, capacity: int, per_partition: int = PER_PARTITION) -> DataFrame:
    """Every item's container: item, piece, size, cut, container, start, certificate.

    ``item`` must be unique; items of no size (null, zero, negative) need no
    container and are left out. An item is cut only if it exceeds the capacity:
    into full pieces, each a container of its own, and one rest that is packed
    like an item. ``start`` is the offset inside the container. ``certificate`` is ``full``
    for such a piece, ``bound`` in a partition that meets its lower bound, ``kept`` for a container
    without much of a gap in another one, ``single`` in the only partition left and ``no gain``
    where a round no longer helped. The result is the same for the same rows in any order.
    An empty input gives no rows.
    """
    split = cut(pieces(df, item, size, capacity))
    kind = split.schema["item"].dataType.simpleString()
    schema = f"item {kind}, piece int, size bigint, cut boolean, _p int, container string, start bigint, gap boolean, bound bigint, used bigint"
    name = F.concat_ws("-", F.lit("full"), F.col("item").cast("string"), "piece")
    columns = ["item", "piece", "size", "cut", "container", "start", "certificate"]
    full = split.where(F.col("size") == capacity)
    done = full.withColumns({"container": name, "start": F.lit(0).cast("bigint"), "certificate": F.lit("full")}).select(columns)
    open_ = split.where(F.col("size") < capacity)
    items, wasted = open_.count(), None
    for r in count():
        if not items:
            return done
        parts = -(-items // per_partition)
        key = F.pmod(F.xxhash64("item", "piece", F.lit(r)), F.lit(parts)).cast("int")
        packed = cut(open_.withColumn("_p", key).groupBy("_p").applyInPandas(_packer(capacity, r), schema))
        per = packed.groupBy("_p").agg(F.max(F.col("used") - F.col("bound")).alias("w"), F.sum(F.col("gap").cast("bigint")).alias("g"))
        now = per.agg(F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.sum("g"), F.lit(0))).first()
        stop = "single" if parts == 1 else "no gain" if wasted is not None and now[0] >= wasted and now[1] >= items else None
        certificate = F.when(F.col("used") == F.col("bound"), "bound").when(F.col("gap"), stop).otherwise("kept")
        packed = packed.withColumn("certificate", certificate)
        final = packed if stop else packed.where(~F.col("gap"))
        done = done.unionByName(final.select(columns))
        if stop:
            return done
        open_, items, wasted = packed.where("gap").select("item", "piece", "size", "cut"), now[1], now[0]


def size_counts(packed: DataFrame, capacity: int) -> np.ndarray:
    """The number of pieces of each size 0 ... capacity."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in packed.groupBy("size").count().collect():
        counts[size] = n
    return counts


def report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, pieces, tokens, fullest, overfull, least_containers, used_share.

    least_containers is the certified least number: ``lower_bound`` over the counts
    of all piece sizes, at most ``capacity`` rows. overfull counts containers above the capacity, so it is 0.
    """
    per = packed.groupBy("container").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("k"))
    total = per.agg(
        F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("k"), F.lit(0)).alias("pieces"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"),
        F.max("used").alias("fullest"), F.count(F.when(F.col("used") > capacity, 1)).alias("overfull"),
    )
    return total.withColumns({
        "least_containers": F.lit(lower_bound(size_counts(packed, capacity), capacity)).cast("bigint"),
        "used_share": F.col("tokens") / (F.col("containers") * capacity),
    })
