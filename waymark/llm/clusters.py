"""Clusters of mutually similar vectors by density on a grid.

Vectors are turned to their principal axes and quantised there; the cells are counted with
their bounding boxes, so however many rows share a cell, it is one row from here on.
Space is then split into leaves of about as many cells, and a cell goes to every leaf within
half the similarity radius of its box: the boxes of two cells that come within
the radius have a point between them that is so near to both, so they meet in its leaf. A rotation keeps
distances, so no two similar rows lie in cells that do not meet. Links between two cells that
both have too few rows around them are dropped. Minimum labels run along the others
to convergence. Rows of different components are never similar,
so a component is a cluster if all its rows are within half the radius of
its centre; for the others the exact neighbourhoods of their rows decide, without
comparing the rows within half the radius of the middle of the component's largest cell with one another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.lineage import cut
from waymark.operators.graph import components

#: Rows compared with each other in one task, and entries of a distance block.
BLOCK_ROWS = 4_096
BLOCK_ENTRIES = 4_000_000
#: So many leading axes times levels are quantised; a set no wider than the radius meets at most 2 cells along each.
AXES, LEVELS = 32, 1
#: Cells of a leaf, cells sampled to lay the leaves, and cells of a block inside a leaf and of a step of its comparison.
LEAF_CELLS = 8_192
SAMPLE = 50_000
LEAF_BLOCK, LEAF_STEP = 1_024, 256
#: Rows of a table that is broadcast.
BROADCAST_ROWS = 100_000

#: A leaf's split: axis, place, the parts below and above; or its number.
Tree = tuple | int


def vectors(df: DataFrame, item: str, f: str, length: int, dims: list[int]) -> DataFrame:
    """(item, v): rows whose array has ``length`` entries and finite numbers in ``dims``, as often as they come."""
    picked = F.array(*[F.get(F.col(f), i) for i in dims])
    rows = df.where(F.col(item).isNotNull() & (F.size(f) == length)).select(F.col(item).alias("item"), picked.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite).select("item", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def principal_axes(rows: DataFrame, width: int) -> np.ndarray:
    """The directions of all rows by falling variance, as columns."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square, n = np.zeros(width), np.zeros((width, width)), 0
        for b in batches:
            x = _matrix(b, "v", width)
            total, square, n = total + x.sum(0), square + x.T @ x, n + len(x)
        flat = np.concatenate([[n], total, square.ravel()])
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(flat)), pa.int32()), "s": pa.array(flat)})

    flat = np.zeros(1 + width + width * width)
    for r in rows.select("v").mapInArrow(sums, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        flat[r["i"]] = r["s"]
    mean = flat[1 : width + 1] / max(1.0, flat[0])
    spread = flat[width + 1 :].reshape(width, width) / max(1.0, flat[0]) - np.outer(mean, mean)
    return np.linalg.eigh(spread)[1][:, ::-1] if np.isfinite(spread).all() else np.eye(width)


def _keys(x: np.ndarray, radius: float, split: int) -> np.ndarray:
    """The cell of each turned row, as bytes."""
    return np.ascontiguousarray(np.floor(x[:, :split] / radius).astype("<i4")).view(f"V{4 * split}").ravel()


def _placed(rows: DataFrame, turned: np.ndarray, radius: float, split: int) -> DataFrame:
    """(item, v, key): the rows with their cell; computed anew at each use."""
    item = rows.schema["item"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = _keys(_matrix(b, "v", len(turned)) @ turned, radius, split)
            yield pa.RecordBatch.from_arrays([b.column("item"), b.column("v"), pa.array(keys.tolist(), pa.binary())], ["item", "v", "key"])

    return rows.select("item", "v").mapInArrow(place, f"item {item}, v array<double>, key binary")


def _cells(rows: DataFrame, turned: np.ndarray, radius: float, split: int) -> DataFrame:
    """(key, n, lo, hi, cell): the cells with their rows and boxes along the turned axes; rows of a batch are added up before they are shuffled."""
    width = len(turned)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b, "v", width) @ turned
            if not len(x):
                continue
            names = _keys(x, radius, split)
            order = np.argsort(names.view([("", "<i4")] * split), kind="stable")
            x, names = x[order], names[order]
            at = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
            n = np.diff(np.append(at, len(x)))
            ends = pa.array(np.arange(0, width * len(at) + 1, width), pa.int32())
            low, high = (pa.ListArray.from_arrays(ends, pa.array(f.reduceat(x, at).ravel())) for f in (np.minimum, np.maximum))
            yield pa.RecordBatch.from_arrays([pa.array(names[at].tolist(), pa.binary()), pa.array(n, pa.int64()), low, high], ["key", "n", "lo", "hi"])

    parts = rows.select("v").mapInArrow(count, "key binary, n bigint, lo array<double>, hi array<double>")
    lo, hi = (F.array(*[f(F.get(c, i)) for i in range(width)]).alias(c) for f, c in ((F.min, "lo"), (F.max, "hi")))
    return cut(parts.groupBy("key").agg(F.sum("n").alias("n"), lo, hi).withColumn("cell", F.monotonically_increasing_id()))


def _tree(sample: np.ndarray, leaves: int) -> tuple[Tree, int]:
    """Splits at medians along the widest axis into at least ``leaves`` parts, if the sample lasts, and their number."""
    made = 0

    def part(x: np.ndarray, depth: int) -> Tree:
        nonlocal made
        axis = int(np.ptp(x, axis=0).argmax()) if len(x) > 1 else 0
        at = float(np.median(x[:, axis])) if len(x) > 1 else 0.0
        above = x[:, axis] >= at if len(x) > 1 else np.zeros(len(x), dtype=bool)
        if depth <= 0 or above.all() or not above.any():
            made += 1
            return made - 1
        return axis, at, part(x[~above], depth - 1), part(x[above], depth - 1)

    return part(sample, math.ceil(math.log2(max(1, leaves)))), made


def _into(tree: Tree, lo: np.ndarray, hi: np.ndarray, reach: float) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, rows): the boxes within ``reach`` of each leaf."""

    def go(node: Tree, rows: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        if not len(rows):
            return
        if isinstance(node, int):
            yield node, rows
            return
        axis, at, below, above = node
        for child, gap in ((below, lo[rows, axis] - at), (above, at - hi[rows, axis])):
            far = off.copy()
            far[:, axis] = np.maximum(far[:, axis], np.maximum(gap, 0.0))
            near = (far * far).sum(1) <= reach * reach
            yield from go(child, rows[near], far[near])

    yield from go(tree, np.arange(len(lo)), np.zeros(lo.shape))


def _blocks(x: np.ndarray, most: int) -> list[np.ndarray]:
    """The rows in parts of at most ``most``, halved along the widest axis."""
    done, open_ = [], [np.arange(len(x))]
    while open_:
        rows = open_.pop()
        if len(rows) <= most:
            done.append(rows)
            continue
        axis = int(np.ptp(x[rows], axis=0).argmax())
        order = rows[np.argpartition(x[rows, axis], len(rows) // 2)]
        open_ += [order[: len(rows) // 2], order[len(rows) // 2 :]]
    return done


def _meeting(lo: np.ndarray, hi: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j): the pairs of boxes that come within ``radius``, each once, a block at a time.

    A block is compared with the boxes near its own box. Balls around the boxes are compared by one product of matrices in
    single precision, with a margin for its error; the boxes decide on the pairs that are left.
    """
    middle, half = (lo + hi) / 2, np.sqrt(((hi - lo) ** 2).sum(1)) / 2
    parts = _blocks(middle, LEAF_BLOCK)
    order, at = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
    lo, hi, middle, half = lo[order], hi[order], middle[order] - middle.mean(0), half[order]
    low, high = np.minimum.reduceat(lo, at[:-1]), np.maximum.reduceat(hi, at[:-1])
    square, ones, reach = (middle**2).sum(1), np.ones(len(lo)), radius + half
    # |a - b|^2 - (radius + half_a + half_b)^2
    left = np.column_stack([-2 * middle, -2 * reach, square - reach**2, ones])
    right = np.column_stack([middle, half, ones, square - half**2])
    margin = 2e-5 * max(square.max(), reach.max() ** 2)
    if margin <= radius * radius / 10:
        left, right = left.astype(np.float32), right.astype(np.float32)
    else:
        margin = 1e-13 * max(square.max(), reach.max() ** 2)

    def near(p: slice | np.ndarray | int, q: slice | np.ndarray, lo_p: np.ndarray = lo, hi_p: np.ndarray = hi) -> np.ndarray:
        gap = np.maximum(0.0, np.maximum(lo_p[p] - hi[q], lo[q] - hi_p[p]))
        return np.einsum("ij,ij->i", gap, gap) <= radius * radius

    for k, start in enumerate(at[:-1]):
        end = at[k + 1]
        others = start + np.flatnonzero(near(k, slice(start, None), low, high))
        for t in range(0, len(others), LEAF_STEP):
            q = others[t : t + LEAF_STEP]
            off = left[start:end] @ right[q].T
            if off.min() > margin:
                continue
            i, j = np.nonzero(~(off > margin))
            i, j = start + i, q[j]
            i, j = i[i < j], j[i < j]
            met = near(i, j)
            yield order[i[met]], order[j[met]]


def _root(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels with a and b joined; a label is the smallest row of its set and its own label."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _in_leaves(cells: DataFrame, tree: Tree, leaves: int, width: int, radius: float, work, schema: str) -> DataFrame:
    """What ``work`` makes of the cells (cell, n, dense) of each leaf and their boxes."""
    half = radius / 2 + 1e-9

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo, hi = (_matrix(b, c, width) for c in ("lo", "hi"))
            size = 8 * width
            low, high = np.ascontiguousarray(lo).tobytes(), np.ascontiguousarray(hi).tobytes()
            boxes = [low[k : k + size] if low[k : k + size] == high[k : k + size] else low[k : k + size] + high[k : k + size] for k in range(0, len(low), size)]
            boxes = pa.array(boxes, pa.binary())
            for leaf, rows in _into(tree, lo, hi, half):
                at = pa.array(rows)
                columns = [pa.array(np.full(len(rows), leaf), pa.int32()), *[b.column(c).take(at) for c in ("cell", "n", "dense")], boxes.take(at)]
                yield pa.RecordBatch.from_arrays(columns, ["leaf", "cell", "n", "dense", "box"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        one = (pdf["box"].str.len() == 8 * width).to_numpy()
        both = np.frombuffer(b"".join(x * 2 if o else x for x, o in zip(pdf["box"], one)), dtype=float).reshape(-1, 2, width)
        return work(pdf, np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1]))

    sent = cells.select("cell", "n", "dense", "lo", "hi").mapInArrow(send, "leaf int, cell bigint, n bigint, dense boolean, box binary")
    return sent.repartition(leaves, "leaf").groupBy("leaf").applyInPandas(join, schema)


def _small(df: DataFrame) -> DataFrame:
    """``df`` computed once, and broadcast where it is small."""
    known = cut(df)
    return F.broadcast(known) if known.count() <= BROADCAST_ROWS else known


def linked_cells(rows: DataFrame, width: int, radius: float, least: int, axes: int = AXES, levels: int = LEVELS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with their cell's key, cells, links): the cells that have other rows around them or ``least`` themselves, and links that join them.

    ``rows`` has item and v. Cells that come within the radius are joined by links
    (directly or by way of others of their component) unless both have fewer than ``least``
    rows around them, counted as at least as many as there are. Only a sum for each cell and one link
    for each cell and leaf leave a task, however many cells meet.
    """
    split, reach = min(width, axes * levels), radius + 1e-6
    turned = principal_axes(rows, width)
    cells = _cells(rows, turned, radius, split)
    many = cells.count()

    def laid(df: DataFrame, n: int) -> tuple[Tree, int]:
        if n <= LEAF_CELLS:
            return 0, 1
        middle = F.zip_with("lo", "hi", lambda a, b: (a + b) / 2).alias("m")
        sample = df.sample(min(1.0, SAMPLE / n), seed=1).select(middle).toPandas()["m"]
        return _tree(np.stack(sample.to_numpy()), math.ceil(n / LEAF_CELLS))

    def around(pdf: pd.DataFrame, lo: np.ndarray, hi: np.ndarray) -> pd.DataFrame:
        n, total = pdf["n"].to_numpy(), np.zeros(len(pdf))
        for i, j in _meeting(lo, hi, reach):
            total += np.bincount(i, n[j], len(n)) + np.bincount(j, n[i], len(n))
        some = total > 0
        return pd.DataFrame({"cell": pdf["cell"].to_numpy()[some], "others": total[some].astype(np.int64)})

    def joined(pdf: pd.DataFrame, lo: np.ndarray, hi: np.ndarray) -> pd.DataFrame:
        dense, label, ids = pdf["dense"].to_numpy(), np.arange(len(pdf)), pdf["cell"].to_numpy()
        for i, j in _meeting(lo, hi, reach):
            kept = dense[i] | dense[j]
            label = _root(label, i[kept], j[kept])
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"a": ids[moved], "b": ids[label[moved]]})

    tree, leaves = laid(cells, many)
    sums = _in_leaves(cells.withColumn("dense", F.lit(False)), tree, leaves, width, reach, around, "cell bigint, others bigint")
    sums = sums.groupBy("cell").agg(F.sum("others").alias("others"))
    beside = F.coalesce("others", F.lit(0))
    kept = cut(cells.join(sums, "cell", "left").where((beside > 0) | (F.col("n") >= least)).withColumn("dense", F.col("n") + beside >= least))
    tree, leaves = laid(kept, kept.count())
    links = cut(_in_leaves(kept, tree, leaves, width, reach, joined, "a bigint, b bigint"))
    return _placed(rows, turned, radius, split), kept.select("cell", "key", "n", "dense"), links


def _near_counts(rows: DataFrame, radius: float) -> DataFrame:
    """(id, near, first): for each row (label, id, v, core) the number of rows of its label within ``radius`` and the smallest of them.

    Rows that are ``core`` of their label are known to be near each other and only compared with the
    others. Labels are split into blocks of at most about BLOCK_ROWS rows and pairs
    of blocks compared in separate tasks; only counts leave a task.
    """
    sizes = rows.groupBy("label", "core").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("_blocks"), F.count(F.lit(1)).alias("_n"), F.min("id").alias("_first"))
    whole = lambda c, core: F.coalesce(F.max(F.when(F.col("core") == core, F.col(c))), F.lit(0))
    sizes = sizes.groupBy("label").agg(whole("_blocks", False).alias("_loose"), whole("_blocks", True).alias("_cores"), whole("_n", True).alias("_n"), whole("_first", True).alias("_first"))
    placed = cut(rows.join(_small(sizes), "label"))
    # blocks of loose rows come first, then those of core rows
    own = F.when(F.col("core"), F.col("_loose") + F.pmod(F.xxhash64("id"), F.col("_cores"))).otherwise(F.pmod(F.xxhash64("id"), F.col("_loose"))).cast("int")
    until = F.when(F.col("core"), F.col("_loose")).otherwise(F.col("_loose") + F.col("_cores"))
    others = F.when(until > 0, F.sequence(F.lit(0), until - 1))
    spread = placed.withColumn("_b", own).withColumn("_o", F.explode(others)).select(
        "label", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), "_b", "id", "v"
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks, ids, x = pdf["_b"].to_numpy(), pdf["id"].to_numpy(), np.stack(pdf["v"].to_numpy())
        near, first = np.zeros(len(ids), dtype=np.int64), ids.copy()
        i, j = int(pdf["_i"].iloc[0]), int(pdf["_j"].iloc[0])
        for mine, other in {(i, j), (j, i)}:
            p, q = np.flatnonzero(blocks == mine), np.flatnonzero(blocks == other)
            q = q[np.argsort(ids[q])]
            step = max(1, BLOCK_ENTRIES // max(1, len(q) * x.shape[1]))
            for k in range(0, len(p), step):
                r = p[k : k + step]
                close = ((x[r][:, None, :] - x[q][None, :, :]) ** 2).sum(2) <= radius * radius
                near[r] += close.sum(1)
                if len(q):
                    first[r] = np.where(close.any(1), np.minimum(first[r], ids[q][close.argmax(1)]), first[r])
        return pd.DataFrame({"id": ids, "near": near, "first": first})

    parts = spread.groupBy("label", "_i", "_j").applyInPandas(compare, "id bigint, near bigint, first bigint")
    known = placed.where("core").select("id", F.col("_n").alias("near"), F.col("_first").alias("first"))
    return parts.unionByName(known).groupBy("id").agg(F.sum("near").alias("near"), F.min("first").alias("first"))


def _cliques(rows: DataFrame, radius: float) -> DataFrame:
    """The rows (label, id, v, core, ...) of sets that are mutually within ``radius`` and have no other row of their label near, with their ``group``.

    All rows of such a set have the same smallest neighbour and as many neighbours
    as the set has rows. Sets that pass this are compared once more inside themselves: if
    all their pairs are near, each row's neighbours are exactly the set.
    """
    known = cut(rows.join(_near_counts(rows, radius), "id").withColumn("group", F.concat_ws("/", "label", "first", "near")))
    sizes = known.groupBy("group").agg(F.count(F.lit(1)).alias("_n"), F.first("near").alias("_k")).where("_n = _k").select("group", "_n")
    maybe = known.join(sizes, "group").drop("near", "first")
    inside = _near_counts(maybe.select(F.col("group").alias("label"), "id", "v", "core"), radius).select("id", "near")
    whole = maybe.join(inside, "id").groupBy("group").agg(F.min(F.col("near") - F.col("_n")).alias("_lack")).where("_lack = 0").select("group")
    return maybe.join(whole, "group", "left_semi").drop("_n")


def clusters(rows: DataFrame, width: int, radius: float, least: int, axes: int = AXES, levels: int = LEVELS) -> DataFrame:
    """(item, v, cell, cluster, group): the rows of every cluster; cluster is its smallest item.

    ``rows`` has item and v (``width`` finite numbers, see ``vectors``). A cluster
    is a set of rows that are mutually within ``radius`` (Euclidean), of at least
    ``least`` different items, with no other row within ``radius`` of one of
    them. Exact: cells, boxes and the ball test only decide what needs no comparison of
    rows. Rows in no cluster are left out; an empty input gives none; a repeated row comes as often
    as in ``rows``.
    """
    placed, cells, links = linked_cells(rows, width, radius, least, axes, levels)
    labels = components(cells.select(F.col("cell").alias("node")), links).withColumnRenamed("node", "cell")
    known = cells.join(labels, "cell")
    large = known.groupBy("label").agg(F.sum("n").alias("rows"), F.max("dense").alias("dense")).where((F.col("rows") >= least) & F.col("dense"))
    known = cut(known.join(large.select("label"), "label", "left_semi"))
    members = placed.join(_small(known.select("key", "cell", "label")), "key").drop("key")
    middle = F.array(*[F.avg(F.get("v", i)) for i in range(width)]).alias("centre")
    off = F.sqrt(reduce(lambda s, i: s + (F.get("v", i) - F.get("centre", i)) ** 2, range(width), F.lit(0.0)))
    centre = _small(members.groupBy("label").agg(middle))
    widest = cut(members.join(centre, "label").groupBy("label").agg(F.max(off).alias("off")))
    sure = F.col("off") <= radius / 2 - 1e-9
    columns = ["item", "v", "cell", "group"]
    found = members.join(_small(widest.where(sure).select("label")), "label").withColumn("group", F.col("label").cast("string")).select(columns)
    wide = widest.where(~sure).select("label")
    if wide.count():
        loose = cut(members.join(_small(wide), "label").withColumn("id", F.monotonically_increasing_id()))
        densest = known.groupBy("label").agg(F.min_by("cell", F.struct(-F.col("n"), "cell")).alias("cell"))
        core = _small(loose.join(_small(densest), ["label", "cell"]).groupBy("label").agg(middle))
        loose = cut(loose.join(core, "label").withColumn("core", off <= radius / 2 - 1e-9).drop("centre"))
        found = found.unionByName(_cliques(loose, radius).select(columns))
    named = found.select("group", "item").distinct().groupBy("group").agg(F.min("item").alias("cluster"), F.count(F.lit(1)).alias("_k"))
    return found.join(_small(named.where(F.col("_k") >= least).drop("_k")), "group").select("item", "v", "cell", "cluster", "group")


def described(found: DataFrame, width: int, typical: int = 3) -> DataFrame:
    """One row per cluster: cluster, rows, items, densest (rows of its densest cell), typical (members of that cell).

    The typical members are those of the densest cell (of equal ones the first)
    nearest to the cluster's centre, ties by item. A repeated row counts once.
    """
    found = found.distinct()
    stats = found.groupBy("group", "cluster").agg(F.count(F.lit(1)).alias("rows"), F.array(*[F.avg(F.get("v", i)) for i in range(width)]).alias("centre"))
    items = found.select("group", "item").distinct().groupBy("group").agg(F.count(F.lit(1)).alias("items"))
    per = found.groupBy("group", "cell").agg(F.count(F.lit(1)).alias("n"))
    best = per.groupBy("group").agg(F.min(F.struct((-F.col("n")).alias("m"), "cell")).alias("b")).select("group", F.col("b.cell").alias("cell"), (-F.col("b.m")).alias("densest"))
    off = F.aggregate(F.zip_with("v", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    near = found.join(best, ["group", "cell"]).join(stats.select("group", "centre"), "group").groupBy("group", "densest", "item").agg(F.min(off).alias("off"))
    ranked = near.withColumn("k", F.row_number().over(Window.partitionBy("group").orderBy("off", "item"))).where(F.col("k") <= typical)
    names = ranked.groupBy("group", "densest").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "item"))), lambda x: x["item"]).alias("typical"))
    return stats.drop("centre").join(items, "group").join(names, "group").drop("group")
