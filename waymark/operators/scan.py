"""Exact spatial scan over all rectangles of a grid, and merging of its best regions.

What is scanned is a grid of bounded size, not the events: they are counted per
cell before. Prefix sums give each rectangle's counts in four reads, and the
rectangles of one size are one NumPy expression. Groups and stripes of rectangle
widths run in parallel; only the best regions leave a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def statistic(m: np.ndarray, b: np.ndarray, total_m: float, total_b: float, support: int) -> np.ndarray:
    """The scan statistic; -inf without support or where the measured share is not above the background share."""
    with np.errstate(divide="ignore", invalid="ignore"):
        pm, pb = m / total_m, b / total_b
        rest = np.where(pm < 1, (1 - pm) * np.log((1 - pm) / (1 - pb)), 0.0)
        d = pm * np.log(pm / pb) + rest
    return np.where((m >= support) & (b >= support) & (pm > pb) & (pb < 1), d, -np.inf)


def _prefix(ix: np.ndarray, iy: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    grid = np.zeros((k + 1, k + 1))
    np.add.at(grid, (ix + 1, iy + 1), n)
    return grid.cumsum(0).cumsum(1)


def rectangles(two: DataFrame, keys: list[str], k: int, max_side: int, support: int | None, top: int, stripes: int = 4) -> DataFrame:
    """(keys, value, x0, x1, y0, y1, m, b): the ``top`` rectangles of each group, cells inclusive.

    ``two`` has keys, ix, iy, m, b with 0 <= ix, iy < k; sides are at most
    ``max_side`` cells. Without ``support`` each group has that of its measured
    total, see ``support_of``. Equal values (to nine digits) are ordered by x0, y0, x1, y1.
    Groups without measured or background events give nothing.
    """
    spread = two.withColumn("_stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    kinds = {f.name: f.dataType.simpleString() for f in two.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keys] + ["value double, x0 int, x1 int, y0 int, y1 int, m bigint, b bigint"])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        ix, iy = pdf["ix"].to_numpy(), pdf["iy"].to_numpy()
        pm, pb = (_prefix(ix, iy, pdf[c].to_numpy(), k) for c in ("m", "b"))
        total_m, total_b = pm[-1, -1], pb[-1, -1]
        least = support_of(int(total_m)) if support is None else support
        best = np.empty((0, 7))
        for w in range(1 + int(pdf["_stripe"].iloc[0]), max_side + 1, stripes):
            out = [best]
            for h in range(1, max_side + 1):
                m, b = ((p[w:, h:] - p[:-w, h:] - p[w:, :-h] + p[:-w, :-h]).ravel() for p in (pm, pb))
                keep = np.flatnonzero((m >= least) & (b >= least) & (total_m * total_b > 0))
                d = np.round(statistic(m[keep], b[keep], total_m, total_b, least), 9)
                keep, d = keep[d > -np.inf], d[d > -np.inf]
                if len(keep) > top:
                    some = d >= np.partition(d, len(d) - top)[len(d) - top]
                    keep, d = keep[some], d[some]
                x, y = np.divmod(keep, k + 1 - h)
                out.append(np.column_stack([d, x, x + w - 1, y, y + h - 1, m[keep], b[keep]]))
            best = np.concatenate(out)
            best = best[np.lexsort((best[:, 4], best[:, 2], best[:, 3], best[:, 1], -best[:, 0]))][:top]
        rows = pd.DataFrame(best, columns=["value", "x0", "x1", "y0", "y1", "m", "b"]).astype({c: int for c in ("x0", "x1", "y0", "y1", "m", "b")})
        for i, c in enumerate(keys):
            rows.insert(i, c, pdf[c].iloc[0])
        return rows

    found = spread.groupBy(*keys, "_stripe").applyInPandas(search, schema)
    best = Window.partitionBy(*keys).orderBy(F.desc("value"), "x0", "y0", "x1", "y1")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= top)


def merge(regions: DataFrame, keys: list[str], k: int, use_mean: bool = True) -> DataFrame:
    """Overlapping regions in rank order made one: (keys, region_no, value, m, b, parts, cells).

    Each remaining best region takes up the first two later ones that meet it, as it grows,
    and all that meet it are used up. value is the mean of its parts, m and b their mean
    (their sum if not ``use_mean``). Regions meet if they share a cell or a border point.
    cells is the array of (x, y) covered. The input has at most ``top`` rows per
    key, see ``rectangles``.
    """
    kinds = {f.name: f.dataType.simpleString() for f in regions.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keys] + ["region_no int, value double, m double, b double, parts int, cells array<struct<x:int,y:int>>"])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        left = list(pdf[["value", "x0", "x1", "y0", "y1", "m", "b"]].itertuples(index=False, name=None))
        total = np.mean if use_mean else np.sum
        out = []
        while left:
            first, rest = left[0], left[1:]
            shape = np.zeros((k + 2, k + 2), dtype=bool)  # one free cell around
            shape[first[1] + 1 : first[2] + 2, first[3] + 1 : first[4] + 2] = True
            parts, left = [first], []
            for r in rest:
                if shape[r[1] : r[2] + 3, r[3] : r[4] + 3].any():
                    if len(parts) < 3:
                        parts.append(r)
                        shape[r[1] + 1 : r[2] + 2, r[3] + 1 : r[4] + 2] = True
                else:
                    left.append(r)
            cells = [{"x": int(x) - 1, "y": int(y) - 1} for x, y in np.argwhere(shape)]
            out.append((len(out) + 1, float(np.mean([p[0] for p in parts])), float(total([p[5] for p in parts])), float(total([p[6] for p in parts])), len(parts), cells))
        rows = pd.DataFrame(out, columns=["region_no", "value", "m", "b", "parts", "cells"])
        for i, c in enumerate(keys):
            rows.insert(i, c, pdf[c].iloc[0])
        return rows

    return regions.groupBy(*keys).applyInPandas(fold, schema)


def tags_of_area(merged: DataFrame, tag: str, cells: list[tuple[int, int]], share: float = 0.6) -> DataFrame:
    """(tag, value): tags whose best region covers more than ``share`` of the asked cells, best first."""
    asked = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in cells])
    hit = merged.where(F.size(F.array_intersect("cells", asked)) > share * len(cells))
    return hit.groupBy(tag).agg(F.max("value").alias("value")).orderBy(F.desc("value"), tag)


# Greatest number of events and the support asked up to it; above the last, MOST_SUPPORT.
SUPPORT = [(500, 20), (2_000, 40)]
MOST_SUPPORT = 250


def support_of(total: int) -> int:
    """Least events of a region by the number of events: 20 up to 500, 40 up to 2,000, then 250."""
    return next((least for most, least in SUPPORT if total <= most), MOST_SUPPORT)
