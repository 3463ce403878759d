"""Exact frequencies of terms: heavy terms in local counter arrays, the others by shuffle.

A mergeable frequent-items sketch over all rows names the terms that may hold
more than one in ``HEAVY_PART`` of the occurrences; there can be at most a few
thousand. They get small integers, which are broadcast. Every task then goes over its
occurrences once: heavy ones raise two integer arrays, of which one row per heavy
term leaves the task at its end; light ones are added up batch by batch and go on
to the shuffle by their text. Both counts are exact, whichever terms the
sketch names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.text import folded

HEAVY_PART = 1_000
#: Terms longer than this are never broadcast, so the broadcast stays below HEAVY_PART * 4 * HEAVY_CHARS characters.
HEAVY_CHARS = 256


def term_list(c: Column) -> Column:
    """The usable terms of an array: trimmed, lower-cased, sorted, repeats kept; null becomes empty."""
    return F.array_sort(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), folded), lambda t: t.isNotNull()))


def records(df: DataFrame, key: str, terms: str) -> DataFrame:
    """(id, terms): one row for each record that has a term.

    Of several rows with one ``key`` the one with most terms counts, of equally
    many the greatest in array order. A null ``key`` is no record.
    """
    rows = df.select(F.col(key).alias("id"), term_list(F.col(terms)).alias("terms"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("terms") > 0))
    best = rows.groupBy("id").agg(F.max(F.struct(F.size("terms").alias("n"), "terms")).alias("b"))
    return best.select("id", F.col("b.terms").alias("terms"))


def occurrences(recs: DataFrame) -> DataFrame:
    """(term, first): one row for each occurrence; ``first`` is 1 at a term's first one in its record."""
    rows = recs.select("terms", F.posexplode("terms").alias("pos", "term"))
    seen = (F.col("pos") > 0) & (F.get("terms", F.col("pos") - 1) == F.col("term"))
    return rows.select("term", F.when(seen, 0).otherwise(1).alias("first"))


def heavy_terms(occ: DataFrame) -> DataFrame:
    """(term, slot): terms estimated on at least one in HEAVY_PART occurrences; at most 2 * HEAVY_PART rows."""
    spark = occ.sparkSession
    short = occ.where(F.length("term") <= HEAVY_CHARS)
    top = short.agg(F.expr(f"approx_top_k(term, {HEAVY_PART}, {HEAVY_PART * 8})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    named = [x["item"] for x in (top["top"] or []) if x["count"] * HEAVY_PART >= top["n"]]
    return spark.createDataFrame([(t, i) for i, t in enumerate(sorted(named))], "term string, slot int")


def _counter(slots: int):
    """A pass over (term, slot, first) batches: counter arrays of the ``slots`` heavy terms, light terms added up per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, every = np.zeros(slots, dtype=np.int64), np.zeros(slots, dtype=np.int64)
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            light = pc.is_null(rows["slot"])
            heavy = rows.filter(pc.invert(light))
            slot, first = heavy["slot"].to_numpy(), heavy["first"].to_numpy()
            every += np.bincount(slot, minlength=slots)
            records += np.bincount(slot[first > 0], minlength=slots)
            added = rows.filter(light).group_by("term").aggregate([("first", "sum"), ("first", "count")])
            if added.num_rows:
                none = pa.nulls(added.num_rows, pa.int32())
                yield from pa.table({"slot": none, "term": added["term"], "r": added["first_sum"], "o": added["first_count"]}).to_batches()
        at = np.flatnonzero(every)
        if len(at):
            yield pa.RecordBatch.from_pydict({"slot": pa.array(at, pa.int32()), "term": pa.nulls(len(at), pa.string()), "r": records[at], "o": every[at]})

    return run


def frequencies(recs: DataFrame) -> DataFrame:
    """(term, in_records, occurrences) of every term of ``records`` output, exact; one pass after that of the sketch."""
    occ = occurrences(recs)
    slots = heavy_terms(occ)
    named = F.broadcast(slots)
    tagged = occ.join(named, "term", "left").select(F.when(F.col("slot").isNull(), F.col("term")).alias("term"), "slot", F.col("first").cast("bigint").alias("first"))
    parts = tagged.mapInArrow(_counter(max(1, slots.count())), "slot int, term string, r bigint, o bigint")
    counts = parts.groupBy("slot", "term").agg(F.sum("r").alias("in_records"), F.sum("o").alias("occurrences"))
    whole = counts.join(named.withColumnRenamed("term", "_heavy"), "slot", "left")
    return whole.select(F.coalesce("term", "_heavy").alias("term"), "in_records", "occurrences")


def marked(freq: DataFrame, n_records: Column, least: int = 3, most_share: tuple[int, int] = (1, 10)) -> DataFrame:
    """Adds ``mark``: 'rare' below ``least`` records, 'common' above the share of all, else null; rare goes first."""
    part, whole = most_share
    mark = F.when(F.col("in_records") < least, "rare").when(F.col("in_records") * whole > n_records * part, "common")
    return freq.withColumn("mark", mark)
