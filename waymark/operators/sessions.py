"""Sessions: runs of a user's records without a long pause."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions.clock import epoch_us


def chunk_sessions(df: DataFrame, keys: list[str], at_us: str, gap_us: int) -> DataFrame:
    """Partial sessions: one row for each key and time chunk.

    A chunk is as long as the permitted pause, so the records of one key in
    one chunk can never be separated by more than that pause: each chunk holds
    exactly one local session, and building it is a hash aggregation with
    map-side combining. However many rows a key has, it leaves at most
    one row per chunk of its time span.
    """
    chunk = F.floor(F.col(at_us) / F.lit(gap_us)) if gap_us > 1 else F.col(at_us)
    return (
        df.groupBy(*keys, chunk.alias("_chunk"))
        .agg(F.min(at_us).alias("_first"), F.max(at_us).alias("_last"), F.count(F.lit(1)).alias("_n"))
    )


def merge_sessions(partial: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    """Joins neighbouring partial sessions whose boundary pause is at most ``gap_us``."""
    ordered = Window.partitionBy(*keys).orderBy("_chunk")
    pause = F.col("_first") - F.lag("_last").over(ordered)
    flagged = partial.withColumn("_new", F.when(pause <= gap_us, 0).otherwise(1))
    numbered = flagged.withColumn("session_no", F.sum("_new").over(ordered))
    return (
        numbered.groupBy(*keys, "session_no")
        .agg(
            F.min("_first").alias("start_us"),
            F.max("_last").alias("end_us"),
            F.sum("_n").alias("records"),
        )
        .withColumn("duration_us", F.col("end_us") - F.col("start_us"))
    )


def sessions(
    df: DataFrame, keys: list[str], time: str, gap_s: float, record: str | None = None
) -> DataFrame:
    """Sessions of each ``keys`` value, split where the pause exceeds ``gap_s`` seconds.

    Columns out: ``keys``, ``session_no`` (from 1, in time order), ``start_us``,
    ``end_us``, ``records``, ``duration_us``; times in microseconds since 1970,
    for ``timestamp_ntz`` without any zone shift.

    Rows without a key or time are left out. With ``record`` rows of the same
    record id (and key and time) count once; without it, each row counts, so
    repeated rows raise ``records`` but never change the limits. A pause of
    exactly ``gap_s`` does not split. Equal times belong together. Other
    columns of ``df``, whatever their names, are ignored. An empty input gives
    an empty result.
    """
    kind = df.schema[time].dataType
    at = epoch_us(F.col(time), isinstance(kind, T.TimestampNTZType))
    picked = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    rows = df.select(*picked, at.alias("_at"), *([F.col(record).alias("_id")] if record else []))
    names = [f"_k{i}" for i in range(len(keys))]
    rows = rows.dropna(subset=[*names, "_at"])
    if record:
        rows = rows.dropna(subset=["_id"]).distinct()
    gap_us = max(0, int(round(gap_s * 1_000_000)))
    merged = merge_sessions(chunk_sessions(rows, names, "_at", gap_us), names, gap_us)
    return merged.select(
        *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)],
        "session_no", "start_us", "end_us", "records", "duration_us",
    )
