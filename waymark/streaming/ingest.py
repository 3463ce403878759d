"""Continuous ingestion: file streams, deduplication in a watermark, enrichment, windows, sinks."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.clock import epoch_us
from waymark.lineage import checkpoint_dir
from waymark.sinks.writers import insert_new


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 16, fmt: str = "parquet") -> DataFrame:
    """A stream of the files that a glob matches, in bounded micro-batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def timed(stream: DataFrame, at: str, delay: str) -> DataFrame:
    """Adds ``event_time``, the zone-free ``at`` read as UTC, with a watermark; rows without a time are left out."""
    instant = F.timestamp_micros(epoch_us(F.col(at)))
    return stream.where(F.col(at).isNotNull()).withColumn("event_time", instant).withWatermark("event_time", delay)


def deduplicated(stream: DataFrame, key: str) -> DataFrame:
    """The first row of each key inside the watermark; state is dropped with it. Null keys are left out."""
    return stream.where(F.col(key).isNotNull()).dropDuplicatesWithinWatermark([key])


def enriched(stream: DataFrame, info: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(complete, rejected): rows with their static ``info``, and rows without any."""
    known = info.withColumn("_known", F.lit(True))
    both = stream.join(known, key, "left")
    return both.where(F.col("_known")).drop("_known"), both.where(F.col("_known").isNull()).select(*stream.columns)


def window_counts(stream: DataFrame, width: str, keys: list[str]) -> DataFrame:
    """(start, keys, n) in tumbling windows of the event time."""
    n = stream.groupBy(F.window("event_time", width), *keys).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.col("window.start").alias("start"), *keys, "n")


def session_counts(stream: DataFrame, gap: str, keys: list[str]) -> DataFrame:
    """(start, end, keys, n) of runs of events without a pause of ``gap``."""
    n = stream.groupBy(F.session_window("event_time", gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def into_table(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A batch sink that inserts new keys only; a repeated batch changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        insert_new(batch, path, key)

    return write


def run_available(stream: DataFrame, name: str, sink: Callable[[DataFrame, int], None] | str, mode: str = "append") -> None:
    """Runs over all that is there and ends; ``sink`` is a batch function or a parquet folder. State lies in the shared checkpoint folder."""
    where = f"{checkpoint_dir(stream.sparkSession)}/stream-{name}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", where).trigger(availableNow=True)
    writer = writer.foreachBatch(sink) if callable(sink) else writer.format("parquet").option("path", sink)
    query = writer.start()
    query.awaitTermination()


# The factor between two waiting times.
BACKOFF_FACTOR = 1.618


class Backoff:
    """Waiting times after failures: each is BACKOFF_FACTOR times the last; old failures are forgotten."""

    def __init__(self, first_s: float = 120, window_s: float = 3_600, most: int = 5, clock: Callable[[], float] = time.monotonic):
        self.first, self.window, self.most, self.clock = first_s, window_s, most, clock
        self.reset()

    def reset(self) -> None:
        self.wait, self.failures = self.first, []

    def fail(self) -> float:
        """Notes a failure; the seconds to wait now."""
        now = self.clock()
        self.failures = [t for t in self.failures if now - t < self.window] + [now]
        out, self.wait = self.wait, self.wait * BACKOFF_FACTOR
        return out

    def give_up(self) -> bool:
        """Whether there were too many recent failures."""
        return len([t for t in self.failures if self.clock() - t < self.window]) >= self.most
