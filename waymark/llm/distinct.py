"""Exact distinct counts with compressed, mergeable bitmaps.

Identifiers become dense integers. A set of them is kept as bitmap rows: one
row per group and bucket of 32,768 integers, holding only the non-zero 64-bit
words. Union is a bitwise OR per word, intersection a bitwise AND, the count a
sum of bit counts: all hash aggregations on bigints with map-side combining,
without error. Dense sets take one bit per member, sparse sets one word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD_BITS = 64
WORDS_PER_BUCKET = 512


def dictionary(df: DataFrame, column: str, slices: int = 1024) -> DataFrame:
    """(value, code): codes 0, 1, 2 ... without holes, the same for the same set of values.

    Values are ranked inside ``slices`` hash slices; the slices' sizes (at most
    ``slices`` rows, broadcast) give each slice its first code. No task sees
    more than one slice's distinct values. Null is no value.
    """
    values = df.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    sliced = values.withColumn("_s", F.pmod(F.xxhash64("value"), F.lit(slices)).cast("int"))
    first = (
        sliced.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
        .select("_s", (F.sum("_n").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_first"))
    )
    ranked = sliced.withColumn("_r", F.row_number().over(Window.partitionBy("_s").orderBy("value")))
    return ranked.join(F.broadcast(first), "_s").select("value", (F.col("_first") + F.col("_r") - 1).alias("code"))


def words(df: DataFrame, keys: list[str], code: str) -> DataFrame:
    """(keys, word, bits): the members of each group as 64-bit words."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.col(code), F.lit(WORD_BITS)).cast("int"))
    return df.groupBy(*keys, F.floor(F.col(code) / WORD_BITS).alias("word")).agg(F.bit_or(bit).alias("bits"))


def pack(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Bitmap rows (keys, bucket, words, n) from words; a bucket holds at most 512 words."""
    bucket = F.floor(F.col("word") / WORDS_PER_BUCKET).alias("bucket")
    return wide.groupBy(*keys, bucket).agg(
        F.array_sort(F.collect_list(F.struct(F.pmod("word", F.lit(WORDS_PER_BUCKET)).cast("int").alias("word"), "bits"))).alias("words"),
        F.sum(F.bit_count("bits")).alias("n"),
    )


def unpack(maps: DataFrame, keys: list[str]) -> DataFrame:
    """The words of bitmap rows."""
    rows = maps.select(*keys, "bucket", F.inline("words"))
    return rows.select(*keys, (F.col("bucket") * WORDS_PER_BUCKET + F.col("word")).alias("word"), "bits")


def bitmaps(df: DataFrame, keys: list[str], column: str, codes: DataFrame) -> DataFrame:
    """Bitmap rows of the different ``column`` values of each group.

    ``codes`` is a ``dictionary`` covering ``column``. Null values add nothing;
    a null key is a group of its own. Rows may repeat.
    """
    rows = df.select(*keys, F.col(column).alias("_value")).where(F.col("_value").isNotNull()).distinct()
    coded = rows.join(codes.select(F.col("value").alias("_value"), F.col("code").alias("_code")), "_value")
    return pack(words(coded, keys, "_code"), keys)


def merge(maps: DataFrame, keys: list[str], to: list[str]) -> DataFrame:
    """Unions of the bitmaps over the keys that are not in ``to``."""
    wide = unpack(maps, keys).groupBy(*to, "word").agg(F.bit_or("bits").alias("bits"))
    return pack(wide, to)


def count(maps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, members): the exact size of each set."""
    return maps.groupBy(*keys).agg(F.sum("n").alias("members"))


def common(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, members): the size of each intersection of equally keyed sets; empty ones are left out."""
    a, b = unpack(left, keys), unpack(right, keys).withColumnRenamed("bits", "_other")
    both = a.join(b, [*keys, "word"]).select(*keys, F.bit_count(F.col("bits").bitwiseAND(F.col("_other"))).alias("n"))
    return both.groupBy(*keys).agg(F.sum("n").alias("members")).where("members > 0")
