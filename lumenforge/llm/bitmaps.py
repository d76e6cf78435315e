"""A filter of bounded size that tells which rows can hold one of many keys, before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BITS = 32_768  # of one bitmap of the SQL bitmap functions
BUCKETS = 2048


def _bit(h: Column) -> Column:
    """The place of a key in the filter, counted from 1."""
    return F.pmod(F.xxhash64(h), F.lit(BUCKETS * WORD_BITS)) + 1


def key_filter(keys: DataFrame) -> DataFrame:
    """``bucket, bits``: a bit for each ``h`` of ``keys``.

    At most 2048 rows of 4 KiB whatever the input, so it may be broadcast. Where there are more keys than
    it has room for, it lets more other rows pass: more is shuffled then, nothing else changes.
    """
    places = keys.select(_bit(F.col("h")).alias("x"))
    return places.groupBy(F.bitmap_bucket_number("x").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))


def split_by_filter(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """``rows`` with ``again``: whether the filter holds their ``h``, which is so for each of its keys."""
    x = rows.withColumn("_x", _bit(F.col("h"))).withColumn("bucket", F.bitmap_bucket_number("_x"))
    met = x.join(F.broadcast(bits), "bucket", "left")
    at = F.bitmap_bit_position("_x")
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    hit = F.col("bits").isNotNull() & (F.getbit(byte, (at % 8).cast("int")) == 1)
    return met.withColumn("again", F.coalesce(hit, F.lit(False))).drop("_x", "bucket", "bits")
