"""Joins of rows with their groups where one group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``groups``, which has one row per key ``on`` and in ``size`` how many of ``rows`` have it.

    Groups of more than ``total / 1000`` rows number fewer than 1000, as their sizes add up to ``total``
    at most: those alone are broadcast, so their rows stay where they are. All other groups
    meet their rows by shuffle and are small beside a task. ``how`` is inner, left or left_semi.
    ``rows`` and ``groups`` are read twice, so pass materialised tables; keys must not be null.
    """
    large = groups.filter(F.col(size) * SHARE > total)
    rest = groups.filter(F.col(size) * SHARE <= total)
    kept = "left_semi" if how == "left_semi" else "inner"
    here = rows.join(F.broadcast(large), on, kept)
    there = rows.join(F.broadcast(large.select(*on)), on, "left_anti").join(rest, on, how)
    return here.unionByName(there)


def meetings(rows: DataFrame, keys: list[str], by: str, most: int) -> DataFrame:
    """``rows`` for a join with themselves on ``keys`` and ``meeting``, which pairs up rows of one key without one task for a key.

    The rows of a key are dealt by a hash of ``by`` into parts of about ``most``; each two parts, and each part with itself, are a ``meeting``, to which
    every row of both comes. A pair must count where ``met_once`` of its two rows holds. ``keys`` must not be null; ``rows`` is read twice.
    """
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_parts")).filter("_parts > 1")
    # only keys of more than ``most`` rows have parts
    dealt = rows.join(sizes, keys, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(by), F.col("_parts")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return dealt.withColumn("meeting", F.struct(F.least("part", "_other").alias("low"), F.greatest("part", "_other").alias("high"))).drop("_parts", "_other")


def met_once(a_part: str, b_part: str) -> Column:
    """Whether two rows that agree in ``meeting`` meet here and nowhere else: rows of one part do where both parts are that one."""
    return (F.col(a_part) != F.col(b_part)) | (F.col("meeting.low") == F.col("meeting.high"))
