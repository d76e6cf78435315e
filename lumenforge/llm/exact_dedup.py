"""Exact deduplication by 128-bit content hash, with the bytes compared inside every hash group."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lumenforge.llm import bitmaps
from lumenforge.plans.lineage import materialize
from lumenforge.plans.skew import join_groups

def content_hash(norm: Column) -> Column:
    """128 bits of the normalised text."""
    return F.unhex(F.md5(F.encode(norm, "UTF-8")))


def with_normalised(docs: DataFrame, text_col: str) -> DataFrame:
    """The columns of ``docs`` as ``_0, _1, ...`` and ``norm``: the text with A-Z lower-cased and nothing else changed.

    Null counts as empty. The text is lower-cased byte by byte in Arrow, so no character above 127 moves.
    """
    place = docs.columns.index(text_col)
    rows = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    schema = StructType([*rows.schema.fields, StructField("norm", StringType())])

    def run(batches):
        for batch in batches:
            text = batch.column(place)
            norm = pc.ascii_lower(pc.fill_null(text, pa.scalar("", text.type)))
            yield pa.RecordBatch.from_arrays([*batch.columns, norm], names=schema.names)

    return rows.mapInArrow(run, schema)


def repeated_filter(hashes: DataFrame) -> DataFrame:
    """The filter of those ``h`` that stand in at least two rows of ``hashes``."""
    return bitmaps.key_filter(hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hash128=content_hash) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, text_sha256``.

    ``keep`` names the id that stays, the smallest ("min") or largest ("max") of its group.

    A first pass writes (id, hash, SHA-256) of each row. Hashes that repeat set bits of a filter of
    bounded size; a second pass sends only the texts that pass it, one per task and different
    text, to ``groupBy(hash, text)``, which compares the bytes: two texts whose hashes collide fall
    into different groups. Rows then find their group by (hash, SHA-256) without their text, large
    groups by broadcast. If two different texts agreed in both digests the query raises instead of
    merging them.

    Null text equals empty text. Null ids never beat other ids and all-null groups keep one null id,
    whose rows are all marked kept. Rows that repeat an id with an equal text are all kept or all
    dropped. An empty table gives no rows. Columns other than the two named are ignored.
    """
    rows = with_normalised(docs.select(F.col(id_col), F.col(text_col)), docs.select(F.col(text_col)).columns[0]).select(F.col("_0").alias("id"), "norm", hash128(F.col("norm")).alias("h"))
    sha = F.sha2(F.encode("norm", "UTF-8"), 256)
    keys = materialize(rows.select("id", "h", sha.alias("text_sha256")), "exact-keys")
    met = bitmaps.split_by_filter(rows, repeated_filter(keys)).filter("again")
    best = F.max if keep == "max" else F.min
    texts = met.groupBy("h", "norm").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    texts = texts.select("h", sha.alias("text_sha256"), "keep_id", "group_size")
    groups = texts.groupBy("h", "text_sha256").agg(F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"), F.count(F.lit(1)).alias("_texts"))
    checked = F.when(F.col("_texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("different texts agree in MD5 and SHA-256")))
    groups = groups.withColumn("group_size", checked).drop("_texts").withColumn("_met", F.lit(True))
    groups = materialize(groups.filter("group_size > 1"), "exact-groups")
    out = join_groups(keys, groups, ["h", "text_sha256"], "group_size", keys.count(), "left")
    found = lambda c, own: F.when(F.col("_met"), F.col(c)).otherwise(own)
    out = out.select("id", "text_sha256", found("keep_id", F.col("id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hash128=content_hash) -> DataFrame:
    """The rows of ``docs`` that stay, whole and with their own columns; one of each group.

    Texts are equal when identical after lower-casing A-Z; null equals empty, and null ids lose to
    others. Of rows that repeat an id and text one stays; which, if their other columns differ, is
    decided by those columns and the text's case. Rows whose hash is not in the filter of repeated hashes (see
    ``bitmaps.key_filter``) are unique and pass without a shuffle; the others meet by (hash, text), combined
    before the shuffle. Columns may have any name; an empty table gives no rows.
    """
    columns = docs.columns
    rows = with_normalised(docs, text_col).withColumn("h", hash128(F.col("norm")))
    bits = materialize(repeated_filter(rows.select("h")), "exact-bits")
    rows = bitmaps.split_by_filter(rows, bits)
    unique = rows.filter(~F.col("again")).select(*[f"_{i}" for i in range(len(columns))])
    own = f"_{columns.index(id_col)}"
    rest = F.to_json(F.struct(*[f"_{i}" for i in range(len(columns)) if columns[i] != text_col]))
    order = F.struct(F.col(own).isNotNull() if keep == "max" else F.col(own).isNull(), F.col(own), F.xxhash64(rest), F.xxhash64(f"_{columns.index(text_col)}"))
    best = F.max_by if keep == "max" else F.min_by
    # the text that stays is told by its own column; what is compared is the key
    again = rows.filter("again").groupBy("h", "norm").agg(best(F.struct(*[f"_{i}" for i in range(len(columns))]), order).alias("_row"))
    again = again.select(*[F.col("_row")[f"_{i}"].alias(f"_{i}") for i in range(len(columns))])
    return unique.unionByName(again).toDF(*columns)
