"""Reading order from word boxes: rows, gutters, columns, lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lines(words: DataFrame) -> DataFrame:
    """``doc, page, line_no, text`` from ``doc, page, page_width, word_ord, x0, x1, top, text``.

    Words whose top rounds to one multiple of 3 (half to even) are a row. A row splits at its first
    largest gap if that is at least 15 and four times the upper median of its other gaps, and the
    page's middle lies between its start and the gap's end. Lines wider than 0.6 pages, and those whose
    words begin left of the middle on average, read first. A page is ordered within one task.

    A null word text is left out of its line; words of a null document or page, or without a place, are not read; repeated
    words stand twice; an empty table gives no rows.
    """
    row = ["doc", "page", "key"]
    order = Window.partitionBy(*row).orderBy("x0", "word_ord")
    w = words.withColumn("key", F.rint(F.col("top") / 3)).withColumns({"i": F.row_number().over(order), "gap": F.col("x0") - F.lag("x1").over(order)})
    rows = w.groupBy(*row).agg(F.max("gap").alias("widest"), F.array_sort(F.collect_list("gap")).alias("gaps"), F.min("x0").alias("start"), F.min("word_ord").alias("seen"))
    others = F.slice("gaps", 1, F.greatest(F.size("gaps") - 1, F.lit(0)))  # without one widest gap
    typical = F.when(F.size(others) > 0, F.element_at(others, F.floor(F.size(others) / 2).cast("int") + 1)).otherwise(F.lit(0.0))
    rows = rows.withColumn("least", F.greatest(F.lit(15.0), 4 * typical)).drop("gaps")
    w = w.join(rows, row)
    at = F.min(F.when(F.col("gap") == F.col("widest"), F.col("i"))).over(Window.partitionBy(*row))
    w = w.withColumn("at", at)
    right_start = F.min(F.when(F.col("i") == F.col("at"), F.col("x0"))).over(Window.partitionBy(*row))
    middle = F.col("page_width") / 2
    split = (F.col("widest") >= F.col("least")) & (F.col("start") < middle) & (middle < right_start)
    w = w.withColumn("half", F.when(split & (F.col("i") >= F.col("at")), 1).otherwise(0))
    line = w.groupBy(*row, "half", "seen", "page_width").agg(F.min("top").alias("top"), F.min("x0").alias("x0"), F.avg("x0").alias("mean_x0"), F.max("x1").alias("x1"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda s: s["text"]), " ").alias("text"))
    left = (F.col("x1") - F.col("x0") > 0.6 * F.col("page_width")) | (F.col("mean_x0") < middle)
    number = F.row_number().over(Window.partitionBy("doc", "page").orderBy("stream", "top", "seen", "half"))
    return line.withColumn("stream", F.when(left, 0).otherwise(1)).select("doc", "page", number.alias("line_no"), "text")


def page_text(words: DataFrame) -> DataFrame:
    """``doc, page, text``: a page's lines in reading order, one to a line of text; no rows for pages without words (see ``lines``)."""
    numbered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return lines(words).groupBy("doc", "page").agg(F.array_join(F.transform(numbered, lambda s: s["text"]), "\n").alias("text"))


def document_text(words: DataFrame, pages: DataFrame | None = None, max_pages: int | None = None) -> DataFrame:
    """``doc, text``: pages in order with a blank line between them, the first ``max_pages`` only if that is given.

    ``pages`` lists all ``doc, page``; a page without words is an empty text of its own.
    """
    texts = page_text(words)
    if pages is not None:
        texts = pages.select("doc", "page").distinct().join(texts, ["doc", "page"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    if max_pages is not None:
        texts = texts.withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("page"))).filter(F.col("n") <= max_pages)
    numbered = F.array_sort(F.collect_list(F.struct("page", "text")))
    return texts.groupBy("doc").agg(F.array_join(F.transform(numbered, lambda s: s["text"]), "\n\n").alias("text"))
