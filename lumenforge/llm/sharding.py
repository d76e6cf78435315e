"""K-d tree sharding: recursive splits at distributed weighted medians of the widest metadata dimension.

A row's cell is a column; cells with their cuts, at most as many as there are shards, are known to the driver, which broadcasts them to
the points. Points are written every few levels. Nothing that touches rows is Python.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenforge.plans.lineage import discard, materialize
from lumenforge.plans.prefix import prefix_sum
from lumenforge.plans.skew import join_groups

GRID_BITS, TIE_BITS, STEP_BITS = 20, 32, 18
BITS = GRID_BITS + TIE_BITS
WRITTEN = 3  # levels between tables of points
NEAR = 8192  # a cut is exact enough once the range it lies in holds less than this part of its cell


def value_ranks(rows: DataFrame, column: str) -> DataFrame:
    """``column, n, _rank``: the distinct values, how often they stand, and their place among each other.

    Values are range-partitioned and numbered by a prefix sum over the partitions, so a long list of them is no task's alone.
    """
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).repartitionByRange(F.col(column)).withColumn("_part", F.spark_partition_id())
    return prefix_sum(materialize(counts, "shard-values"), [], "_part", [column], F.lit(1).cast("long"), "_rank").select(column, "n", "_rank")


def _place(dims: int) -> Column:
    """A point's coordinate in its cell's dimension."""
    return F.element_at(F.array(*[F.col(f"_d{i}") for i in range(dims)]), F.col("dim") + 1)


def _small(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of at most as many rows as there are cells, from the driver."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _widest(points: DataFrame, cells: list[dict], dims: int) -> list[dict]:
    """``cells`` that have rows, with ``dim``, in which they spread over most grid steps (the first such), and ``total``, their bytes."""
    spread = [(F.shiftright(F.max(f"_d{i}"), TIE_BITS) - F.shiftright(F.min(f"_d{i}"), TIE_BITS)).alias(f"s{i}") for i in range(dims)]
    found = points.join(F.broadcast(_small(points.sparkSession, cells, "cell long")), "cell").groupBy("cell").agg(F.sum("size").alias("total"), *spread).collect()
    wide = {r["cell"]: (r["total"], [r[f"s{i}"] for i in range(dims)]) for r in found}
    return [c | {"total": wide[c["cell"]][0], "dim": wide[c["cell"]][1].index(max(wide[c["cell"]][1]))} for c in cells if c["cell"] in wide]


def _cuts(points: DataFrame, cells: list[dict], dims: int) -> list[dict]:
    """``cells`` with ``cut``: points below it go left, so that floor(leaves / 2) / leaves of the bytes do, as nearly as coordinates allow.

    A pass adds up the bytes in 2**18 equal ranges of what is left of each cell's interval and keeps the range that holds
    its median. It ends for all cells once each such range holds a small part of its cell, else after three
    passes, which leave single coordinates. The driver gets a row for each cell.
    """
    state = [c | {"low": 0, "below": 0} for c in cells]
    width = BITS
    while True:
        step = min(STEP_BITS, width)
        width -= step
        known = F.broadcast(_small(points.sparkSession, [c | {"goal": c["total"] * (c["leaves"] // 2) / c["leaves"]} for c in state], "cell long, dim int, low long, below long, goal double"))
        inside = points.join(known, "cell").withColumn("_at", _place(dims) - F.col("low")).filter((F.col("_at") >= 0) & (F.col("_at") < (1 << (width + step))))
        bins = inside.groupBy("cell", F.shiftright("_at", width).alias("bin")).agg(F.sum("size").alias("bytes"))
        upto = F.sum("bytes").over(Window.partitionBy("cell").orderBy("bin"))
        found = bins.withColumn("upto", upto).join(known, "cell").filter(F.col("below") + F.col("upto") >= F.col("goal"))
        median = {r["cell"]: r["m"] for r in found.groupBy("cell").agg(F.min(F.struct("bin", "bytes", "upto")).alias("m")).collect()}
        for c in state:
            m = median[c["cell"]]
            c |= {"low": c["low"] + (m["bin"] << width), "below": c["below"] + m["upto"] - m["bytes"], "held": m["bytes"]}
        if not width or all(c["held"] * NEAR <= c["total"] for c in state):
            break
    for c in state:
        # the range that holds the median goes to the nearer side
        goal = c["total"] * (c["leaves"] // 2) / c["leaves"]
        c["cut"] = c["low"] + (1 << width if c["below"] + c["held"] - goal < goal - c["below"] else 0)
    return state


def kd_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", strings: tuple[str, ...] = ("source", "lang"), shards: int | None = None, target_bytes: int | None = None, overhead: int = 8) -> DataFrame:
    """One row per input row: ``id, size, text_crc32, shard, slot``.

    ``size`` is the text's UTF-8 bytes plus ``overhead``. Pass ``shards``, or ``target_bytes`` for as many
    as keep the mean leaf within it. The dimensions are the columns in ``strings`` (by the place of a value among
    all its distinct values), the size and the id, each laid on a grid of 2**20 steps of its whole range; a hash of the
    row, in which its own number stands, breaks ties inside a step, so equal rows, even a third of all, still split. A cell
    for k leaves is cut where floor(k/2)/k of its bytes lie below, along the dimension in which its
    rows spread over most grid steps (the first such). ``slot`` counts from 0 without gaps.

    Null text has no bytes but the overhead; null ids and strings sort first. Repeated rows are points of
    their own and part like others. Other columns are not read. An empty table gives no rows.
    """
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_s{i}") for i, c in enumerate(strings)])
    # the row's own number parts rows that are equal in all else; it is fixed once the table is written
    own = F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("text_crc32").cast("string"), F.monotonically_increasing_id().cast("string"))
    rows = rows.withColumn("_h", F.md5(F.encode(own, "UTF-8")))
    rows = materialize(rows, "shard-rows")
    total = rows.count()
    for i in range(len(strings)):
        ranks = materialize(value_ranks(rows.select(f"_s{i}"), f"_s{i}").withColumnRenamed("_rank", f"_r{i}"), "shard-ranks")
        ranked = materialize(join_groups(rows, ranks, [f"_s{i}"], "n", total).drop(f"_s{i}", "n"), "shard-rows")
        discard(rows)
        rows = ranked
    dims = len(strings) + 2
    rows = rows.withColumns({f"_r{len(strings)}": F.col("size"), f"_r{len(strings) + 1}": F.coalesce(F.col("id").cast("long"), F.lit(0).cast("long"))})
    span = rows.agg(F.sum("size").alias("total"), *[f(f"_r{i}").alias(f"{f.__name__}{i}") for i in range(dims) for f in (F.min, F.max)]).collect()[0]
    if shards is None:
        shards = max(1, -(-(span["total"] or 0) // (target_bytes or 1 << 30)))
    tie = F.conv(F.substring("_h", 1, TIE_BITS // 4), 16, 10).cast("long")
    grid = lambda i: F.floor((F.col(f"_r{i}") - F.lit(span[f"min{i}"] or 0)).cast("double") / max(1, (span[f"max{i}"] or 0) - (span[f"min{i}"] or 0)) * ((1 << GRID_BITS) - 1)).cast("long")
    zero = F.lit(0).cast("long")
    points = rows.select("id", "size", "text_crc32", "_h", *[(F.shiftleft(grid(i), TIE_BITS) + tie).alias(f"_d{i}") for i in range(dims)], zero.alias("cell"), zero.alias("first"))
    points = materialize(points, "shard-points")
    cells, most, level = [{"cell": 0, "leaves": shards, "first": 0}], shards, 0
    while most > 1 and (cuts := _cuts(points, _widest(points, cells, dims), dims)):
        # cell numbers are those of a heap: 2c + 1 and 2c + 2 lie below c
        known = _small(docs.sparkSession, [c | {"right": c["first"] + c["leaves"] // 2} for c in cuts], "cell long, dim int, cut long, right long")
        cut, right = F.col("cut").isNotNull(), _place(dims) >= F.col("cut")
        points = points.join(F.broadcast(known), "cell", "left").select(
            "id", "size", "text_crc32", "_h", *[f"_d{i}" for i in range(dims)],
            F.when(cut, F.when(right, F.col("cell") * 2 + 2).otherwise(F.col("cell") * 2 + 1)).otherwise(F.col("cell")).alias("cell"),
            F.when(cut & right, F.col("right")).otherwise(F.col("first")).alias("first"),
        )
        level += 1
        if level % WRITTEN == 0:
            points = materialize(points, "shard-points")
        half = lambda c: c["leaves"] // 2
        cells = [{"cell": 2 * c["cell"] + 1, "leaves": half(c), "first": c["first"]} for c in cuts] + [{"cell": 2 * c["cell"] + 2, "leaves": c["leaves"] - half(c), "first": c["first"] + half(c)} for c in cuts]
        cells = [c for c in cells if c["leaves"] > 1]
        most -= most // 2
    placed = materialize(points.select("id", "size", "text_crc32", F.col("first").cast("int").alias("shard"), F.substring("_h", 1, 3).alias("_range"), "_h"), "shard-placed")
    placed = prefix_sum(placed, ["shard"], "_range", [F.col("_h"), F.col("id")], F.lit(1).cast("long"), "slot")
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")
