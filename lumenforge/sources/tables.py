"""Scans of the driver's Parquet tables and their bindings to units, questions and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def conv_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units bound to conversations: a paper is a conversation, a unit its turn, the tag its whole text."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("role").alias("granularity"), F.col("conv_id").alias("paper"), F.col("turn").alias("unit"),
        F.col("text").alias("tag"), F.col("text"),
        F.coalesce(F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")).alias("prev_relation"),
        F.coalesce(F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")).alias("next_relation"),
    )


def part_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units bound to parts: a paper is a brand, a unit a part, the tag its name (few distinct, many ties)."""
    p = table(spark, sf_dir, "part")
    return p.select(F.lit("part").alias("granularity"), F.col("p_brand").alias("paper"), F.col("p_partkey").alias("unit"), F.col("p_name").alias("tag"))


def region_graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entities and propositions of one graph per region.

    Entities are its nations. For each market segment of a nation's customers there is a proposition
    about the nation; for each way that line items came back, one about a segment and the supplier's nation.
    """
    customer, orders, line, supplier, nation = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "supplier", "nation"))
    entities = nation.select(F.col("n_regionkey").alias("paper"), F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("nation").alias("kind"))
    home = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("paper"))
    away = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("s_region"))
    buyers = customer.join(home, "c_nationkey")
    segment = F.concat_ws("-", F.concat(F.lit("m"), "c_nationkey"), "c_mktsegment")
    first = buyers.select("paper", segment.alias("id"), F.col("c_mktsegment").alias("predicate"), F.array(F.concat(F.lit("n"), "c_nationkey")).alias("args")).distinct()
    sold = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    sold = sold.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(away, "s_nationkey").filter("paper = s_region")
    kinds = sold.select("paper", segment.alias("m"), F.col("l_returnflag").alias("predicate"), F.concat(F.lit("n"), "s_nationkey").alias("n")).distinct()
    second = kinds.select("paper", F.concat_ws("-", "m", "n", "predicate").alias("id"), "predicate", F.array("m", "n").alias("args"))
    return entities, first.unionByName(second)


def deep_graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entities and propositions of one graph per nation, with chains, cycles and arguments that lead nowhere.

    Entities are the suppliers. A customer is a proposition about the supplier with its key; an order of a customer
    is one about the customer and about the next order, the last about the first of its nation: a chain that
    closes. Every eleventh order has an argument that is not there instead.
    """
    customer, orders, supplier = (table(spark, sf_dir, t) for t in ("customer", "orders", "supplier"))
    entities = supplier.select(F.col("s_nationkey").alias("paper"), F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind"))
    buyers = customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("paper"))
    first = customer.select(F.col("c_nationkey").alias("paper"), F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("predicate"), F.array(F.concat(F.lit("s"), "c_custkey")).alias("args"))
    placed = orders.join(buyers, "o_custkey").select("paper", "o_orderkey", "o_custkey", "o_orderpriority")
    w = Window.partitionBy("paper").orderBy("o_orderkey")
    following = F.coalesce(F.lead("o_orderkey").over(w), F.first("o_orderkey").over(w))
    more = F.when(F.col("o_orderkey") % 11 == 0, F.lit("nowhere")).otherwise(F.concat(F.lit("o"), following))
    second = placed.select("paper", F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_orderpriority").alias("predicate"), F.array(F.concat(F.lit("c"), "o_custkey"), more).alias("args"))
    return entities, first.unionByName(second)


def chain_graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entities and propositions of one graph per nation without cycles: customers about the supplier with their key, orders about their customer and
    the order before, where a key that divides by five begins anew."""
    customer, orders, supplier = (table(spark, sf_dir, t) for t in ("customer", "orders", "supplier"))
    entities = supplier.select(F.col("s_nationkey").alias("paper"), F.concat(F.lit("s"), "s_suppkey").alias("id"))
    first = customer.select(F.col("c_nationkey").alias("paper"), F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("predicate"), F.array(F.concat(F.lit("s"), "c_custkey")).alias("args"))
    placed = orders.join(customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("paper")), "o_custkey")
    before = F.concat(F.lit("o"), F.lag("o_orderkey").over(Window.partitionBy("paper").orderBy("o_orderkey")))
    own = F.concat(F.lit("c"), "o_custkey")
    second = placed.select("paper", F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_orderpriority").alias("predicate"), F.when(F.col("o_orderkey") % 5 == 0, F.array(own)).otherwise(F.array(own, before)).alias("args"))
    return entities, first.unionByName(second)
