"""Results of stages kept in folders: sinks, resumed steps, a cache that learns, counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def kept(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, which is computed and written first if it is not finished.

    A finished table has Spark's ``_SUCCESS`` mark, so one that a lost driver left half written is written again.
    """
    if not exists(spark, f"{path}/_SUCCESS"):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cached(wanted: DataFrame, path: str, key: list[str], inputs: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Answers for ``wanted``, read from the cache at ``path`` where it has them; the others are computed and added to it.

    An answer is found by ``key`` and a digest of ``inputs``, the columns that it depends on, so that it is not taken
    for changed inputs. ``compute`` gets the misses (all columns of ``wanted``) and returns ``key`` and its answer columns. Each
    missing key is computed once. Keys must not be null; rows of ``wanted`` that repeat key and inputs get one answer.
    """
    spark = wanted.sparkSession
    digest = F.sha2(F.to_json(F.struct(*inputs), {"ignoreNullFields": "false"}), 256) if inputs else F.lit("")
    asked = wanted.withColumn("_digest", digest)
    found = spark.read.parquet(path) if exists(spark, path) else None
    misses = asked if found is None else asked.join(found.select(*key, "_digest"), [*key, "_digest"], "left_anti")
    misses = misses.dropDuplicates([*key, "_digest"])
    if not misses.isEmpty():
        answers = compute(misses.drop("_digest"))
        answers.join(misses.select(*key, "_digest"), key).write.mode("append").parquet(path)
    if not exists(spark, path):
        return compute(wanted.limit(0))
    return asked.select(*key, "_digest").distinct().join(spark.read.parquet(path), [*key, "_digest"]).drop("_digest")


def write_json(rows: DataFrame, path: str, keep_order: list[str] | None = None) -> None:
    """A stage's rows as JSON lines, nested columns and nulls included, sorted by ``keep_order`` if that is given."""
    if keep_order:
        rows = rows.orderBy(*keep_order)
    rows.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def write_papers(papers: DataFrame, path: str) -> None:
    """Paper files of one object each, partitioned by ``paper_id``: a new version; the folder that ``papers`` comes from is never written."""
    fields = [c for c in papers.columns if c not in ("file", "paper_ord")]
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false", "pretty": "true"})
    papers.select(F.col("paper_id").alias("paper"), body.alias("value")).repartition("paper").write.partitionBy("paper").mode("errorifexists").text(path)


def write_map(rows: DataFrame, key: str, value: str, path: str) -> None:
    """A JSON object per row, ``{key: value}``: the shape of ranking matrices, one line each."""
    rows.select(F.to_json(F.create_map(F.col(key).cast("string"), F.col(value))).alias("value")).write.text(path)


def matrix_two(rankings: DataFrame) -> DataFrame:
    """``group_id, papers``: for each question a map from paper to its ranking, from ``group_id, paper, ranking``."""
    return rankings.groupBy("group_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("paper").cast("string").alias("key"), "ranking")))).alias("papers"))


def observed(rows: DataFrame, name: str, **counts) -> tuple[DataFrame, Observation]:
    """``rows`` with counts that are taken while they are written, such as ``links=F.count_if(...)``; read them by ``observation.get``."""
    observation = Observation(name)
    return rows.observe(observation, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counts.items()]), observation


def usage(calls: DataFrame) -> DataFrame:
    """``label, status, created, read, input, output``: what calls wrote to and read from a prompt cache; only those that did either."""
    filled = calls.na.fill(0, ["created", "read", "input", "output"]).filter("created > 0 or read > 0")
    return filled.select("label", F.when(F.col("created") > 0, "wrote cache").otherwise("read from cache").alias("status"), "created", "read", "input", "output")


def stage_statistics(units: DataFrame, candidates: DataFrame, links: DataFrame, kept_links: DataFrame, members: DataFrame) -> DataFrame:
    """``granularity, units, candidates, links, kept_links, groups, sizes``: how many rows each step of matching leaves, and group sizes, the largest first."""
    count = lambda df, name: df.groupBy("granularity").agg(F.count(F.lit(1)).alias(name))
    counts = units.select("granularity").distinct()
    for part in (count(candidates, "candidates"), count(links, "links"), count(kept_links, "kept_links")):
        counts = counts.join(part, "granularity", "left")
    return counted_statistics(units, counts, members)


def counted_statistics(units: DataFrame, counts: DataFrame, members: DataFrame) -> DataFrame:
    """``stage_statistics`` of ``counts``, which is ``granularity, candidates, links, kept_links``."""
    sizes = members.select("granularity", "group_no", "size").distinct().groupBy("granularity").agg(F.count(F.lit(1)).alias("groups"), F.sort_array(F.collect_list("size"), asc=False).alias("sizes"))
    out = units.groupBy("granularity").agg(F.count(F.lit(1)).alias("units"))
    for part in (counts, sizes):
        out = out.join(part, "granularity", "left")
    return out.na.fill(0).withColumn("sizes", F.coalesce("sizes", F.array().cast("array<bigint>")))
