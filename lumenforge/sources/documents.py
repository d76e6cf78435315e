"""Paper files and manifests: input lists, validated JSON scans, manifest building, units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.plans.prefix import numbered
from lumenforge.sources import stages

UNIT = "id STRING, title STRING, tag STRING, text STRING, prev_relation STRING, next_relation STRING, section_id STRING"
PAPER = f"paper_id STRING, title STRING, sections ARRAY<STRUCT<{UNIT}>>, paragraphs ARRAY<STRUCT<{UNIT}>>"
#: Files of a folder of papers that hold no paper.
OTHER_FILES = ("manifest.json", "links.json")
MANIFEST = "paper_id STRING, title STRING, file STRING"


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """Paper files, one object each, with ``file``. Broken JSON and missing required fields are errors.

    ``manifest.json`` and ``links.json`` of the same folder are no paper files.
    """
    raw = spark.read.schema(PAPER).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("file", F.col("_metadata.file_name"))
    raw = raw.filter(~F.col("file").isin(*OTHER_FILES))
    whole = F.col("paper_id").isNotNull() & F.col("title").isNotNull() & F.col("sections").isNotNull()
    for units in ("sections", "paragraphs"):
        whole &= F.forall(F.coalesce(units, F.array().cast(f"array<struct<{UNIT}>>".replace(" STRING", ":string"))), lambda u: u["id"].isNotNull() & u["tag"].isNotNull())
    checked = F.when(whole, F.col("paper_id")).otherwise(F.raise_error(F.concat(F.lit("a required field is missing in "), "file")))
    return raw.withColumn("paper_id", checked)


def input_files(spark: SparkSession, paths: list[str], suffix: str = ".pdf") -> tuple[DataFrame, list[str]]:
    """``paper_id, path, content`` of the files in ``paths`` that exist, and the paths that don't. The id is the file's name without ``suffix``."""
    missing = [p for p in paths if not stages.exists(spark, p)]
    present = [p for p in paths if p not in missing]
    if not present:
        return spark.createDataFrame([], "paper_id string, path string, content binary"), missing
    files = spark.read.format("binaryFile").load(present)
    name = F.substring_index("path", "/", -1)
    return files.select(F.regexp_replace(name, F.lit(f"\\Q{suffix}\\E$"), F.lit("")).alias("paper_id"), "path", "content"), missing


def subset(papers: DataFrame, wanted: list[str] | None) -> DataFrame:
    """The papers ``wanted`` with ``paper_ord`` in that order; all of them, in their own order, if none is named. An unknown id is an error."""
    if not wanted:
        return papers
    known = {r[0] for r in papers.filter(F.col("paper_id").isin(wanted)).select("paper_id").distinct().collect()}
    if lost := [p for p in wanted if p not in known]:
        raise ValueError(f"no such paper: {', '.join(lost)}")
    place = F.array_position(F.array(*map(F.lit, wanted)), F.col("paper_id")) - 1
    return papers.filter(F.col("paper_id").isin(wanted)).withColumn("paper_ord", place.cast("int"))


def manifest(papers: DataFrame) -> DataFrame:
    """``paper_ord, paper_id, title, file`` in order of file name; other files of the folder don't count."""
    return numbered(papers.select("paper_id", "title", "file"), ["file"], "paper_ord", start=0).select(F.col("paper_ord").cast("int").alias("paper_ord"), "paper_id", "title", "file")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array whose order is the canonical order of papers."""
    text = spark.read.text(path, wholetext=True)
    items = F.from_json("value", f"array<struct<{MANIFEST.replace(' STRING', ':string')}>>", {"mode": "FAILFAST"})
    return text.select(F.posexplode(items).alias("paper_ord", "m")).select("paper_ord", "m.*")


def units(papers: DataFrame, order: DataFrame) -> DataFrame:
    """Sections and paragraphs as rows in canonical order, defaults filled in."""
    ranked = papers.drop("title", "paper_ord").join(order.select("paper_id", "paper_ord"), "paper_id")
    out = None
    for granularity in ("sections", "paragraphs"):
        rows = ranked.select(F.lit(granularity).alias("granularity"), "paper_id", "paper_ord", F.posexplode(granularity).alias("unit_ord", "u")).select("granularity", "paper_id", "paper_ord", "unit_ord", *[F.coalesce(F.col(f"u.{c}"), F.lit("")).alias("unit_id" if c == "id" else c) for c in ("id", "title", "tag", "text", "prev_relation", "next_relation", "section_id")])
        out = rows if out is None else out.unionByName(rows)
    return out
