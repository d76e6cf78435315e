"""Sections and paragraphs of papers from raw text: placing titles, cutting, and offline stand-ins for extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenforge.functions import text as T

#: Stands where a section's title was not found in its paper. Fixed value.
MISSING = "(could not automatically locate this section's text -- likely a column-layout edge case in PDF extraction)"
LONG, START, PREFIX = 25_000, 60, 60_000


def prompt_text(text: Column, most: int = PREFIX) -> Column:
    """What of a paper is read for extraction: its first ``most`` characters."""
    return F.substr(text, F.lit(1), F.lit(most))


def default_title(title: Column, paper: Column) -> Column:
    """A paper without a title goes by its id."""
    return F.coalesce(title, paper.cast("string"))


def attach_text(sections: DataFrame, raw: DataFrame) -> DataFrame:
    """``sections`` (``paper, position, title``, ...) with ``text`` and ``is_missing``: the slice of ``raw`` (``paper, text``) from its title to the next one found.

    The whole raw text is searched, in order of ``position``. A section whose title is not found gets a fixed
    sentence; so does each of a paper without raw text. A null title is not found. Any other column stays, whatever its name; those named ``text`` and ``is_missing`` are replaced. Sections of a paper that
    repeat a position each meet all slices of it, so positions must differ; an empty table gives no rows.
    """
    names = {c: f"_c{i}" for i, c in enumerate(sections.columns)}
    own = sections.toDF(*names.values())  # so that no column of ours meets one of theirs
    paper, position, title = (names[c] for c in ("paper", "position", "title"))
    titles = own.groupBy(F.col(paper).alias("paper")).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("position"), F.coalesce(title, F.lit("")).alias("title")))).alias("s"))
    cut = titles.join(raw.select("paper", F.col("text").alias("raw")), "paper")
    slices = T.slice_by_markers(F.coalesce("raw", F.lit("")), F.transform("s", lambda x: x["title"]))
    rows = cut.withColumn("slices", slices).select("paper", "slices", F.posexplode("s").alias("i", "x"))
    rows = rows.select(F.col("paper").alias("_paper"), F.col("x.position").alias("_position"), F.get("slices", F.col("i")).alias("_slice"))
    out = own.join(rows, (F.col(paper) == F.col("_paper")) & F.col(position).eqNullSafe(F.col("_position")), "left")
    kept = [c for c in names if c not in ("text", "is_missing")]
    return out.select(*[F.col(names[c]).alias(c) for c in kept], F.coalesce("_slice", F.lit(MISSING)).alias("text"), F.col("_slice").isNull().alias("is_missing"))


def missing_titles(attached: DataFrame) -> DataFrame:
    """``paper, missing``: the titles that were not found, in order; empty for papers without any."""
    listed = F.array_sort(F.collect_list(F.when(F.col("is_missing"), F.struct("position", "title"))))
    return attached.groupBy("paper").agg(F.transform(listed, lambda s: s["title"]).alias("missing"))


def long_section_guard(tag: Column, text: Column, paragraphs: Column, limit: int = LONG) -> Column:
    """``paragraphs`` (an array of ``tag, start_text, prev_relation, next_relation``), or one that stands for the whole section.

    That is so for a section of more than ``limit`` characters and for one without a response (null).
    """
    whole = F.array(F.struct(tag.alias("tag"), F.substr(text, F.lit(1), F.lit(START)).alias("start_text"), F.lit("").alias("prev_relation"), F.lit("").alias("next_relation")))
    return F.when((F.length(text) > limit) | paragraphs.isNull(), whole).otherwise(paragraphs)


def build_paragraphs(sections: DataFrame) -> DataFrame:
    """``paper, position, id, section_id, tag, text, prev_relation, next_relation``: a row for each paragraph.

    ``sections`` is ``paper, position, section_id, tag, text, paragraphs``, the last as given by an extraction (see
    ``long_section_guard``). A paragraph's text reaches from its first words to those of the next one found in its
    section; if its own are not found it is those words alone. Ids ``pa1, pa2, ...`` run through a paper's
    sections in order. Null relations are empty.
    """
    rows = sections.withColumn("_p", long_section_guard(F.col("tag"), F.coalesce("text", F.lit("")), F.col("paragraphs")))
    slices = T.slice_by_markers(F.coalesce("text", F.lit("")), F.transform("_p", lambda p: F.coalesce(p["start_text"], F.lit(""))))
    rows = rows.withColumn("_s", slices).select("paper", F.col("position").alias("section_position"), "section_id", "_s", F.posexplode("_p").alias("_n", "p"))
    text = F.coalesce(F.get("_s", F.col("_n")), F.col("p.start_text"))
    number = F.row_number().over(Window.partitionBy("paper").orderBy("section_position", "_n"))
    return rows.select("paper", number.alias("position"), F.concat(F.lit("pa"), number).alias("id"), "section_id", F.col("p.tag").alias("tag"), text.alias("text"), *[F.coalesce(f"p.{c}", F.lit("")).alias(c) for c in ("prev_relation", "next_relation")])


def replace_units(papers: DataFrame, units: DataFrame, column: str) -> DataFrame:
    """``papers`` with the array ``column`` replaced by its ``units`` (``paper_id, position``, fields), in order; empty where there are none."""
    fields = [f.name for f in papers.schema[column].dataType.elementType.fields]
    own = F.struct(*[(F.col(c) if c in units.columns else F.lit("")).cast("string").alias(c) for c in fields])
    listed = units.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", own.alias("u")))), lambda s: s["u"]).alias("_new"))
    empty = F.array().cast(papers.schema[column].dataType)
    return papers.join(listed, "paper_id", "left").withColumn(column, F.coalesce("_new", empty)).drop("_new")


def split_sections(raw: DataFrame) -> DataFrame:
    """Offline stand-in for section extraction: ``paper, position, section_id, title, tag`` from the headings of ``raw`` (``paper, text``).

    A heading is a line of its own of at most 80 characters that begins with a number (``2`` or ``2.1``, with or without a
    point) or is all capitals. A paper without one is a single section by its id. The tag is the title without its number.
    """
    lines = F.split(prompt_text(F.coalesce("text", F.lit(""))), "\n")
    heading = lambda l: (F.length(l) <= 80) & (F.regexp_like(l, F.lit(r"^\s*\d+(\.\d+)*[.)]?\s+\p{L}")) | F.regexp_like(l, F.lit(r"^\s*\p{Lu}[\p{Lu}\d &-]{3,}\s*$")))
    titles = F.transform(F.filter(lines, heading), lambda l: F.trim(l))
    titles = F.when(F.size(titles) > 0, titles).otherwise(F.array(F.col("paper").cast("string")))
    rows = raw.select("paper", F.posexplode(titles).alias("position", "title"))
    return rows.select("paper", "position", F.concat(F.lit("s"), F.col("position") + 1).alias("section_id"), "title", F.regexp_replace("title", r"^[\d.)\s]+", "").alias("tag"))


def split_paragraphs(sections: DataFrame) -> DataFrame:
    """Offline stand-in for paragraph extraction: ``sections`` with ``paragraphs``, one for each block between blank lines.

    A paragraph's tag is its first sentence, its first words the first 60 characters, and the relations name the
    neighbours' place: first, next or last.
    """
    blocks = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\n\s*\n"), lambda b: F.trim(b)), lambda b: b != "")
    rows = sections.withColumn("_b", blocks)
    last = F.size("_b") - 1
    made = F.transform("_b", lambda b, i: F.struct(F.regexp_extract(b, r"^([^.!?\n]*)", 1).alias("tag"), F.substr(b, F.lit(1), F.lit(START)).alias("start_text"), F.when(i > 0, "continues").otherwise("").alias("prev_relation"), F.when(i < last, "continues").otherwise("").alias("next_relation")))
    return rows.withColumn("paragraphs", F.when(F.size("_b") > 0, made)).drop("_b")


def sentence_graph(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Offline stand-in for graph extraction: entities ``paper, id, name, kind`` and propositions ``paper, id, predicate, args, evidence``.

    Entities are the capitalised words of a paper's first 60,000 characters, propositions its sentences with two of them or more:
    the predicate is the word behind the first, the arguments are the first two.
    """
    sentences = F.split(prompt_text(F.coalesce("text", F.lit(""))), r"(?<=[.!?])\s+")
    rows = raw.select("paper", F.posexplode(sentences).alias("n", "evidence")).withColumn("names", F.array_distinct(F.regexp_extract_all("evidence", F.lit(r"\b\p{Lu}\p{Ll}+\b"), F.lit(0))))
    name_id = lambda name: F.concat(F.lit("e-"), F.lower(name))
    entities = rows.select("paper", F.explode("names").alias("name")).groupBy("paper", name_id(F.col("name")).alias("id")).agg(F.min("name").alias("name")).withColumn("kind", F.lit("name"))
    two = rows.filter(F.size("names") > 1)
    predicate = F.regexp_extract("evidence", r"\b\p{Lu}\p{Ll}+\s+(\p{Ll}+)", 1)
    props = two.select("paper", F.concat(F.lit("p"), F.col("n") + 1).alias("id"), F.when(predicate != "", predicate).otherwise("relates").alias("predicate"), F.transform(F.slice("names", 1, 2), name_id).alias("args"), "evidence")
    return entities, props
