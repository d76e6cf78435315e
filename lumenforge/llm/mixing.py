"""Mix sources to target weights: random keys, range order within a source, prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenforge.plans.lineage import materialize
from lumenforge.plans.prefix import prefix_sum
from lumenforge.plans.skew import join_groups

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix"
SOURCES = 10_000  # up to so many, their cuts are broadcast


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(id_: Column, seed: str) -> Column:
    return F.md5(F.encode(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(f"|{seed}")), "UTF-8"))


def source_group(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """``_source, source_size, target`` for a table of ``_source, source_size``.

    Sources by code point (null last) take ``weights`` in turn. Their targets share the sum of all
    sizes by weight, none above ``max_epochs`` times its size: with sources in order of size per
    weight, those whose cap lies below the level that the rest would get are capped, and the level
    of the rest follows in closed form. The windows run over one row per source.
    """
    last = F.col("_source").isNull()
    cycle = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(last, "_source")) - 1) % len(weights) + 1).cast("int"))
    sizes = sizes.withColumn("_weight", cycle).withColumn("_cap", F.col("source_size") * max_epochs)
    by_room = Window.orderBy(F.col("_cap") / F.col("_weight"), last, "_source")
    before, onward = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_weight").over(onward)
    sizes = sizes.withColumn("_level", level).withColumn("_capped", F.col("_cap") / F.col("_weight") <= F.col("_level"))
    first_free = F.min(F.when(~F.col("_capped"), F.struct((F.col("_cap") / F.col("_weight")).alias("r"), last.alias("l"), F.col("_source").alias("s"), F.col("_level").alias("level")))).over(Window.partitionBy())
    return sizes.select("_source", "source_size", *(["_rows"] if "_rows" in sizes.columns else []), F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(first_free["level"] * F.col("_weight")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: str = SEED) -> DataFrame:
    """One row per input row: ``id, size, source_size, target, taken``.

    Every row gets a key hashed from its id. Within a source, rows stand in key order, cut into 4096
    key ranges; prefix sums of sizes across and inside the ranges place each row, and the source's
    budget (its target, rounded) falls into whole epochs plus a cut at the exact word. So
    ``taken`` adds up to the budget, and no row gives more than ``max_epochs`` times its size.

    Null text has size 0 and is taken 0 times its words; null source is a source of its own, last in
    order; rows with equal ids are ordered by size. Reruns agree. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.lit("").alias("_mark"))
    placed = _placed(rows, weights, max_epochs, seed)
    taken = F.col("_epochs") * F.col("size") + F.least("size", F.greatest(F.lit(0).cast("long"), F.col("_rest") - F.col("_before")))
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"))


def _placed(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: str = SEED) -> DataFrame:
    """``id, size, _key, _mark, _group, source_size, target, _before, _epochs, _rest`` of ``id, source, size, _mark``: each row's words before it in its
    source, in the order ``(key, id, size, mark)``, the source's whole epochs and the words of the last, partial one."""
    rows = materialize(rows.withColumn("_key", random_key(F.col("id"), seed)), "mix-rows")
    targets = source_targets(rows.groupBy(F.col("source").alias("_source")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows")), weights, max_epochs)
    targets = materialize(targets.withColumn("_group", source_group(F.col("_source"))).drop("_source"), "mix-targets")
    rows = rows.select("id", "size", "_key", "_mark", source_group(F.col("source")).alias("_group"), F.substring("_key", 1, 3).alias("_range"))
    placed = materialize(prefix_sum(rows, ["_group"], "_range", [F.col("_key"), F.col("id"), F.col("size"), F.col("_mark")], "size", "_before"), "mix-placed")
    budget = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    out = join_groups(placed, targets, ["_group"], "_rows", placed.count()).withColumn("_epochs", whole)
    out = out.withColumn("_rest", (budget - F.col("_epochs") * F.col("source_size")).cast("long"))
    return out.select("id", "size", "_key", "_mark", "_group", "source_size", "target", "_before", "_epochs", "_rest")


def _row_mark(rows: DataFrame, text: str) -> Column:
    """A digest of all columns; the text enters by its own, so that a long one is not copied."""
    others = F.to_json(F.struct(*[c for c in rows.columns if c != text]))
    return F.md5(F.encode(F.concat_ws("|", F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("none")), others), "UTF-8"))


def _cut_rows(plan: DataFrame, marks: DataFrame) -> DataFrame:
    """``_group, _epochs, _cut, _n``: each source's last row, in the order of the mix, that is taken once more than ``_epochs``, as its place
    ``(key, id, size, mark)``, and how many rows of that place are."""
    more = 2 * (F.col("_rest") - F.col("_before")) > F.col("size")
    place = F.struct("_key", "id", "size", "_mark")
    taken = plan.filter(more).groupBy("_group", place.alias("_cut")).agg(F.count(F.lit(1)).alias("_n"))
    last = taken.groupBy("_group").agg(F.max_by("_n", "_cut").alias("_n"), F.max("_cut").alias("_cut"))
    return marks.join(last, "_group", "left").select("_group", "_epochs", "_cut", F.coalesce("_n", F.lit(0).cast("long")).alias("_n"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: whole rows of ``docs`` with their own columns, once for each epoch that takes them.

    The row that a cut falls into is taken if at least half of it lies before the cut; of a source without words nothing is taken. Since
    rows come in the order of the plan, each row learns from the cut of its source how often it is taken, and no text is shuffled but those
    that stand at a cut: rows there that agree in all columns, a third of the table if need be, meet combined, and as many
    of them are taken once more as the plan says. So the targets are met with repeated and null ids as well. Null ids
    and sources are values like others. Columns may have any name; an empty table gives no rows.
    """
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    seed = options.get("seed", SEED)
    rows = docs.toDF(*names.values())
    own = F.struct(*names.values())
    rows = rows.withColumns({"_id": F.col(names[id_col]), "_group": source_group(F.col(names[source_col])), "_size": word_count(F.col(names[text_col])), "_own_key": random_key(F.col(names[id_col]), seed), "_mark": _row_mark(rows, names[text_col])})
    marked = rows.select(F.col(names[source_col]).alias("source"), F.col("_id").alias("id"), F.col("_size").alias("size"), "_mark")
    plan = materialize(_placed(marked, seed=seed, **{k: v for k, v in options.items() if k != "seed"}), "mix-plan")
    cuts = materialize(_cut_rows(plan, plan.select("_group", "_epochs").distinct()), "mix-cuts")
    # a row for each source: broadcast where they are few, else sources with many rows alone are
    if cuts.count() <= SOURCES:
        met = rows.join(F.broadcast(cuts), "_group")
    else:
        sizes = plan.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows"))
        met = join_groups(rows, materialize(cuts.join(sizes, "_group"), "mix-cuts"), ["_group"], "_rows", plan.count())
    place = F.struct(F.col("_own_key").alias("_key"), F.col("_id").alias("id"), F.col("_size").alias("size"), "_mark")
    whole = [*names.values()]
    at_cut = place.eqNullSafe(F.col("_cut"))
    plain = met.filter(~at_cut).select(*whole, (F.col("_epochs") + F.coalesce(place < F.col("_cut"), F.lit(False)).cast("long")).alias("_copies"))
    equal = met.filter(at_cut).groupBy("_group", "_mark").agg(F.first(own).alias("_row"), F.count(F.lit(1)).alias("_m"), F.first("_epochs").alias("_epochs"), F.first("_n").alias("_n"))
    equal = equal.select("_row.*", (F.col("_m") * F.col("_epochs") + F.least("_n", "_m")).alias("_copies"))
    out = plain.unionByName(equal).filter("_copies > 0")
    return out.select(*whole, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy")).select(*whole).toDF(*names)
