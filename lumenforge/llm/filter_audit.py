"""Filter interaction audit: joint failures of all sets of filters, Möbius-inverted for every order of filtering."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenforge.plans.lineage import materialize
from lumenforge.plans.skew import join_groups

WORD = r"[^\x20\x09-\x0D]+"
LETTERS = "ABCDE"


def text_flags(text: Column) -> dict[str, Column]:
    """Failures of A to D as 0 or 1: too few words, too few distinct ones, too many capitals, a mark of ``#$%&*|``."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    failed = {"A": n < 50, "B": distinct.cast("long") * 100 < n.cast("long") * 65, "C": F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * 5, "D": text.rlike(r"[#$%&*|]")}
    return {f: c.cast("long") for f, c in failed.items()}


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per input row: ``part``, the failures ``A`` to ``E`` and the marks ``good`` and ``toxic``, all 0 or 1.

    E is a text identical to that of a row with a smaller id. Texts are read once and go on as 256 bits of
    SHA-256; hashes that stand in many rows meet them by broadcast.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("hash"), *[c.alias(f) for f, c in text_flags(text).items()])
    rows = materialize(rows, "audit-rows")
    total = rows.count()
    copies = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).filter("n > 1")
    rows = join_groups(rows, materialize(copies, "audit-copies"), ["hash"], "n", total, "left")
    rows = materialize(rows.select("id", "part", *LETTERS[:4], F.coalesce(F.col("id") > F.col("first"), F.lit(False)).cast("long").alias("E")), "audit-flags")
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*[F.coalesce(F.max((F.col(c) == 1).cast("long")), F.lit(0)).alias(m) for m, c in (("good", "quality"), ("toxic", "toxic"))])
    ids = rows.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    known = materialize(marks.filter("good + toxic > 0").join(ids, "id"), "audit-marks")
    zero = F.lit(0).cast("long")
    some = join_groups(rows.filter("id is not null"), known, ["id"], "n", total, "left").withColumns({m: F.coalesce(m, zero) for m in ("good", "toxic")})
    none = rows.filter("id is null").withColumns({"good": zero, "toxic": zero})
    return some.select("part", *LETTERS, "good", "toxic").unionByName(none.select("part", *LETTERS, "good", "toxic"))


def _joint(flags: DataFrame) -> DataFrame:
    """``part`` and three arrays of 32: over the rows of a part, the sums of the product of each set's flags,
    once as they are and once times ``good`` and ``toxic``. Set number s holds filter i if bit i of s is set."""

    def product(s: int) -> Column:
        out = F.lit(1).cast("long")
        for i, f in enumerate(LETTERS):
            out = out * F.col(f) if s >> i & 1 else out
        return out

    sets = range(1 << len(LETTERS))
    # sums are combined in each task, so a part of any size sends one row of 96 numbers per task
    sums = [F.sum(product(s) * w).alias(f"{k}{s}") for k, w in (("n", F.lit(1)), ("g", F.col("good")), ("t", F.col("toxic"))) for s in sets]
    return flags.groupBy("part").agg(*sums).select("part", *[F.array(*[f"{k}{s}" for s in sets]).alias(k) for k in "ngt"])


def _survivors(joint: str) -> Column:
    """For each set of filters the rows that fail none of it: the signed sum of its subsets' joint failures, inverted one filter after another."""
    without = lambda a, bit: F.transform(a, lambda x, s: F.when(s.bitwiseAND(bit) != 0, F.get(a, s - bit) - x).otherwise(x))
    return F.aggregate(_bits(), F.col(joint), without)


def _per_filter(joint: str, weight) -> Column:
    """For each filter the sum over the sets u that hold it of ``weight(size of u)`` times their Harsanyi dividend,
    which in the game "rows removed by a set of filters" is the joint failures with the sign of odd sets positive."""

    def total(bit: Column) -> Column:
        size = lambda s: F.bit_count(s)
        dividend = lambda x, s: F.when(size(s) % 2 == 1, x).otherwise(-x) * weight(size(s))
        terms = F.transform(joint, lambda x, s: F.when(s.bitwiseAND(bit) != 0, dividend(x, s)).otherwise(F.lit(0)).cast("long"))
        return F.aggregate(terms, F.lit(0).cast("long"), lambda a, x: a + x)

    return F.transform(_bits(), total)


def _bits() -> Column:
    return F.lit([1 << i for i in range(len(LETTERS))])


def audit(flags: DataFrame) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` of the result of ``failures``.

    For each part all 120 orders of the filters with their five steps. All numbers follow from the 32
    joint-failure sums of a part: survivors of a set by Möbius inversion, rows that fail a filter alone by the
    signed sum of its supersets, and the filter's removals over all 120 orders as 120 times its Shapley value,
    the sum of the dividends of its sets shared evenly among their members.
    """
    orders = F.lit(factorial(len(LETTERS)))
    parts = _joint(flags).select(
        "part", F.col("n").alias("joint"), _survivors("n").alias("left"), _survivors("g").alias("good"), _survivors("t").alias("toxic"),
        _per_filter("n", lambda k: F.lit(1)).alias("alone"), _per_filter("n", lambda k: (orders / k).cast("long")).alias("share"),
    )
    rows = parts.select("*", F.explode(F.lit(["".join(p) for p in permutations(LETTERS)])).alias("filter_order"))
    rows = rows.select("*", F.posexplode(F.split("filter_order", "")).alias("place", "letter"))
    number = lambda letter: F.ascii(letter) - ord(LETTERS[0])
    bit = lambda letter: F.get(_bits(), number(letter))
    before = F.aggregate(F.split(F.substr("filter_order", F.lit(1), F.col("place")), ""), F.lit(0), lambda a, c: a + F.coalesce(bit(c), F.lit(0)))
    rows = rows.select("*", before.alias("before"), number(F.col("letter")).alias("filter"), bit(F.col("letter")).alias("own"))
    after = F.col("before") + F.col("own")
    gone = lambda c: F.get(c, F.col("before")) - F.get(c, after)
    failing = F.get("joint", F.col("own"))
    return rows.select(
        "part", "filter_order", (F.col("place") + 1).alias("step"), F.get("left", after).alias("kept"), gone("left").alias("removed"), (failing - gone("left")).alias("redundant"),
        F.get("alone", F.col("filter")).alias("unique_fails"), gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), F.get("share", F.col("filter")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """The audit of whole ``docs``; see ``failures`` and ``audit``.

    Null texts are empty ones and fail A alone, or E as well; a null source is the empty part, as is an empty one. A row with a
    null id never fails E, makes no other fail it and has no label; rows that repeat an id don't copy one another. A row is
    good (toxic) if any label with its id says so. Without labels both are lost nowhere; an empty table has no parts
    and gives no rows. Other columns are not read, whatever they are called.
    """
    return audit(failures(docs, labels, **columns))
