"""Spelling variants: words one edit apart by a rare-first filter of positional bigrams, and chains to the form that is most usual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenforge.plans.lineage import discard, materialize

RUN = r"[A-Za-z\x{C0}-\x{FF}]+"
PREFIX = 3  # an edit breaks two bigrams at most, so two words one edit apart share one of the three rarest


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least: int = 3, damage: int = 97) -> DataFrame:
    """``word, n``: the words of whole texts with at least ``least_length`` code points that occur at least ``least`` times.

    A run of letters is lower-cased in A-Z alone. Let h be the CRC-32 of ``id:run``; where ``damage`` divides h, the run
    loses its code point h mod length. Counts are combined in each task, so a word of a third of all rows is one row per task.
    """
    runs = F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.filter(F.length("run") >= least_length)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", capitals, capitals.lower())).otherwise(F.col("run"))
    rows = rows.select("id", low.alias("run")).withColumn("h", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = rows.select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _bigrams(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.struct(i.alias("place"), F.substr(word, i, F.lit(2)).alias("gram")))


def rarest_bigrams(words: DataFrame) -> DataFrame:
    """``word, place, gram``: of each word the three positional bigrams that come first by (words that hold the bigram, bigram, place).

    All words have one order, in which an edit keeps the untouched bigrams of both words as they are. Bigrams are those
    of an alphabet of 90 letters, 8,100 at most, so their frequencies may be broadcast.
    """
    grams = words.select("word", F.inline(_bigrams(F.col("word"))))
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    ranked = grams.join(F.broadcast(often), "gram").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("often", "gram", "place"))).alias("g"))
    return ranked.select("word", F.inline(F.slice("g", 1, PREFIX))).select("word", "place", "gram")


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, b``: each two words of ``words`` (``word, n``) that differ by exactly one inserted, deleted or replaced code point, once each.

    Words meet on one of their three rarest bigrams, whose places differ by at most as much as the lengths do:
    by nothing after a replacement, by nothing or one after an insertion. An edit also leaves the words' first or last half as it is,
    which parts what a frequent bigram gathers into small buckets. What meets is verified there by its edit distance.
    """
    rows = rarest_bigrams(words).withColumn("long", F.length("word"))
    half = lambda length: F.floor(length / 2).cast("int")
    own = rows.select(F.col("word").alias("b"), "gram", "place", "long", F.explode(F.array(F.lit(0), F.lit(1))).alias("grown"))
    # of two words the shorter names the length of the halves, so the longer offers them as one that has grown as well
    own = own.select("b", "gram", "place", "long", "grown", F.inline(ends_of(F.col("b"), half(F.col("long") - F.col("grown")))))
    other = rows.select(F.col("word").alias("a"), "gram", F.col("long").alias("was"), F.inline(F.array(*[F.struct((F.col("place") + s).alias("place"), F.lit(g).alias("grown")) for g, s in ((0, 0), (1, 0), (1, 1))])))
    other = other.select("a", "gram", "place", (F.col("was") + F.col("grown")).alias("long"), "grown", F.inline(ends_of(F.col("a"), half(F.col("was")))))
    met = other.hint("merge").join(own, ["gram", "place", "long", "grown", "end", "part"])
    one = F.levenshtein("a", "b", 1) == 1
    return met.filter(((F.col("grown") == 1) | (F.col("a") < F.col("b"))) & one).select("a", "b").distinct()


def ends_of(word: Column, length: Column) -> Column:
    """The first and the last ``length`` code points of a word."""
    return F.array(F.struct(F.lit(0).alias("end"), F.substr(word, F.lit(1), length).alias("part")), F.struct(F.lit(1).alias("end"), F.right(word, length).alias("part")))


def group_variants(words: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of a table ``word, n`` without repeated words.

    A word's form is the most frequent of its near words (ties: the first by code points) if that is at least twice as frequent
    as the word. Its root is where its forms end. Since counts double from form to form, a chain has fewer than 64 steps; each round
    every word takes the form of its form, so six rounds do, and they end when none moves. Files of words are small beside their rows in memory,
    so tables of words meet by merge: Spark would take them for broadcasts that the driver can't hold.
    """
    words = materialize(words, "spelling-words")
    pairs = materialize(near_pairs(words), "spelling-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = both.hint("merge").join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b").groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "b")).alias("best"))
    rows = words.hint("merge").join(best.withColumnRenamed("a", "word"), "word", "left")
    takes = -F.col("best.m") >= 2 * F.col("n")
    rows = rows.select("word", F.when(takes, F.col("best.b")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(takes, -F.col("best.m")).alias("form_n"))
    rows = materialize(rows, "spelling-rows")
    # words with a form alone have another root; those who don't end every chain
    roots = materialize(rows.filter("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(roots.hint("merge").join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        discard(roots)
        if after.filter("moved").isEmpty():
            break
        roots = after.drop("moved")
        roots._shared_path = after._shared_path
    return rows.hint("merge").join(after.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The words of ``docs`` with their forms and roots; see ``word_counts`` and ``group_variants``.

    Null and empty texts hold no words; a null id counts as an empty one; repeated rows count each time. A table without
    words gives no rows. Other columns are not read, whatever they are called.
    """
    return group_variants(word_counts(docs, id_col, text_col, **options))
