"""Assignment of units to questions, refinement, rankings and balance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenforge.functions import text as T
from lumenforge.operators import blocks
from lumenforge.plans.lineage import materialize
from lumenforge.plans.prefix import numbered
from lumenforge.sources import stages


def _scored(units: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units and questions with their words as numbers, ``row`` and the one block ``_g``."""
    number = lambda df: materialize(df.withColumn("row", F.monotonically_increasing_id()), "scored")
    a = number(units.select("paper", "unit", T.tokens(F.coalesce("text", F.lit(""))).alias("w"), F.lit(0).alias("_g")))
    b = number(questions.select("group_id", T.tokens(F.coalesce("question", F.lit(""))).alias("w"), F.lit(0).alias("_g")))
    both = a.select(F.concat(F.lit("u"), "row").alias("row"), "w").unionByName(b.select(F.concat(F.lit("q"), "row").alias("row"), "w"))
    words = materialize(blocks.number_words(both, "row", F.col("w")), "scored-words")
    a = a.withColumn("row", F.concat(F.lit("u"), "row")).drop("w").join(words, "row")
    b = b.withColumn("row", F.concat(F.lit("q"), "row")).drop("w").join(words, "row")
    return a, b


def score_questions(units: DataFrame, questions: DataFrame) -> DataFrame:
    """``paper, unit, group_id, shared, total, score``: the offline scorer, token Jaccard of text and question.

    A language model scores here in the reference; this stand-in is ours and deterministic. Each unit
    is scored with each question, as rankings list them all; units and questions meet in blocks
    (``blocks.meet``). Null texts have no words and score 0. Where the best alone are asked for, ``best_questions`` and
    ``best_units`` leave no such row.
    """
    kinds, group = dict(units.dtypes), dict(questions.dtypes)["group_id"]
    a, b = _scored(units, questions)

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        shared, x, y = blocks.shared_counts(left["words"], right["words"])
        total, score = blocks.jaccard(shared, x, y)
        i, j = (pa.array(v.ravel()) for v in np.indices(shared.shape))
        return pa.table([left["paper"].take(i), left["unit"].take(i), right["group_id"].take(j), pa.array(shared.ravel().astype(np.int32)), pa.array(total.ravel().astype(np.int32)), pa.array(score.ravel())], ["paper", "unit", "group_id", "shared", "total", "score"])

    schema = f"paper {kinds['paper']}, unit {kinds['unit']}, group_id {group}, shared int, total int, score double"
    return blocks.meet(a, b, ["_g"], ["row"], ["row"], solve, schema)


def best_questions(units: DataFrame, questions: DataFrame) -> DataFrame:
    """``paper, unit, group_id``: ``assign(score_questions(units, questions))`` without a row for each unit and question.

    A block of units and questions leaves the best question of each of its units, ties to the smallest id; those of a unit meet
    combined. So what is shuffled is a row per unit and 512 questions. Repeated units have one assignment; an empty table of either side gives no rows.
    """
    kinds, group = dict(units.dtypes), dict(questions.dtypes)["group_id"]
    a, b = _scored(units, questions)

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("group_id", "ascending")])
        _, score = blocks.jaccard(*blocks.shared_counts(left["words"], right["words"]))
        at = score.argmax(axis=1)  # the first of equal ones
        best = score[np.arange(len(at)), at]
        return pa.table([left["paper"], left["unit"], right["group_id"].combine_chunks().take(pa.array(at)), pa.array(best)], ["paper", "unit", "group_id", "score"])

    best = blocks.meet(a, b, ["_g"], ["row"], ["row"], solve, f"paper {kinds['paper']}, unit {kinds['unit']}, group_id {group}, score double")
    best = best.groupBy("paper", "unit").agg(F.min(F.struct((-F.col("score")).alias("s"), "group_id")).alias("b"))
    return best.select("paper", "unit", F.when(F.col("b.s") < 0, F.col("b.group_id")).alias("group_id"))


def best_units(units: DataFrame, questions: DataFrame) -> DataFrame:
    """``group_id, paper, unit, rank``: of each question and paper the best unit, ties to the smallest; ``rank_units(...)`` where the rank is 1.

    A block leaves a row for each of its questions and papers, so the rows follow the result, a question times papers, and not the units.
    A paper of any size is dealt over several blocks, whose best meet combined.
    """
    kinds, group = dict(units.dtypes), dict(questions.dtypes)["group_id"]
    a, b = _scored(units, questions)

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([("paper", "ascending"), ("unit", "ascending")])
        _, score = blocks.jaccard(*blocks.shared_counts(left["words"], right["words"]))
        paper = np.unique(left["paper"].to_numpy(zero_copy_only=False), return_inverse=True)[1]
        first = np.flatnonzero(np.diff(paper, prepend=-1))
        top = np.maximum.reduceat(score, first, axis=0)
        place = np.where(score == top[paper], np.arange(len(paper))[:, None], len(paper))
        at = np.minimum.reduceat(place, first, axis=0)  # papers by questions
        i, j = at.ravel(), np.tile(np.arange(score.shape[1]), len(first))
        take = lambda t, c, k: t[c].combine_chunks().take(pa.array(k))
        return pa.table([take(right, "group_id", j), take(left, "paper", i), take(left, "unit", i), pa.array(top.ravel())], ["group_id", "paper", "unit", "score"])

    best = blocks.meet(a, b, ["_g"], ["row"], ["row"], solve, f"group_id {group}, paper {kinds['paper']}, unit {kinds['unit']}, score double")
    best = best.groupBy("group_id", "paper").agg(F.min(F.struct((-F.col("score")).alias("s"), "unit")).alias("b"))
    return best.select("group_id", "paper", F.col("b.unit").alias("unit"), F.lit(1).alias("rank"))


def assign(scores: DataFrame) -> DataFrame:
    """The best question of each unit; null where none shares a token, ties to the smallest id.

    Repeated units have one assignment; an empty table gives no rows.
    """
    rk = F.row_number().over(Window.partitionBy("paper", "unit").orderBy(F.desc("score"), "group_id"))
    return scores.withColumn("rk", rk).filter("rk = 1").select("paper", "unit", F.when(F.col("score") > 0, F.col("group_id")).alias("group_id"))


def reassigned(before: DataFrame, after: DataFrame) -> DataFrame:
    """``reassigned, total_assigned``; a unit that had no group and has one counts as reassigned.

    A null group counts in neither; a unit that repeats in ``before`` counts once for each time; empty tables give 0 and 0.
    """
    old = before.select("paper", "unit", F.col("group_id").alias("old"))
    both = after.join(old, ["paper", "unit"], "left")
    moved = F.col("group_id").isNotNull() & ~F.col("group_id").eqNullSafe(F.col("old"))
    return both.agg(F.count_if(moved).alias("reassigned"), F.count("group_id").alias("total_assigned"))


def dropped_groups(questions: DataFrame, assignment: DataFrame) -> DataFrame:
    """``group_id``: the questions that no unit is assigned to, all of them where ``assignment`` is empty; a null id is never assigned to."""
    return questions.select("group_id").join(assignment, "group_id", "left_anti")


def rank_questions(scores: DataFrame) -> DataFrame:
    """``paper, unit, group_id, rank``: all questions of each unit, ties by id. Repeated rows have ranks of their own; an empty table gives no rows."""
    rk = F.row_number().over(Window.partitionBy("paper", "unit").orderBy(F.desc("score"), "group_id"))
    return scores.select("paper", "unit", "group_id", rk.alias("rank"))


def rank_units(scores: DataFrame) -> DataFrame:
    """``group_id, paper, unit, rank``: all units of each paper by question, ties by unit. Repeated rows have ranks of their own; an empty table gives no rows."""
    rk = F.row_number().over(Window.partitionBy("group_id", "paper").orderBy(F.desc("score"), "unit"))
    return scores.select("group_id", "paper", "unit", rk.alias("rank"))


def ranking_problem(ranking: str, expected: str):
    """Why an array is no permutation of another: null if it is."""
    duplicate = F.size(F.array_distinct(ranking)) < F.size(ranking)
    other = (F.size(F.array_except(expected, ranking)) > 0) | (F.size(F.array_except(ranking, expected)) > 0)
    return F.when(duplicate, "duplicate ids").when(other, "missing/extra ids")


def balance(members: DataFrame, ranks: DataFrame, papers: DataFrame) -> DataFrame:
    """``group_id, member_count, hits, papers, balance``: the share in percent of ``papers`` whose best unit for a group is a member.

    Papers without a ranking count below the line. Without papers the balance is 0.
    """
    top = ranks.filter("rank = 1").select("group_id", "paper", "unit")
    members = members.select("group_id", "paper", "unit")
    hits = members.join(top, ["group_id", "paper", "unit"], "left_semi").join(papers.select("paper"), "paper", "left_semi").groupBy("group_id").agg(F.count_distinct("paper").alias("hits"))
    sizes = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("member_count"))
    total = F.broadcast(papers.agg(F.count_distinct("paper").alias("papers")))  # one row
    out = sizes.join(hits, "group_id", "left").select("group_id", "member_count", F.coalesce("hits", F.lit(0).cast("long")).alias("hits")).crossJoin(total)
    return out.withColumn("balance", F.when(F.col("papers") > 0, F.col("hits") / F.col("papers") * 100).otherwise(F.lit(0.0)))


def balance_table(members: DataFrame, ranks: DataFrame, papers: DataFrame, questions: DataFrame) -> DataFrame:
    """``place, group_id, overarching_question, group_balance, member_count``: balance to one digit, the highest first, ties by ``position`` of ``questions``.

    A group without a question has an empty one and comes last among equals; without members there are no rows.
    """
    rows = balance(members, ranks, papers).join(questions.select("group_id", "position", F.col("question").alias("overarching_question")), "group_id", "left")
    rows = rows.withColumn("group_balance", T.py_round(F.col("balance"), 1))
    rows = numbered(materialize(rows, "balance"), [F.desc("group_balance"), F.asc_nulls_last("position"), F.col("group_id")], "place")
    return rows.select("place", "group_id", F.coalesce("overarching_question", F.lit("")).alias("overarching_question"), "group_balance", "member_count")


def medoid_questions(units: DataFrame, assignment: DataFrame) -> DataFrame:
    """The offline labeller: a group's question is its member's tag that shares most tokens with the group's others.

    Ties go to the smallest paper and unit; ids may be of any type that sorts. Members without a token count
    as sharing none, so every group with a member has a question.
    """
    rows = assignment.filter("group_id is not null").join(units.select("paper", "unit", F.coalesce("tag", F.lit("")).alias("tag")), ["paper", "unit"])
    words = rows.withColumn("word", F.explode(T.tokens(F.col("tag"))))
    weight = words.groupBy("group_id", "word").agg(F.count(F.lit(1)).alias("n"))
    total = words.join(weight, ["group_id", "word"]).groupBy("group_id", "paper", "unit").agg(F.sum("n").alias("s"))
    scored = rows.join(total, ["group_id", "paper", "unit"], "left").withColumn("s", F.coalesce("s", F.lit(0)))
    return scored.groupBy("group_id").agg(F.min_by("tag", F.struct(-F.col("s"), "paper", "unit")).alias("question"))


def super_group_questions(members: DataFrame) -> DataFrame:
    """The labeller one level up: ``super_group, question`` of ``super_group, group_id, question``."""
    rows = members.select(F.col("super_group").alias("group_id"), F.col("group_id").alias("paper"), F.lit(0).alias("unit"), F.col("question").alias("tag"))
    return medoid_questions(rows.drop("group_id"), rows.select("group_id", "paper", "unit")).withColumnRenamed("group_id", "super_group")


def require_questions(groups: DataFrame) -> DataFrame:
    """``groups`` (``group_id, question``), or an error if there is none or one has no question."""
    missing = groups.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("question", F.lit("")) == "").alias("empty")).collect()[0]
    if not missing["n"] or missing["empty"]:
        raise ValueError(f"{missing['empty']} of {missing['n']} groups have no question")
    return groups


def group_members(assignment: DataFrame, units: DataFrame) -> DataFrame:
    """``place, group_id, size, members``: groups of an assignment, the largest first, ties by their first member in corpus order.

    ``units`` is ``paper, unit, tag`` with ``position``, the corpus order, in which members are listed too.
    """
    rows = assignment.filter("group_id is not null").join(units.select("paper", "unit", "tag", "position"), ["paper", "unit"])
    listed = F.array_sort(F.collect_list(F.struct("position", "paper", "unit", "tag")))
    groups = rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"), F.min("position").alias("first"), F.transform(listed, lambda m: F.struct(m["paper"].alias("paper"), m["unit"].alias("unit"), m["tag"].alias("tag"))).alias("members"))
    return numbered(groups, [F.desc("size"), F.col("first")], "place").select("place", "group_id", "size", "members")


def rankings(ranks: DataFrame, key: list[str], item: str) -> DataFrame:
    """``key, ranking``: a long table of ranks as arrays, best first."""
    return ranks.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", item))), lambda s: s[item]).alias("ranking"))


def question_listing(questions: DataFrame) -> DataFrame:
    """One row ``listing``: a line ``- id: "question"`` for each, by ``position``. There are as many as candidates of one prompt."""
    line = F.concat(F.lit("- "), F.col("group_id").cast("string"), F.lit(': "'), F.coalesce("question", F.lit("")), F.lit('"'))
    return questions.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda s: s["line"]), "\n").alias("listing"))


def unit_listings(units: DataFrame) -> DataFrame:
    """``paper, listing``: a line ``- unit: "tag" -- "text"`` for each unit of a paper in order, texts on one line."""
    line = F.concat(F.lit("- "), F.col("unit").cast("string"), F.lit(': "'), F.coalesce("tag", F.lit("")), F.lit('" -- "'), T.one_line(F.col("text")), F.lit('"'))
    return units.groupBy("paper").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit", line.alias("line")))), lambda s: s["line"]), "\n").alias("listing"))


def member_listings(assignment: DataFrame, units: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """``group_id, listing``: a group's members numbered from 1 with their question, their section's if it has one, and their text.

    ``units`` is ``paper, unit, tag, text, position`` and, if ``sections`` (``paper, section_id, tag``) is given, ``section_id``.
    """
    rows = assignment.filter("group_id is not null").join(units, ["paper", "unit"])
    if sections is not None:
        rows = rows.join(sections.select("paper", "section_id", F.col("tag").alias("parent")), ["paper", "section_id"], "left")
    parent = F.coalesce("parent", F.lit("")) if sections is not None else F.lit("")
    head = F.concat(F.lit('Paragraph question: "'), F.coalesce("tag", F.lit("")), F.lit('"'), F.when(parent != "", F.concat(F.lit('\n   Parent section question: "'), parent, F.lit('"'))).otherwise(F.lit("")))
    body = F.concat(head, F.lit('\n   Paragraph content: "'), T.one_line(F.col("text")), F.lit('"'))
    listed = F.array_sort(F.collect_list(F.struct("position", body.alias("body"))))
    return rows.groupBy("group_id").agg(F.array_join(F.transform(listed, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s["body"])), "\n").alias("listing"))


def refine(units: DataFrame, questions: DataFrame, iterations: int = 5, folder: str | None = None) -> DataFrame:
    """Assign, drop empty groups, relabel, repeat: ``iter, paper, unit, group_id``.

    Each iteration's assignment and questions are tables in the shared folder. With ``folder`` they are kept
    there as ``iter=N``, and a call that finds a finished iteration reads it instead of running it. How many
    units each iteration moves is ``refinement_counts`` of the result.
    """
    spark, out, current = units.sparkSession, None, questions.select("group_id", "question")
    for n in range(1, iterations + 1):
        if folder is None:
            step = materialize(best_questions(units, current), f"iteration-{n}")
            current = materialize(medoid_questions(units, step), f"questions-{n}")
        else:
            step = stages.kept(spark, f"{folder}/assignment/iter={n}", lambda: best_questions(units, current))
            current = stages.kept(spark, f"{folder}/questions/iter={n}", lambda: medoid_questions(units, step))
        row = step.withColumn("iter", F.lit(n))
        out = row if out is None else out.unionByName(row)
    return out.select("iter", "paper", "unit", "group_id")


def refinement_counts(iterations: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """``iter, reassigned, total_assigned`` of the result of ``refine``; a unit that had no group and has one counts as reassigned."""
    old = iterations.select((F.col("iter") + 1).alias("iter"), "paper", "unit", F.col("group_id").alias("old"))
    if before is not None:
        old = old.unionByName(before.select(F.lit(1).alias("iter"), "paper", "unit", F.col("group_id").alias("old")))
    both = iterations.join(old, ["iter", "paper", "unit"], "left")
    moved = F.col("group_id").isNotNull() & ~F.col("group_id").eqNullSafe(F.col("old"))
    return both.groupBy("iter").agg(F.count_if(moved).alias("reassigned"), F.count("group_id").alias("total_assigned"))
