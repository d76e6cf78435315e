"""The reference's operators as queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenforge.functions import text as T
from lumenforge.operators import align, assign, match, paragraphs, reading_order
from lumenforge.plans.lineage import materialize
from lumenforge.sources import stages
from lumenforge.sources.tables import chain_graphs, conv_units, deep_graphs, part_units, region_graphs, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


_UNITS = """units AS (
  SELECT role AS granularity, conv_id AS paper, turn AS unit, text AS tag, text,
         coalesce(lag(role) OVER w, '') AS prev_relation, coalesce(lead(role) OVER w, '') AS next_relation
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
words AS MATERIALIZED (SELECT *, list_distinct(regexp_extract_all(lower(tag), '[a-z0-9]+')) AS w FROM units)"""
_TOP = _UNITS + """,
pairs AS MATERIALIZED (
  SELECT a.granularity, a.paper, a.unit, b.paper AS dst_paper, b.unit AS dst_unit, len(list_intersect(a.w, b.w)) AS shared,
         len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AS total
  FROM words a JOIN words b ON a.granularity = b.granularity AND a.paper <> b.paper),
ranked AS (
  SELECT *, CASE WHEN total > 0 THEN shared::DOUBLE / total ELSE 0 END AS score FROM pairs),
top AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY granularity, paper, unit, dst_paper ORDER BY score DESC, dst_unit) AS rk
  FROM ranked QUALIFY rk <= 3)"""
_MUTUAL = """,
links AS MATERIALIZED (
  SELECT a.* FROM top a JOIN top b ON a.granularity = b.granularity AND a.paper = b.dst_paper AND a.unit = b.dst_unit
    AND a.dst_paper = b.paper AND a.dst_unit = b.unit
  WHERE (a.paper, a.unit) < (a.dst_paper, a.dst_unit))"""
_LINKS = _TOP + _MUTUAL
# words met one by one count what two units share, and pairs below the threshold change no rank above it
_NEAR = _UNITS + """,
spread AS MATERIALIZED (SELECT granularity, paper, unit, len(w) AS n, unnest(w) AS x FROM words),
top AS MATERIALIZED (
  SELECT a.granularity, a.paper, a.unit, b.paper AS dst_paper, b.unit AS dst_unit, count(*) AS shared, any_value(a.n) + any_value(b.n) - count(*) AS total,
         count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) AS score, row_number() OVER (PARTITION BY a.granularity, a.paper, a.unit, b.paper ORDER BY score DESC, b.unit) AS rk
  FROM spread a JOIN spread b ON a.granularity = b.granularity AND a.x = b.x AND a.paper <> b.paper
  GROUP BY a.granularity, a.paper, a.unit, b.paper, b.unit HAVING score >= 0.1 QUALIFY rk <= 3)""" + _MUTUAL


# The ratio of two short strings: the longest common substring, the first in the left and then in the right one, and the same on both its sides.
_RATIO = """
matched AS (
  SELECT a AS l, b AS r, a, b, list_max(flatten([[n * 1000 - i FOR n IN range(1, length(a) - i + 2) IF strpos(b, substr(a, i, n)) > 0] FOR i IN range(1, length(a) + 1)])) AS m FROM strings
  UNION ALL
  SELECT l, r, a, b, list_max(flatten([[n * 1000 - i FOR n IN range(1, length(a) - i + 2) IF strpos(b, substr(a, i, n)) > 0] FOR i IN range(1, length(a) + 1)])) AS m
  FROM (SELECT l, r, unnest([{'a': substr(a, 1, i - 1), 'b': substr(b, 1, strpos(b, substr(a, i, n)) - 1)}, {'a': substr(a, i + n), 'b': substr(b, strpos(b, substr(a, i, n)) + n)}], recursive := true)
        FROM (SELECT *, ((m + 999) // 1000)::BIGINT AS n, (((m + 999) // 1000) * 1000 - m)::BIGINT AS i FROM matched WHERE m IS NOT NULL))
  WHERE a <> '' AND b <> ''),
ratios AS (SELECT l, r, CASE WHEN length(l) + length(r) > 0 THEN 2.0::DOUBLE * coalesce(sum((m + 999) // 1000), 0) / (length(l) + length(r)) ELSE 1 END AS ratio FROM matched GROUP BY l, r),
similar_text AS MATERIALIZED (
  SELECT l, r, 0.5::DOUBLE * CASE WHEN len(u) + len(v) > 0 THEN len(list_intersect(u, v))::DOUBLE / (len(u) + len(v) - len(list_intersect(u, v))) ELSE 0 END + 0.5::DOUBLE * ratio AS raw
  FROM (SELECT *, list_distinct(regexp_extract_all(l, '[a-z0-9]+')) AS u, list_distinct(regexp_extract_all(r, '[a-z0-9]+')) AS v FROM ratios))"""

_PARTS = """p AS (SELECT p_brand AS paper, p_partkey AS unit, p_name AS tag, lower(p_name) AS low FROM part),
strings AS (SELECT a.low AS a, b.low AS b FROM (SELECT DISTINCT low FROM p) a, (SELECT DISTINCT low FROM p) b),""" + _RATIO + """,
offers AS (SELECT paper AS dst_paper, unit AS dst_unit, tag AS dst_tag, low AS r FROM p QUALIFY row_number() OVER (PARTITION BY paper, low ORDER BY unit) <= 3),
ranked AS (SELECT l, dst_paper, dst_unit, dst_tag, round_even(raw * 1000, 0)::INT AS mille, row_number() OVER (PARTITION BY l, dst_paper ORDER BY raw DESC, dst_unit) AS rk FROM similar_text JOIN offers USING (r) QUALIFY rk <= 3),
best AS MATERIALIZED (SELECT paper, unit, tag, dst_paper, dst_unit, dst_tag, mille, rk FROM p JOIN ranked ON low = l WHERE paper <> dst_paper)"""
_NAMES = """g AS (SELECT s_suppkey AS group_id, lower(s_name) AS low FROM supplier),
strings AS (SELECT a.low AS a, b.low AS b FROM (SELECT DISTINCT low FROM g) a, (SELECT DISTINCT low FROM g) b),""" + _RATIO + """,
best AS MATERIALIZED (SELECT a.group_id, b.group_id AS dst_group, round_even(raw * 1000, 0)::INT AS mille, row_number() OVER (PARTITION BY a.group_id ORDER BY raw DESC, b.group_id) AS rk
  FROM g a JOIN similar_text s ON a.low = s.l JOIN g b ON b.low = s.r WHERE a.group_id <> b.group_id QUALIFY rk <= 3),
mutual AS MATERIALIZED (SELECT x.group_id AS group_a, x.dst_group AS group_b, x.rk, x.mille FROM best x JOIN best y ON x.group_id = y.dst_group AND x.dst_group = y.group_id WHERE x.group_id < x.dst_group)"""


def _top(spark, sf_dir):
    return match.top_matches(conv_units(spark, sf_dir))


@query(f"WITH {_TOP} SELECT granularity, paper, unit, dst_paper, dst_unit, shared, total, score, rk FROM top")
def tag_jaccard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir)


@query("""WITH p AS (SELECT p_brand AS paper, p_partkey AS unit, p_name AS tag, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS w FROM part),
t AS (SELECT DISTINCT tag, w FROM p),
s AS (SELECT a.tag AS tag, b.tag AS dst_tag, len(list_intersect(a.w, b.w)) AS shared, len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AS total FROM t a, t b),
f AS (SELECT paper AS dst_paper, tag AS dst_tag, unit AS dst_unit FROM p QUALIFY row_number() OVER (PARTITION BY paper, tag ORDER BY unit) <= 3),
r AS (SELECT tag, dst_paper, dst_unit, shared, total, shared::DOUBLE / total AS score, row_number() OVER (PARTITION BY tag, dst_paper ORDER BY shared::DOUBLE / total DESC, dst_unit) AS rk
      FROM s JOIN f USING (dst_tag) QUALIFY rk <= 3)
SELECT paper, unit, dst_paper, dst_unit, shared, total, score, rk FROM p JOIN r USING (tag) WHERE paper <> dst_paper""")
def part_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.top_matches(part_units(spark, sf_dir)).drop("granularity")


def _links(spark, sf_dir):
    return match.threshold_links(conv_units(spark, sf_dir), threshold=0.1)


@query(f"WITH {_NEAR} SELECT granularity, paper, unit, dst_paper, dst_unit, shared, total FROM links")
def mutual_topk_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).select("granularity", "paper", "unit", "dst_paper", "dst_unit", "shared", "total")


_COMPONENTS = """,
kept AS (SELECT * FROM links WHERE score >= 0.1),
e AS (SELECT granularity AS g, paper AS p, unit AS u, dst_paper AS q, dst_unit AS v FROM kept UNION SELECT granularity, dst_paper, dst_unit, paper, unit FROM kept),
reach AS (SELECT g, p, u, p AS rp, u AS ru FROM e UNION SELECT r.g, e.q, e.v, r.rp, r.ru FROM reach r JOIN e ON r.g = e.g AND r.p = e.p AND r.u = e.u),
comp AS (SELECT g, p, u, min((rp, ru)) AS c FROM reach GROUP BY ALL),
firsts AS (SELECT k.granularity AS g, comp.c, min((k.paper, k.unit, k.dst_paper, k.rk)) AS f FROM kept k JOIN comp ON k.granularity = g AND k.paper = p AND k.unit = u GROUP BY ALL),
sizes AS (SELECT g, c, count(*) AS size FROM comp GROUP BY ALL),
numbered AS (SELECT g, c, size, row_number() OVER (PARTITION BY g ORDER BY size DESC, f) AS group_no FROM sizes JOIN firsts USING (g, c))"""
_GROUPS = _LINKS + _COMPONENTS


@query(f"WITH RECURSIVE {_NEAR + _COMPONENTS} SELECT comp.g AS granularity, group_no, size, p AS paper, u AS unit FROM comp JOIN numbered USING (g, c)")
def group_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.threshold_groups(conv_units(spark, sf_dir), threshold=0.1)


@query(f"WITH RECURSIVE {_NEAR + _COMPONENTS} SELECT k.granularity, group_no, k.paper, k.unit, k.dst_paper, k.dst_unit, k.shared, k.total, k.rk FROM kept k JOIN comp ON comp.g = k.granularity AND comp.p = k.paper AND comp.u = k.unit JOIN numbered USING (g, c)")
def group_link_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of each group; ``(paper, unit, dst_paper, rk)`` is their order inside it."""
    return match.threshold_groups_and_links(conv_units(spark, sf_dir), threshold=0.1)[1].select("granularity", "group_no", "paper", "unit", "dst_paper", "dst_unit", "shared", "total", "rk")


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query(f"""WITH d AS (SELECT item_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda x: len(x) > 2 AND NOT list_contains([{_STOP}], x)) AS w FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.w, b.w)) AS shared, len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AS total
FROM d a JOIN d b ON a.item_id < b.item_id WHERE len(list_intersect(a.w, b.w)) > 0""")
def content_similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that share a content word meet on it; counting the words they meet on is the intersection."""
    words = table(spark, sf_dir, "benchmark").select("item_id", T.content_tokens(F.col("text")).alias("w"))
    rows = words.select("item_id", F.size("w").alias("n"), F.explode("w").alias("word"))
    a, b = (rows.select(F.col("item_id").alias(s), F.col("n").alias(f"n_{s}"), "word") for s in "ab")
    shared = a.join(b, "word").filter("a < b").groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("shared"))
    return shared.select("a", "b", "shared", (F.col("n_a") + F.col("n_b") - F.col("shared")).alias("total"))


_AGREE = " + ".join(f"(CASE WHEN a.{c} <> '' AND lower(trim(a.{c})) = lower(trim(b.{c})) THEN 1 ELSE 0 END)" for c in T.SLOTS)


@query(f"""WITH {_UNITS}, s AS (SELECT a.paper AS paper_a, b.paper AS paper_b, {_AGREE} AS slots FROM units a JOIN units b ON a.paper < b.paper)
SELECT slots, count(*) AS pairs, count(DISTINCT (paper_a, paper_b)) AS paper_pairs FROM s WHERE slots > 0 GROUP BY slots""")
def paragraph_slot_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of units, and of papers, agree in one, two and three slots.

    Counted over classes: units with the same three slots are one row with its papers' numbers, so pairs of classes
    stand for pairs of units. ``paragraph_slot_classes`` names the units.
    """
    units = conv_units(spark, sf_dir).select("paper", *[T.slot_value(F.col(c)).alias(c) for c in T.SLOTS])
    return match.slot_pair_counts(units)


@query(f"""WITH {_UNITS}, s AS (SELECT paper, unit, unnest([{{'slot': 'tag', 'v': tag}}, {{'slot': 'prev_relation', 'v': prev_relation}}, {{'slot': 'next_relation', 'v': next_relation}}], recursive := true) FROM units)
SELECT slot, lower(regexp_replace(v, '^\\s+|\\s+$', '', 'g')) AS value, paper, unit FROM s WHERE coalesce(v, '') <> ''""")
def paragraph_slot_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot similarity of all pairs of units as classes of equal slots; the tag is the whole text."""
    return match.slot_classes(conv_units(spark, sf_dir))


_STOPPED = "list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda x: len(x) > 2 AND NOT list_contains([" + _STOP + "], x))"


@query(f"""WITH {_UNITS}, c AS MATERIALIZED (SELECT *, {_STOPPED} AS v FROM units),
p AS MATERIALIZED (SELECT a.granularity, a.paper, a.unit, b.paper AS dst_paper, b.unit AS dst_unit, {_AGREE} AS slots, len(list_intersect(a.v, b.v)) AS shared, len(a.v) + len(b.v) - len(list_intersect(a.v, b.v)) AS total
  FROM c a JOIN c b ON a.granularity = b.granularity AND a.paper < b.paper),
r AS MATERIALIZED (SELECT *, 0.5::DOUBLE * (slots::DOUBLE / 3) + 0.5::DOUBLE * CASE WHEN total > 0 THEN shared::DOUBLE / total ELSE 0 END AS similarity FROM p),
b AS (SELECT *, rank() OVER (PARTITION BY granularity, paper, unit, dst_paper ORDER BY similarity DESC) AS ra, rank() OVER (PARTITION BY granularity, dst_paper, dst_unit, paper ORDER BY similarity DESC) AS rb FROM r)
SELECT granularity, paper, unit, dst_paper, dst_unit, slots, shared, total, similarity FROM b WHERE ra = 1 AND rb = 1""")
def mutual_best_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual best matches by the combined similarity: half the slots, half the content of whole texts."""
    return match.match_units(conv_units(spark, sf_dir))


@query()
def section_best_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as sections, dealt into papers of ten: mutual best by tag similarity and content of whole texts."""
    items = table(spark, sf_dir, "benchmark").select(F.lit("sections").alias("granularity"), F.floor(F.col("item_id") / 10).alias("paper"), F.col("item_id").alias("unit"), F.col("text").alias("tag"), "text", F.lit("").alias("prev_relation"), F.lit("").alias("next_relation"))
    return match.match_sections(items)


@query(f"""WITH RECURSIVE {_PARTS}
SELECT 'part' AS granularity, paper, unit, tag, count(*) AS matches, string_agg(dst_paper || ':' || dst_unit || '=' || mille, ' ' ORDER BY dst_paper, rk) AS listing FROM best GROUP BY ALL""")
def tag_match_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part with its most similar parts of every other brand, by tag similarity in thousandths."""
    units = part_units(spark, sf_dir)
    table_ = match.match_table(units, match.similarity_matches(units))
    entry = lambda m: F.concat(m["paper"], F.lit(":"), m["unit"].cast("string"), F.lit("="), F.round(m["similarity"] * 1000).cast("int").cast("string"))
    return table_.select("granularity", "paper", "unit", "tag", F.size("matches").alias("matches"), F.array_join(F.transform("matches", entry), " ").alias("listing"))


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("group_id"), F.col("item_id").alias("position"), F.col("text").alias("question"))


@query()
def group_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's three most similar others."""
    return match.group_matches(_questions(spark, sf_dir)).select("group_id", "dst_group", "score", "rk")


@query()
def group_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.mutual_group_links(match.group_matches(_questions(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_GROUPS}, n AS (SELECT g, count(*) AS groups, list(size ORDER BY size DESC) AS sizes FROM numbered GROUP BY g)
SELECT u.granularity, u.units, t.candidates, l.links, k.kept_links, coalesce(n.groups, 0) AS groups, coalesce(list_sum(n.sizes), 0)::BIGINT AS members
FROM (SELECT granularity, count(*) AS units FROM units GROUP BY ALL) u JOIN (SELECT granularity, count(*) AS candidates FROM top GROUP BY ALL) t USING (granularity)
JOIN (SELECT granularity, count(*) AS links FROM links GROUP BY ALL) l USING (granularity) JOIN (SELECT granularity, count(*) AS kept_links FROM kept GROUP BY ALL) k USING (granularity) LEFT JOIN n ON n.g = u.granularity""")
def stage_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each step of matching leaves."""
    units = conv_units(spark, sf_dir)
    counts = match.link_counts(units)
    if counts is not None:
        out = stages.counted_statistics(units, counts, match.threshold_groups(units, threshold=0.1))
        return out.withColumn("members", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).drop("sizes")
    top = materialize(_top(spark, sf_dir), "top")
    links = materialize(match.mutual_links(top), "mutual")
    kept = links.filter("score >= 0.1")
    out = stages.stage_statistics(units, top, links, kept, match.groups(kept))
    return out.withColumn("members", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).drop("sizes")


def _names(spark, sf_dir):
    """Suppliers as groups whose question is their name: all much alike, none equal."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("group_id"), F.col("s_suppkey").alias("position"), F.col("s_name").alias("question"))


@query(f"WITH RECURSIVE {_NAMES} SELECT group_id, dst_group, mille / 1000.0::DOUBLE AS score, rk FROM best")
def name_group_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.group_matches(_names(spark, sf_dir)).select("group_id", "dst_group", "score", "rk")


@query(f"WITH RECURSIVE {_NAMES} SELECT group_a, group_b, group_a AS position, rk, mille / 1000.0::DOUBLE AS score FROM mutual")
def name_group_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.mutual_group_links(match.group_matches(_names(spark, sf_dir)))


_SUPER = _NAMES + """,
e AS (SELECT group_a AS x, group_b AS y FROM mutual WHERE mille >= 330 UNION SELECT group_b, group_a FROM mutual WHERE mille >= 330),
reach AS (SELECT x, x AS root FROM e UNION SELECT e.y, r.root FROM reach r JOIN e ON e.x = r.x),
comp AS (SELECT x, min(root) AS c FROM reach GROUP BY x),
firsts AS (SELECT c, min((group_a, rk)) AS f FROM mutual JOIN comp ON group_a = x WHERE mille >= 330 GROUP BY c),
placed AS (SELECT c, size, row_number() OVER (ORDER BY size DESC, f) AS super_group FROM (SELECT c, count(*) AS size FROM comp GROUP BY c) JOIN firsts USING (c))"""


@query(f"WITH RECURSIVE {_SUPER} SELECT super_group, size, x AS group_id FROM comp JOIN placed USING (c)")
def super_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.super_groups(match.mutual_group_links(match.group_matches(_names(spark, sf_dir))))


@query(f"WITH RECURSIVE {_SUPER} SELECT super_group, group_a, group_b, group_a AS position, rk, mille / 1000.0::DOUBLE AS score FROM mutual JOIN comp ON group_a = x JOIN placed USING (c) WHERE mille >= 330")
def super_group_link_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of each super-group; ``(position, rk)`` is their order inside it."""
    return match.super_groups_and_links(match.mutual_group_links(match.group_matches(_names(spark, sf_dir))))[1]


def _scores(spark, sf_dir):
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("group_id"), F.col("text").alias("question"))
    return assign.score_questions(conv_units(spark, sf_dir), questions), questions


_SCORES = """u AS (SELECT conv_id AS paper, turn AS unit, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations),
q AS (SELECT item_id AS group_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS v FROM benchmark),
s AS MATERIALIZED (SELECT paper, unit, group_id, CASE WHEN len(w) + len(v) > 0 THEN len(list_intersect(w, v))::DOUBLE / (len(w) + len(v) - len(list_intersect(w, v))) ELSE 0 END AS score FROM u, q),
best AS (SELECT paper, unit, CASE WHEN score > 0 THEN group_id END AS group_id FROM s QUALIFY row_number() OVER (PARTITION BY paper, unit ORDER BY score DESC, group_id) = 1)"""


@query(f"WITH {_SCORES} SELECT * FROM best")
def assign_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.best_questions(conv_units(spark, sf_dir), _questions(spark, sf_dir))


@query(f"WITH {_SCORES}, prev AS (SELECT paper, unit, CASE WHEN unit > 0 THEN paper % 10 END AS old FROM best) SELECT count_if(group_id IS NOT NULL AND group_id IS DISTINCT FROM old) AS reassigned, count(group_id) AS total_assigned FROM best JOIN prev USING (paper, unit)")
def reassigned_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = assign.best_questions(conv_units(spark, sf_dir), _questions(spark, sf_dir))
    before = conv_units(spark, sf_dir).select("paper", "unit", F.when(F.col("unit") > 0, F.col("paper") % 10).alias("group_id"))
    return assign.reassigned(before, after)


@query(f"WITH {_SCORES} SELECT group_id FROM q WHERE group_id NOT IN (SELECT group_id FROM best WHERE group_id IS NOT NULL)")
def dropped_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = _questions(spark, sf_dir)
    return assign.dropped_groups(questions, assign.best_questions(conv_units(spark, sf_dir), questions))


@query(f"WITH {_SCORES} SELECT paper, unit, group_id, row_number() OVER (PARTITION BY paper, unit ORDER BY score DESC, group_id) AS rank FROM s")
def rank_questions_per_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.rank_questions(_scores(spark, sf_dir)[0])


@query(f"WITH {_SCORES} SELECT group_id, paper, unit, row_number() OVER (PARTITION BY group_id, paper ORDER BY score DESC, unit) AS rank FROM s")
def rank_units_per_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.rank_units(_scores(spark, sf_dir)[0])


@query("""WITH r AS (SELECT conv_id, list(turn // 2) AS r, list(turn) AS e FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN len(list_distinct(r)) < len(r) THEN 'duplicate ids' WHEN len(list_filter(e, lambda x: NOT list_contains(r, x))) > 0 OR len(list_filter(r, lambda x: NOT list_contains(e, x))) > 0 THEN 'missing/extra ids' END AS problem FROM r""")
def ranking_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.floor(F.col("turn") / 2)).alias("r"), F.collect_list("turn").alias("e"))
    return rows.select("conv_id", assign.ranking_problem("r", "e").alias("problem"))


@query(f"""WITH {_SCORES}, top AS (SELECT group_id, paper, unit FROM s QUALIFY row_number() OVER (PARTITION BY group_id, paper ORDER BY score DESC, unit) = 1),
m AS (SELECT * FROM best WHERE group_id IS NOT NULL), n AS (SELECT count(DISTINCT paper) AS papers FROM u)
SELECT group_id, count(*) AS member_count, count(t.unit) AS hits, any_value(papers) AS papers, count(t.unit)::DOUBLE / any_value(papers) * 100 AS balance
FROM m LEFT JOIN (SELECT group_id, paper, unit FROM top) t USING (group_id, paper, unit), n GROUP BY group_id""")
def group_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.balance(*_balanced(spark, sf_dir))


def _balanced(spark, sf_dir):
    units, questions = conv_units(spark, sf_dir), _questions(spark, sf_dir)
    members = materialize(assign.best_questions(units, questions).filter("group_id is not null"), "members")
    return members, assign.best_units(units, questions), table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("paper")).distinct()


@query(f"""WITH {_SCORES}, top AS (SELECT group_id, paper, unit FROM s QUALIFY row_number() OVER (PARTITION BY group_id, paper ORDER BY score DESC, unit) = 1),
m AS (SELECT * FROM best WHERE group_id IS NOT NULL), n AS (SELECT count(DISTINCT paper) AS papers FROM u),
b AS (SELECT group_id, count(*) AS member_count, round_even(count(t.unit)::DOUBLE / any_value(papers) * 100, 1) AS group_balance FROM m LEFT JOIN top t USING (group_id, paper, unit), n GROUP BY group_id)
SELECT row_number() OVER (ORDER BY group_balance DESC, group_id) AS place, group_id, text AS overarching_question, group_balance, member_count FROM b JOIN benchmark ON item_id = group_id""")
def balance_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.balance_table(*_balanced(spark, sf_dir), _questions(spark, sf_dir))


@query(f"""WITH {_SCORES}, m AS (SELECT group_id, paper, unit FROM best WHERE group_id IS NOT NULL),
g AS (SELECT group_id, count(*) AS size, min((paper, unit)) AS f, string_agg(paper || ':' || unit, ' ' ORDER BY paper, unit) AS members FROM m GROUP BY group_id)
SELECT row_number() OVER (ORDER BY size DESC, f) AS place, group_id, size, members FROM g""")
def assigned_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of the assignment, the largest first, with their members in corpus order."""
    units = conv_units(spark, sf_dir).withColumn("position", F.struct("paper", "unit"))
    out = assign.group_members(assign.best_questions(units, _questions(spark, sf_dir)), units)
    return out.withColumn("members", F.array_join(F.transform("members", lambda m: T.composite_key(m["paper"], m["unit"])), " "))


@query("""SELECT conv_id AS paper, string_agg('- ' || turn || ': "' || text || '" -- "' || trim(replace(text, chr(10), ' ')) || '"', chr(10) ORDER BY turn) AS listing FROM conversations GROUP BY conv_id""")
def unit_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.unit_listings(conv_units(spark, sf_dir))


@query("""SELECT string_agg('- ' || item_id || ': "' || text || '"', chr(10) ORDER BY item_id) AS listing FROM benchmark""")
def question_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.question_listing(_questions(spark, sf_dir))


@query(f"""WITH {_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY group_id, paper ORDER BY score DESC, unit) AS rank FROM s)
SELECT group_id, paper, string_agg(unit::VARCHAR, ' ' ORDER BY rank) AS ranking FROM r GROUP BY ALL""")
def ranking_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings of each paper's units per question as arrays, here joined to text."""
    out = assign.rankings(assign.rank_units(_scores(spark, sf_dir)[0]), ["group_id", "paper"], "unit")
    return out.withColumn("ranking", F.array_join("ranking", " "))


@query("SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<h1>') THEN length(regexp_extract(html, '(?is)^(.*?)<h1>', 1)) END AS h1, CASE WHEN regexp_matches(html, '(?i)<article>') THEN length(regexp_extract(html, '(?is)^(.*?)<article>', 1)) END AS article FROM pages")
def marker_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second marker is found without its number; both regardless of case."""
    hit = lambda m: T.find_marker(F.col("html"), F.lit(m), F.lit(0)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", hit("<H1>").alias("h1"), hit("2.1 <Article>").alias("article"))


@query("""WITH p AS (SELECT page_id, html, strpos(lower(html), '<h1>') AS a FROM pages),
q AS (SELECT *, CASE WHEN strpos(lower(substr(html, a + 1)), '</h1>') > 0 THEN a + strpos(lower(substr(html, a + 1)), '</h1>') ELSE 0 END AS b FROM p),
r AS (SELECT *, CASE WHEN strpos(lower(substr(html, greatest(a, b) + 1)), '<p>') > 0 THEN greatest(a, b) + strpos(lower(substr(html, greatest(a, b) + 1)), '<p>') ELSE 0 END AS c FROM q),
s AS (SELECT page_id, unnest([{'position': 0, 'k': a, 'e': coalesce(nullif(b, 0), nullif(c, 0))}, {'position': 1, 'k': b, 'e': nullif(c, 0)}, {'position': 2, 'k': c, 'e': NULL}, {'position': 3, 'k': 0, 'e': NULL}], recursive := true), html FROM r)
SELECT page_id, position, CASE WHEN k > 0 THEN sha256(trim(CASE WHEN e IS NULL THEN substr(html, k) ELSE substr(html, k, e - k) END, E' \\n\\t\\r')) END AS slice_sha256 FROM s""")
def marker_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four markers to each page, one found without its number and one that never stands there."""
    markers = F.array(*map(F.lit, ("<h1>", "</h1>", "2. <p>", "no such marker")))
    slices = F.posexplode(T.slice_by_markers(F.col("html"), markers)).alias("position", "slice")
    return table(spark, sf_dir, "pages").select("page_id", slices).select("page_id", "position", F.sha2(F.encode("slice", "UTF-8"), 256).alias("slice_sha256"))


@query("""WITH p AS (SELECT page_id, html, strpos(html, '<h1>') AS h, strpos(html, '<article>') AS a FROM pages),
t AS (SELECT page_id, 0 AS position, CASE WHEN h > 0 THEN trim(CASE WHEN a > h THEN substr(html, h, a - h) ELSE substr(html, h) END, E' \\n\\t\\r') END AS s FROM p
  UNION ALL SELECT page_id, 1, NULL FROM p UNION ALL SELECT page_id, 2, CASE WHEN (h > 0 AND a > h) OR (h = 0 AND a > 0) THEN trim(substr(html, a), E' \\n\\t\\r') END FROM p)
SELECT page_id AS paper, position, sha256(coalesce(s, '(could not automatically locate this section''s text -- likely a column-layout edge case in PDF extraction)')) AS text_sha256, s IS NULL AS is_missing FROM t""")
def attach_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three titles to each page, the second of which never stands there."""
    pages = table(spark, sf_dir, "pages")
    titles = F.posexplode(F.array(*map(F.lit, ("<h1>", "no such title", "<article>")))).alias("position", "title")
    out = paragraphs.attach_text(pages.select(F.col("page_id").alias("paper"), titles), pages.select(F.col("page_id").alias("paper"), F.col("html").alias("text")))
    return out.select("paper", "position", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"), "is_missing")


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, coalesce(lag(role) OVER w, '') AS prev_relation, coalesce(lead(role) OVER w, '') AS next_relation FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id AS paper, 'pa' || n AS id, 's' || turn AS section_id, role AS tag, sha256(trim(text, E' \\n\\t\\r')) AS text_sha256, prev_relation, next_relation FROM p""")
def paragraph_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn is a section with one paragraph that begins with its first 60 characters."""
    u = conv_units(spark, sf_dir)
    one = F.array(F.struct(F.col("granularity").alias("tag"), F.substr("text", F.lit(1), F.lit(60)).alias("start_text"), "prev_relation", "next_relation"))
    sections = u.select("paper", F.col("unit").alias("position"), F.concat(F.lit("s"), "unit").alias("section_id"), F.col("granularity").alias("tag"), "text", one.alias("paragraphs"))
    out = paragraphs.build_paragraphs(sections)
    return out.select("paper", "id", "section_id", "tag", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"), "prev_relation", "next_relation")


@query("""WITH p AS (SELECT page_id, html, length(html) > 25000 AS long, strpos(lower(html), '<h1>') AS a FROM pages),
q AS (SELECT *, CASE WHEN strpos(lower(substr(html, a + 1)), '</h1>') > 0 THEN a + strpos(lower(substr(html, a + 1)), '</h1>') ELSE 0 END AS b FROM p),
r AS (SELECT page_id, html, unnest(CASE WHEN long THEN [{'n': 0, 'tag': 'whole', 'k': 1, 'e': NULL, 'own': ''}] ELSE
  [{'n': 0, 'tag': 'first', 'k': a, 'e': nullif(b, 0), 'own': '<H1>'}, {'n': 1, 'tag': 'second', 'k': b, 'e': NULL, 'own': '</h1>'}, {'n': 2, 'tag': 'third', 'k': 0, 'e': NULL, 'own': 'no such start'}] END, recursive := true) FROM q),
t AS (SELECT page_id % 40 AS paper, page_id, n, tag, CASE WHEN k = 0 THEN own ELSE trim(CASE WHEN e IS NULL THEN substr(html, k) ELSE substr(html, k, e - k) END, E' \n\t\r') END AS text FROM r)
SELECT paper, 'pa' || row_number() OVER (PARTITION BY paper ORDER BY page_id, n) AS id, 's' || page_id AS section_id, tag, sha256(text) AS text_sha256 FROM t""")
def paragraph_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page is a section with three paragraphs, the last of which never begins; a paper has many sections."""
    paragraph = lambda tag, start: F.struct(F.lit(tag).alias("tag"), F.lit(start).alias("start_text"), F.lit("").alias("prev_relation"), F.lit("").alias("next_relation"))
    three = F.array(paragraph("first", "<H1>"), paragraph("second", "</h1>"), paragraph("third", "no such start"))
    sections = table(spark, sf_dir, "pages").select((F.col("page_id") % 40).alias("paper"), F.col("page_id").alias("position"), F.concat(F.lit("s"), "page_id").alias("section_id"), F.lit("whole").alias("tag"), F.col("html").alias("text"), three.alias("paragraphs"))
    return paragraphs.build_paragraphs(sections).select("paper", "id", "section_id", "tag", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


@query("""SELECT doc_id AS paper, length(coalesce(text, '')) > 25000 OR doc_id % 2 = 0 AS whole, CASE WHEN length(coalesce(text, '')) > 25000 OR doc_id % 2 = 0 THEN substr(coalesce(text, ''), 1, 60) ELSE 'start' END AS start_text FROM documents""")
def long_section_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document a section; those of even id got no response."""
    text = F.coalesce("text", F.lit(""))
    answer = F.array(F.struct(F.lit("t").alias("tag"), F.lit("start").alias("start_text"), F.lit("").alias("prev_relation"), F.lit("").alias("next_relation")))
    docs = table(spark, sf_dir, "documents").withColumn("given", F.when(F.col("doc_id") % 2 != 0, answer))
    p = F.get(paragraphs.long_section_guard(F.lit("whole"), text, F.col("given")), F.lit(0))
    return docs.select(F.col("doc_id").alias("paper"), (p["tag"] == "whole").alias("whole"), p["start_text"].alias("start_text"))


_WORDS = """w AS (SELECT l_orderkey AS doc, (l_linenumber - 1) // 4 + 1 AS page, 600.0::DOUBLE AS width, l_linenumber * 1000000 + l_partkey AS i, l_partkey::VARCHAR AS t,
  (l_suppkey * 37 % 560)::DOUBLE AS x0, (l_suppkey * 37 % 560 + 10 + l_partkey % 150)::DOUBLE AS x1, (l_linenumber * 2.5)::DOUBLE AS top FROM lineitem),
g AS (SELECT *, round_even(top / 3, 0) AS key, x0 - lag(x1) OVER (PARTITION BY doc, page, round_even(top / 3, 0) ORDER BY x0, i) AS gap, row_number() OVER (PARTITION BY doc, page, round_even(top / 3, 0) ORDER BY x0, i) AS k FROM w),
r AS (SELECT doc, page, key, max(gap) AS widest, min(x0) AS start, min(i) AS seen, list(gap ORDER BY gap) FILTER (gap IS NOT NULL) AS gaps FROM g GROUP BY ALL),
c AS (SELECT g.*, widest, start, seen, CASE WHEN len(gaps) > 1 THEN list_sort(gaps)[(len(gaps) - 1) // 2 + 1] ELSE 0 END AS typical, min(CASE WHEN gap = widest THEN k END) OVER (PARTITION BY doc, page, key) AS cut FROM g JOIN r USING (doc, page, key)),
d AS (SELECT *, min(CASE WHEN k = cut THEN x0 END) OVER (PARTITION BY doc, page, key) AS cut_x FROM c),
h AS (SELECT *, CASE WHEN k >= cut AND widest >= greatest(15, 4 * typical) AND start < width / 2 AND width / 2 < cut_x THEN 1 ELSE 0 END AS half FROM d),
l AS (SELECT doc, page, key, half, seen, any_value(width) AS width, min(top) AS top, max(x1) - min(x0) AS span, avg(x0) AS mean, string_agg(t, ' ' ORDER BY k) AS text FROM h GROUP BY ALL),
n AS (SELECT doc, page, row_number() OVER (PARTITION BY doc, page ORDER BY CASE WHEN span > 0.6 * width OR mean < width / 2 THEN 0 ELSE 1 END, top, seen, half) AS line_no, text FROM l)"""


def _words(spark, sf_dir):
    """Line items as words: four lines to a page, rows a point or two apart, widths and places that vary."""
    n, x = F.col("l_linenumber"), (F.col("l_suppkey") * 37 % 560).cast("double")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"), (F.floor((n - 1) / 4) + 1).cast("int").alias("page"), F.lit(600.0).alias("page_width"), (n * 1000000 + F.col("l_partkey")).alias("word_ord"),
        x.alias("x0"), (x + 10 + F.col("l_partkey") % 150).alias("x1"), (n * 2.5).alias("top"), F.col("l_partkey").cast("string").alias("text"),
    )


@query(f"WITH {_WORDS} SELECT doc, page, line_no, text FROM n")
def reading_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pages whose rows hold one word or several, with and without a gutter, narrow and wide."""
    return reading_order.lines(_words(spark, sf_dir))


@query(f"WITH {_WORDS}, p AS (SELECT doc, page, string_agg(text, chr(10) ORDER BY line_no) AS text FROM n GROUP BY ALL) SELECT doc, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text FROM p GROUP BY doc")
def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_order.document_text(_words(spark, sf_dir))


_GRAPH = """home AS (SELECT c_custkey, c_nationkey, c_mktsegment, n_regionkey AS paper FROM customer JOIN nation ON c_nationkey = n_nationkey),
first AS (SELECT DISTINCT paper, 'm' || c_nationkey || '-' || c_mktsegment AS id, c_mktsegment AS predicate, ['n' || c_nationkey] AS args FROM home),
sold AS (SELECT DISTINCT h.paper, 'm' || c_nationkey || '-' || c_mktsegment AS m, l_returnflag AS predicate, 'n' || s_nationkey AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN home h ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = h.paper),
props AS (SELECT * FROM first UNION ALL SELECT paper, m || '-' || n || '-' || predicate, predicate, [m, n] FROM sold),
cand AS (SELECT DISTINCT a.paper AS paper_a, b.paper AS paper_b, a.id AS a, b.id AS b, a.args AS x, b.args AS y FROM props a JOIN props b ON lower(a.predicate) = lower(b.predicate) AND len(a.args) = len(b.args) AND a.paper < b.paper)"""


@query(f"WITH {_GRAPH} SELECT paper_a, paper_b, count(*) AS pairs FROM cand GROUP BY ALL")
def proposition_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.proposition_candidates(region_graphs(spark, sf_dir)[1]).groupBy("paper_a", "paper_b").agg(F.count(F.lit(1)).alias("pairs"))


@query(f"WITH {_GRAPH}, o AS (SELECT paper, id, len(args) - 1 AS o FROM props) SELECT paper, count(*) AS propositions, max(o) AS max_order, avg(o) AS mean_order FROM o GROUP BY paper")
def systematicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.systematicity(region_graphs(spark, sf_dir)[1])


@query(f"""WITH {_GRAPH}, ok AS (SELECT c.* FROM cand c WHERE len(x) = 1 OR EXISTS (SELECT 1 FROM cand d WHERE d.paper_a = c.paper_a AND d.paper_b = c.paper_b AND d.a = c.x[1] AND d.b = c.y[1]))
SELECT paper_a, paper_b, count(*) AS surviving FROM ok GROUP BY ALL""")
def arc_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, props = region_graphs(spark, sf_dir)
    side = lambda s: entities.select(F.col("paper").alias(f"paper_{s}"), F.col("id").alias(s))
    pairs = side("a").join(side("b"), F.col("paper_a") < F.col("paper_b"))
    alive, _ = align.arc_consistency(pairs, align.proposition_candidates(props), entities)
    return alive.groupBy("paper_a", "paper_b").agg(F.count(F.lit(1)).alias("surviving"))


@query("""WITH o AS (SELECT c_nationkey AS paper, o_orderkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey) AS k FROM orders JOIN customer ON o_custkey = c_custkey),
runs AS (SELECT paper, o_orderkey, sum((o_orderkey % 5 = 0)::INT) OVER (PARTITION BY paper ORDER BY o_orderkey) AS run FROM o),
d AS (SELECT paper, row_number() OVER (PARTITION BY paper, run ORDER BY o_orderkey) AS depth FROM runs UNION ALL SELECT c_nationkey, 0 FROM customer)
SELECT paper, count(*) AS propositions, max(depth) AS max_order, avg(depth) AS mean_order FROM d GROUP BY paper""")
def chain_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systematicity of chains: an order is about its customer and, unless its key divides by five, about the order before it in its nation."""
    entities, props = chain_graphs(spark, sf_dir)
    return align.systematicity(props, entities=entities)


@query()
def deep_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systematicity of graphs with long chains that close to cycles."""
    entities, props = deep_graphs(spark, sf_dir)
    papers = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("paper"))
    return align.systematicity(props, papers, entities)


@query(f"""WITH {_GRAPH}, ok AS (SELECT c.* FROM cand c WHERE len(x) = 1 OR EXISTS (SELECT 1 FROM cand d WHERE d.paper_a = c.paper_a AND d.paper_b = c.paper_b AND d.a = c.x[1] AND d.b = c.y[1])),
gone AS (SELECT * FROM cand WHERE (paper_a, paper_b, a, b) NOT IN (SELECT (paper_a, paper_b, a, b) FROM ok)),
log AS (SELECT paper_a, paper_b, 1 AS step, 'candidate' AS kind, a, b, NULL AS detail FROM cand
  UNION ALL SELECT paper_a, paper_b, 2, 'removed', a, b, 'argument 0: sub-proposition ' || x[1] || '/' || y[1] || ' didn''t survive an earlier pass' FROM gone
  UNION ALL SELECT paper_a, paper_b, 2 + ((paper_a, paper_b) IN (SELECT (paper_a, paper_b) FROM gone))::INT, 'survivor', a, b, NULL FROM ok)
SELECT paper_a, paper_b, row_number() OVER (PARTITION BY paper_a, paper_b ORDER BY step, a, b) AS ordinal, step, kind, a, b, detail FROM log""")
def alignment_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happened to each pair of propositions of two regions, before kernels are merged."""
    return align.Alignment(*region_graphs(spark, sf_dir)).events().filter("kind in ('candidate', 'removed', 'survivor')")


@query()
def alignment_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps, passes, removed pairs and merge conflicts of each two regions."""
    out = align.Alignment(*region_graphs(spark, sf_dir)).trace()
    removed = F.aggregate("connectivity_passes", F.lit(0), lambda a, p: a + F.size(p["removed"]))
    return out.select("paper_a", "paper_b", "steps", F.size("candidates").alias("candidates"), F.size("surviving").alias("surviving"), removed.alias("removed"), F.size(F.filter("merge_steps", lambda m: m["decision"] == "rejected")).alias("rejected"))


@query()
def correspondences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.Alignment(*region_graphs(spark, sf_dir)).correspondences()


@query(f"""WITH RECURSIVE n AS (SELECT n_regionkey AS paper, 'n' || n_nationkey AS id, lower(n_name) AS low FROM nation),
strings AS (SELECT DISTINCT x.low AS a, y.low AS b FROM n x JOIN n y ON x.paper < y.paper), {_RATIO}
SELECT x.paper AS paper_a, y.paper AS paper_b, x.id AS a, y.id AS b, raw + 0.2::DOUBLE AS score FROM n x JOIN n y ON x.paper < y.paper JOIN similar_text s ON s.l = x.low AND s.r = y.low""")
def entity_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.entity_candidates(region_graphs(spark, sf_dir)[0])


@query()
def alignment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(*region_graphs(spark, sf_dir))


@query(f"""WITH RECURSIVE {_PARTS}
SELECT 'part' AS granularity, a.paper, a.unit, a.dst_paper, a.dst_unit, a.mille / 1000.0::DOUBLE AS score, a.rk FROM best a
JOIN best b ON a.paper = b.dst_paper AND a.unit = b.dst_unit AND a.dst_paper = b.paper AND a.dst_unit = b.unit WHERE (a.paper, a.unit) < (a.dst_paper, a.dst_unit) AND a.mille >= 450""")
def tag_similarity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.similarity_links(part_units(spark, sf_dir))


def _refined(rounds: int) -> str:
    """SQL of so many rounds of assigning and relabelling, one after another."""
    out = ["u AS MATERIALIZED (SELECT conv_id AS paper, turn AS unit, text AS tag, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations)", "q1 AS (SELECT item_id AS group_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS v FROM benchmark)"]
    for n in range(1, rounds + 1):
        out += [
            f"s{n} AS (SELECT paper, unit, group_id, CASE WHEN len(w) + len(v) > 0 THEN len(list_intersect(w, v))::DOUBLE / (len(w) + len(v) - len(list_intersect(w, v))) ELSE 0 END AS score FROM u, q{n})",
            f"b{n} AS MATERIALIZED (SELECT paper, unit, CASE WHEN score > 0 THEN group_id END AS group_id FROM s{n} QUALIFY row_number() OVER (PARTITION BY paper, unit ORDER BY score DESC, group_id) = 1)",
            f"w{n} AS MATERIALIZED (SELECT group_id, paper, unit, unnest(w) AS x FROM b{n} JOIN u USING (paper, unit) WHERE group_id IS NOT NULL)",
            f"t{n} AS (SELECT group_id, paper, unit, sum(n) AS s FROM w{n} JOIN (SELECT group_id, x, count(*) AS n FROM w{n} GROUP BY ALL) USING (group_id, x) GROUP BY ALL)",
            f"q{n + 1} AS MATERIALIZED (SELECT group_id, w AS v FROM b{n} JOIN u USING (paper, unit) LEFT JOIN t{n} USING (group_id, paper, unit) WHERE group_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY coalesce(s, 0) DESC, paper, unit) = 1)",
        ]
    return "WITH " + ",\n".join(out) + " " + " UNION ALL ".join(f"SELECT {n} AS iter, paper, unit, group_id FROM b{n}" for n in range(1, rounds + 1))


@query(_refined(5))
def refine_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = assign.require_questions(_questions(spark, sf_dir))
    return assign.refine(conv_units(spark, sf_dir), questions, 5)

