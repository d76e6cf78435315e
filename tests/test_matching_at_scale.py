"""Indexes, bounds, split papers, hubs and numbering against brute force, with skewed, null and empty inputs."""

import random
import re
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenforge.functions import text as T
from lumenforge.operators import align, assign, blocks, match, setjoin, similarity
from lumenforge.operators.components import connected_components
from lumenforge.plans.lineage import materialize
from lumenforge.plans.prefix import numbered

UNITS = "granularity string, paper string, unit int, tag string, prev_relation string, next_relation string, text string"
WORDS = "the of and to in red fox ran over lazy dogs while some other words stay rare here now then once twice".split()


def tokens(text):
    return set(re.findall("[a-z0-9]+", (text or "").lower()))


def share(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def skewed_units(rng, n, papers="abcde", most=0.5):
    """Half of all units in one paper, a third of all with one tag, some without a tag."""
    rows = []
    for i in range(n):
        paper = "big" if rng.random() < most else rng.choice(papers)
        tag = "the red fox ran" if rng.random() < 0.33 else rng.choice([None, "", " ".join(rng.choice(WORDS[: rng.choice([4, 20])]) for _ in range(rng.randint(1, 8)))])
        rows.append(("paragraphs", paper, i, tag, rng.choice(["x", "", None]), rng.choice(["y", "Y ", None]), rng.choice([None, tag, " ".join(rng.choices(WORDS, k=5))])))
    return rows


@pytest.mark.parametrize("postings", [3, 2048])
@pytest.mark.parametrize("threshold", [0.1, 0.5, 1.0])
def test_similar_pairs_against_all_pairs(spark, monkeypatch, postings, threshold):
    monkeypatch.setattr(setjoin, "POSTINGS", postings)
    rng = random.Random(int(threshold * 10))
    sets = {i: {"the"} | set(rng.choices(WORDS, k=rng.randint(0, 12))) for i in range(60)} | {100: set(), 101: {"alone"}, 102: {"the"}, 103: {"the"}}
    group = {i: "g" if i % 3 else "h" for i in sets}
    rows = spark.createDataFrame([(i, group[i], sorted(s)) for i, s in sets.items()], "key long, group string, words array<string>")
    ordered = setjoin.ordered_sets(rows, F.col("words"))
    got = Counter((r.a, r.b, r.shared, r.total) for r in setjoin.similar_pairs(ordered.cache(), threshold).collect())
    want = Counter((i, j, len(s & u), len(s | u)) for i, s in sets.items() for j, u in sets.items() if i < j and group[i] == group[j] and s | u and share(s, u) >= threshold)
    assert got == want
    assert setjoin.similar_pairs(ordered.limit(0), threshold).count() == 0


def test_threshold_links_are_the_mutual_links_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "POSTINGS", 8)
    rows = skewed_units(random.Random(2), 120)
    units = spark.createDataFrame(rows + rows[:5], UNITS)  # some rows repeat
    for threshold in (0.1, 0.34, 1.0):
        want = Counter(tuple(r) for r in match.mutual_links(match.top_matches(units)).filter(F.col("score") >= threshold).select("paper", "unit", "dst_paper", "dst_unit", "shared", "total", "score", "rk").distinct().collect())
        got = Counter(tuple(r) for r in match.threshold_links(units, threshold=threshold).select("paper", "unit", "dst_paper", "dst_unit", "shared", "total", "score", "rk").distinct().collect())
        assert got == want and want
    assert match.threshold_links(units.limit(0)).count() == 0 and match.threshold_links(units.filter("paper = 'a'")).count() == 0


def test_papers_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 6)
    rows = skewed_units(random.Random(3), 80)
    units = spark.createDataFrame(rows, UNITS)
    want = set()
    for a in rows:
        for paper in {r[1] for r in rows} - {a[1]}:
            others = sorted((r for r in rows if r[1] == paper), key=lambda r: (-share(tokens(a[3]), tokens(r[3])), r[2]))
            want |= {(a[1], a[2], paper, r[2], n) for n, r in enumerate(others[:3], 1)}
    got = match.top_matches(units).collect()
    assert {(r.paper, r.unit, r.dst_paper, r.dst_unit, r.rk) for r in got} == want and len(got) == len(want)

    content = lambda t: {w for w in tokens(t) if len(w) > 2 and w not in T.STOPWORDS}
    agree = lambda u, v: bool(u and v and u.strip().lower() == v.strip().lower())
    score = lambda a, b: 0.5 * (sum(agree(u, v) for u, v in zip(a[3:6], b[3:6])) / 3) + 0.5 * share(content(a[6]), content(b[6]))
    best = {(a[2], p): max(score(a, b) for b in rows if b[1] == p) for a in rows for p in {r[1] for r in rows} if p != a[1]}
    pairs = {(a[1], a[2], b[1], b[2]) for a in rows for b in rows if a[1] < b[1] and score(a, b) == best[a[2], b[1]] == best[b[2], a[1]]}
    found = match.match_units(units).collect()
    assert {tuple(r)[1:5] for r in found} == pairs and len(found) == len(pairs)
    assert all(r.similarity == best[r.unit, r.dst_paper] for r in found)


def test_best_questions_and_units_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 7)
    rows = skewed_units(random.Random(4), 90)
    units = spark.createDataFrame(rows, UNITS)
    rng = random.Random(9)
    questions = spark.createDataFrame([(i, rng.choice([None, "", " ".join(rng.choices(WORDS, k=4))])) for i in range(25)] + [(99, "no such token qq")], "group_id int, question string")
    scores = assign.score_questions(units, questions)
    assert {tuple(r) for r in assign.best_questions(units, questions).collect()} == {tuple(r) for r in assign.assign(scores).collect()}
    want = {tuple(r) for r in assign.rank_units(scores).filter("rank = 1").collect()}
    got = [tuple(r) for r in assign.best_units(units, questions).collect()]
    assert set(got) == want and len(got) == len(want) == 26 * len({r[1] for r in rows})
    for left, right in ((units.limit(0), questions), (units, questions.limit(0))):
        assert assign.best_questions(left, right).count() == 0 and assign.best_units(left, right).count() == 0


def test_bounds_are_never_below_the_ratio():
    rng = random.Random(1)
    texts = ["", "a", "ß日本", "ab" * 150, *("".join(rng.choice("abc é") for _ in range(rng.choice([3, 30, 250]))) for _ in range(40))]
    bounds = similarity.ratio_bounds(texts, texts)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            exact = SequenceMatcher(None, a, b).ratio()
            assert exact <= similarity._Target(b).ratio_bound(a) <= bounds[i, j]


def exact_similarity(a, b):
    return 0.5 * share(tokens(a), tokens(b)) + 0.5 * SequenceMatcher(None, a.lower(), b.lower()).ratio()


def test_similarity_matches_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 6)
    rows = skewed_units(random.Random(6), 50)
    units = spark.createDataFrame(rows, UNITS)
    want = set()
    for a in rows:
        for paper in {r[1] for r in rows} - {a[1]}:
            others = sorted(((exact_similarity(a[3] or "", r[3] or ""), r[2]) for r in rows if r[1] == paper), key=lambda z: (-z[0], z[1]))
            want |= {(a[1], a[2], paper, u, round(s, 3), n) for n, (s, u) in enumerate(others[:3], 1)}
    read = lambda df: {(r.paper, r.unit, r.dst_paper, r.dst_unit, r.similarity, r.rk) for r in df.collect()}
    assert read(match.similarity_matches(units)) == want
    for threshold in (0.33, 0.45):
        assert read(match.similarity_matches(units, threshold=threshold)) == {w for w in want if w[4] >= threshold}
        mutual = {w for w in want if w[:2] < w[2:4] and w[4] >= threshold and any(v[:4] == (w[2], w[3], w[0], w[1]) for v in want)}
        links = match.similarity_links(units, threshold=threshold).collect()
        assert {(r.paper, r.unit, r.dst_paper, r.dst_unit, r.score, r.rk) for r in links} == mutual


def test_only_what_bounds_let_through_is_compared():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefghij"[k : k + 4]) for _ in range(60)) for k in range(7) for _ in range(20)]
    one, half = np.zeros(len(texts), int), lambda i, t, ratio: 0.5 * ratio
    i, j, score, compared = similarity.best_in_block(texts, texts, half, np.arange(len(texts)), one, 3, 0.0)
    want = [sorted(((-0.5 * SequenceMatcher(None, a, b).ratio(), k) for k, b in enumerate(texts)))[:3] for a in texts]
    assert list(zip(i, j)) == [(n, k) for n, own in enumerate(want) for _, k in own] and [-s for s in score] == [s for own in want for s, _ in own]
    assert compared < len(texts) ** 2 / 4


def test_a_star_and_a_path(spark):
    star, path = 100_000, 10_000
    edges = spark.range(1, star + 1).selectExpr("0L as a", "id as b").unionByName(spark.range(path).selectExpr("id + 1000000 as a", "id + 1000001 as b"))
    got = {r.component: r.n for r in connected_components(edges.repartition(8)).groupBy("component").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {0: star + 1, 1_000_000: path + 1}
    named = edges.filter("a < 300 and b < 3000").selectExpr("cast(a as string) as a", "cast(b as string) as b")
    assert connected_components(named).select("component").distinct().count() == 1


def test_numbering_over_ranges(spark):
    rng = random.Random(7)
    rows = [(rng.choice("xxxy"), rng.choice([None, *range(30)]), i) for i in range(400)]
    frame = spark.createDataFrame(rows, "g string, v int, i int").repartition(5)
    order = lambda r: (r[1] is None, -(r[1] or 0), r[2])
    got = {r.i: r.n for r in numbered(frame, [F.desc_nulls_last("v"), F.col("i")], "n").collect()}
    assert got == {r[2]: n for n, r in enumerate(sorted(rows, key=order), 1)}
    inside = {r.i: r.n for r in numbered(frame, [F.desc_nulls_last("v"), F.col("i")], "n", ["g"], 0).collect()}
    assert inside == {r[2]: n for g in "xy" for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=order))}
    assert numbered(frame.limit(0), [F.col("v")], "n").count() == 0


def test_groups_carry_their_links(spark):
    links = [("paragraphs", "a", 1, "b", 1, 0.9, 1), ("paragraphs", "a", 2, "b", 1, 0.5, 2), ("paragraphs", "a", 1, "c", 7, 0.4, 1), ("paragraphs", "d", 1, "e", 1, 0.8, 1), ("sections", "a", 1, "b", 2, 0.7, 1)]
    frame = spark.createDataFrame(links, "granularity string, paper string, unit int, dst_paper string, dst_unit int, score double, rk int")
    units = spark.createDataFrame([("paragraphs", "a", 1, "A one", "t"), ("paragraphs", "b", 1, None, "u"), ("sections", "b", 2, "B two", "v")], "granularity string, paper string, unit int, title string, tag string")
    got = {(r.granularity, r.group_id): r for r in match.nested_groups(frame, units).collect()}
    assert set(got) == {("paragraphs", "group_1"), ("paragraphs", "group_2"), ("sections", "group_1")}
    first = got["paragraphs", "group_1"]
    assert [tuple(m) for m in first.members] == [("a", 1, "A one", "t"), ("a", 2, "", ""), ("b", 1, "", "u"), ("c", 7, "", "")]
    assert [(x.paper, x.unit, x.dst_paper, x.dst_unit, x.title, x.dst_tag, x.score) for x in first.links] == [("a", 1, "b", 1, "A one", "u", 0.9), ("a", 1, "c", 7, "A one", "", 0.4), ("a", 2, "b", 1, "", "u", 0.5)]
    members, rows = match.groups_and_links(frame)
    assert members.count() == 8 and rows.count() == 5 and match.nested_groups(frame.limit(0)).count() == 0
    pairs = spark.createDataFrame([("g1", "g2", 1, 1, 0.5), ("g2", "g4", 2, 1, 0.4), ("g1", "g3", 1, 2, 0.34), ("g8", "g9", 8, 1, 0.9), ("g1", "g9", 1, 3, 0.1)], "group_a string, group_b string, position int, rk int, score double")
    asked = spark.createDataFrame([("g1", "why?"), ("g9", "how?")], "group_id string, question string")
    nested = {r.super_group_id: r for r in match.nested_super_groups(pairs, asked).collect()}
    assert [tuple(m) for m in nested["super_group_1"].members] == [("g1", "why?"), ("g2", ""), ("g3", ""), ("g4", "")]
    assert [(x.group_a, x.group_b) for x in nested["super_group_1"].links] == [("g1", "g2"), ("g1", "g3"), ("g2", "g4")] and len(nested["super_group_2"].links) == 1


def test_nulls_do_not_stop_matching(spark):
    """Null units, names and questions: defined results, none lost."""
    rows = [("paragraphs", "a", None, "red fox", "", "", "red"), ("paragraphs", "b", 1, "red fox", "", "", "red"), ("paragraphs", "b", None, None, None, None, None)]
    units = spark.createDataFrame(rows, UNITS)
    top = {(r.paper, r.unit, r.dst_paper, r.dst_unit, r.score) for r in match.top_matches(units).collect()}
    assert ("a", None, "b", 1, 1.0) in top and ("b", 1, "a", None, 1.0) in top and len(top) == 4
    assert match.similarity_matches(units).count() == 4
    groups = spark.createDataFrame([(1, 1, None), (2, 2, "why"), (3, 3, None)], "group_id int, position int, question string")
    got = {(r.group_id, r.dst_group): r.score for r in match.group_matches(groups).collect()}
    assert len(got) == 6 and got[1, 3] == 0.5 and got[1, 2] == 0.0
    entities = spark.createDataFrame([("x", "e1", None, "k"), ("y", "f1", "name", None), ("y", "f2", None, "k")], "paper string, id string, name string, kind string")
    scores = {(r.a, r.b): r.score for r in align.entity_candidates(entities).collect()}
    assert scores == {("e1", "f1"): 0.0, ("e1", "f2"): 0.7}
    sim = spark.createDataFrame([(None, "a"), (None, None), ("A", "a")], "a string, b string").select(T.text_similarity(F.col("a"), F.col("b")).alias("s"))
    assert [r.s for r in sim.collect()] == [0.0, 0.5, 1.0]


def test_one_predicate_on_a_third_of_all_propositions(spark, monkeypatch):
    monkeypatch.setattr(align, "PROPOSITIONS", 5)
    rng = random.Random(12)
    rows = [(rng.choice("xyz"), f"p{i}", rng.choice(["IS", "is", "is", "has", None, f"q{i % 9}"]), rng.choice([None, [], ["e"], ["e", "f"], ["e", None]])) for i in range(90)]
    rows += rows[:4]
    frame = spark.createDataFrame(rows, "paper string, id string, predicate string, args array<string>")
    want = {(a[0], b[0], a[1], b[1]) for a in rows for b in rows if a[0] < b[0] and a[2] and b[2] and a[2].lower() == b[2].lower() and len(a[3] or []) == len(b[3] or [])}
    got = [tuple(r)[:4] for r in align.proposition_candidates(frame).collect()]
    assert set(got) == want and len(got) == len(want) > 150
    assert align.proposition_candidates(frame.limit(0)).count() == 0


def test_attached_text_keeps_columns_of_any_name(spark):
    from lumenforge.operators import paragraphs

    sections = spark.createDataFrame([("p", 1, "Intro", "s", "x", 5), ("p", None, None, "t", "y", 6), ("q", 1, "Intro", None, None, None)], "paper string, position int, title string, _slice string, raw string, _position int")
    raw = spark.createDataFrame([("p", "Intro here")], "paper string, text string")
    got = sorted(paragraphs.attach_text(sections, raw).collect(), key=lambda r: (r.paper, r.position is not None))
    assert [(r.paper, r._slice, r._position, r.is_missing) for r in got] == [("p", "t", 6, True), ("p", "s", 5, False), ("q", None, None, True)]
    assert got[1].text == "Intro here" and got[0].text == paragraphs.MISSING
    assert paragraphs.attach_text(sections.limit(0), raw).count() == 0


def test_manifest_maps_titles_and_questions_of_super_groups(spark, tmp_path):
    import json

    from lumenforge.operators import paragraphs
    from lumenforge.sources import documents, stages

    papers = spark.createDataFrame([("b", "B", "b.json"), ("a", "A", "a.json"), ("c", None, "c.json")], "paper_id string, title string, file string")
    order = documents.manifest(papers)
    assert [(r.paper_ord, r.paper_id) for r in order.orderBy("paper_ord").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps([{"paper_id": "z", "title": "Z", "file": "z.json"}, {"paper_id": "a", "title": "A", "file": "a.json"}]))
    assert [tuple(r) for r in documents.read_manifest(spark, str(path)).orderBy("paper_ord").collect()] == [(0, "z", "Z", "z.json"), (1, "a", "A", "a.json")]
    stages.write_map(spark.createDataFrame([("u1", ["g2", "g1"]), ("u2", [])], "unit string, ranking array<string>"), "unit", "ranking", str(tmp_path / "map"))
    lines = [json.loads(x) for f in (tmp_path / "map").glob("part-*") for x in f.read_text().splitlines()]
    assert sorted(map(str, lines)) == sorted(map(str, [{"u1": ["g2", "g1"]}, {"u2": []}]))
    assert {r.paper_id: r.t for r in papers.select("paper_id", paragraphs.default_title(F.col("title"), F.col("paper_id")).alias("t")).collect()} == {"a": "A", "b": "B", "c": "c"}
    members = spark.createDataFrame([(1, "g1", "why do models fail"), (1, "g2", "why do models learn"), (1, "g3", "cats"), (2, "g4", "lone")], "super_group int, group_id string, question string")
    assert {tuple(r) for r in assign.super_group_questions(members).collect()} == {(1, "why do models fail"), (2, "lone")}
    links = spark.createDataFrame([("paragraphs", "a", 1, "b", 1, 0.9, 1)], "granularity string, paper string, unit int, dst_paper string, dst_unit int, score double, rk int")
    stages.write_json(match.nested_groups(links), str(tmp_path / "groups"))
    group = json.loads(next((tmp_path / "groups").glob("part-*")).read_text())
    assert group["group_id"] == "group_1" and len(group["members"]) == 2 and group["links"][0]["dst_paper"] == "b"


def test_graphs_are_read_once_and_carry_no_lists_of_entities(spark):
    """A paper's entities never stand beside its propositions, and the steps of an alignment read written graphs."""
    entities = spark.createDataFrame([("x", f"e{i}", "n", "k") for i in range(5)] + [("y", "e0", "n", "k")], "paper string, id string, name string, kind string")
    props = spark.createDataFrame([("x", "p", "r", ["e1", None, "q", "gone"]), ("x", "q", "r", ["e2"]), ("x", "e3", "r", ["p"]), ("x", "t", "r", ["e3", "t"]), ("y", "p", "r", ["q"])], "paper string, id string, predicate string, args array<string>")
    orders = align.proposition_orders(props, entities)
    assert {(r.paper, r.id): r["order"] for r in orders.collect()} == {("x", "p"): 1, ("x", "q"): 0, ("x", "e3"): 2, ("x", "t"): 1, ("y", "p"): 0}
    assert "collect_set" not in orders._jdf.queryExecution().toString()
    assert align.Alignment(entities, props).props._shared_path


def test_papers_of_one_profile_are_counted_once(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(f"p{i}", *(rng.choice(["", "u", "a"]) if s else rng.choice(["", "t", f"own{i}"]) for s in range(3))) for i in range(40) for _ in range(i % 3 + 1)]
    met = []
    meet = blocks.meet
    monkeypatch.setattr(blocks, "meet", lambda left, *rest: met.append(left.select("profile").distinct().count()) or meet(left, *rest))
    kept = [(p, *(v.strip() for v in x)) for p, *x in rows]
    got = {r.slots: (r.pairs, r.paper_pairs) for r in match.slot_pair_counts(spark.createDataFrame(rows + [(f"c{k}", "t", "u", "a") for k in range(30)], f"paper string, {', '.join(f'{c} string' for c in T.SLOTS)}")).collect()}
    kept += [(f"c{k}", "t", "u", "a") for k in range(30)]
    pairs, papers = Counter(), set()
    for a in kept:
        for b in kept:
            n = sum(x == y != "" for x, y in zip(a[1:], b[1:]))
            if a[0] < b[0] and n:
                pairs[n] += 1
                papers.add((n, a[0], b[0]))
    assert got == {n: (pairs[n], sum(p[0] == n for p in papers)) for n in pairs}
    assert met[0] <= 41


def test_equal_questions_are_compared_once(spark):
    from pyspark.accumulators import AccumulatorParam

    texts = ["the red fox", "a red dog", "", "the red fox ran", "dogs"]
    groups = [(i, 100 - i, texts[i % 5]) for i in range(40)]

    class Pairs(AccumulatorParam):
        def zero(self, value):
            return (0, 0)

        def addInPlace(self, a, b):
            return (a[0] + b[0], a[1] + b[1])

    counted = spark.sparkContext.accumulator((0, 0), Pairs())
    got = {(r.group_id, r.rk): r.dst_group for r in match.group_matches(spark.createDataFrame(groups, "group_id int, position int, question string"), counted=counted).collect()}
    score = lambda a, b: 0.5 * share(tokens(a), tokens(b)) + 0.5 * similarity.ratio(a.lower(), b.lower())
    for i, _, a in groups:
        best = sorted((-score(a, b), p, j) for j, p, b in groups if j != i)[:3]
        assert [got[i, r] for r in (1, 2, 3)] == [j for *_, j in best]
    assert counted.value[0] == 25  # pairs of texts, not of groups


@pytest.mark.parametrize("wide", [1, 3])
def test_wide_parts_meet_part_by_part(spark, monkeypatch, wide):
    """Each pair of rows of one group meets once, in tables of about a block, and what is solved leaves piece by piece."""
    import pyarrow as pa

    monkeypatch.setattr(blocks, "WIDE", wide)
    rows = spark.createDataFrame([(i, "g" if i % 4 else "h", "x" * i) for i in range(90)], "k long, g string, t string")

    def solve(left, right):
        assert len(left) < 40 and len(right) < 40
        for a, t in zip(left["k"].to_pylist(), left["t"].to_pylist()):
            yield pa.table({"n": [len(t)] * len(right), "a": [a] * len(right), "b": right["k"].to_pylist()})

    got = Counter(tuple(r) for r in blocks.meet(rows, rows, ["g"], ["k"], ["k"], solve, "n int, a long, b long", 8).collect())
    assert got == Counter((i, i, j) for i in range(90) for j in range(90) if (i % 4 > 0) == (j % 4 > 0))


@pytest.mark.parametrize("block", [8, 512])
def test_threshold_groups_write_no_links(spark, monkeypatch, block):
    """Links of papers that fit a part were written as pairs, ranks and links on the way to their groups."""
    monkeypatch.setattr(blocks, "BLOCK", block)
    written = []
    for module in (match, setjoin):
        monkeypatch.setattr(module, "materialize", lambda df, name, f=materialize: written.append(name) or f(df, name))
    rng = random.Random(7)
    tags = [None, "", *[" ".join(rng.choices(WORDS, k=rng.randint(1, 6))) for _ in range(40)]]
    rows = [("paragraphs" if i % 4 else "turns", "big" if i % 5 == 0 else f"p{i % 23}", i, rng.choice(tags), "", "", "") for i in range(150)]
    units = spark.createDataFrame(rows, UNITS)
    want = match.mutual_links(match.top_matches(units)).filter("score >= 0.3")
    members, links = match.groups_and_links(want)
    ends = ["granularity", "group_no", "paper", "unit", "dst_paper", "dst_unit", "shared", "total", "score", "rk"]
    written.clear()
    own_members, own_links = match.threshold_groups_and_links(units, threshold=0.3)
    assert Counter(map(tuple, own_members.collect())) == Counter(map(tuple, members.select(*own_members.columns).collect()))
    assert Counter(map(tuple, own_links.select(*ends).collect())) == Counter(map(tuple, links.select(*ends).collect())) and links.count()
    assert block == 8 or not {"link-pairs", "link-ranks", "links", "large-links"} & set(written)


@pytest.mark.parametrize("wide", [1, 3])
def test_mirrored_parts_meet_once(spark, wide):
    import pyarrow as pa

    rows = spark.createDataFrame([(i, "g" if i % 4 else "h") for i in range(120)], "k long, g string")

    def solve(left, right):
        own = left["k"].to_pylist()
        pairs = [(a, b) for a in own for b in right["k"].to_pylist() if a < b or b not in own]
        return pa.table({"a": pa.array([min(p) for p in pairs], pa.int64()), "b": pa.array([max(p) for p in pairs], pa.int64())})

    got = Counter(tuple(r) for r in blocks.meet(rows, rows, ["g"], ["k"], ["k"], solve, "a long, b long", 4, mirrored=True, together=wide).collect())
    assert got == Counter((i, j) for i in range(120) for j in range(i + 1, 120) if (i % 4 > 0) == (j % 4 > 0))


def test_names_one_character_apart_are_found_without_all_pairs(spark, monkeypatch):
    """Names that all differ were compared pair by pair."""
    from pyspark.accumulators import AccumulatorParam

    class Pairs(AccumulatorParam):
        def zero(self, value):
            return (0, 0)

        def addInPlace(self, a, b):
            return (a[0] + b[0], a[1] + b[1])

    monkeypatch.setattr(similarity, "FEW", 10)
    monkeypatch.setattr(similarity, "RARE", 8)
    rng = random.Random(3)
    names = [f"Supplier#{i:09d}" for i in range(130)]
    odd = ["", " ", "-", "x", "SUPPLIER#000000007", "supplier#000000007", "000000009 supplier", "supplier#00000000", "supplier#0000000091", "red fox " * 12, "fox red " * 12]
    for texts, few in ((names, True), (names + odd, False), ([" ".join(rng.choices(WORDS[:9], k=rng.randint(0, 3))) for _ in range(120)], False)):
        counted = spark.sparkContext.accumulator((0, 0), Pairs())
        groups = [(i, 997 * i % 1009, t) for i, t in enumerate(texts)]
        got = {(r.group_id, r.rk): (r.dst_group, r.raw) for r in match.group_matches(spark.createDataFrame(groups, "group_id int, position int, question string"), counted=counted).collect()}
        score = lambda a, b: 0.5 * share(tokens(a), tokens(b)) + 0.5 * similarity.ratio(a.lower(), b.lower())
        for i, _, a in groups:
            best = sorted((-score(a, b), p, j) for j, p, b in groups if j != i)[:3]
            assert [got[i, r] for r in (1, 2, 3)] == [(j, -s) for s, _, j in best], a
        assert len(got) == 3 * len(groups)
        assert not few or counted.value[0] == 0  # no pair met in a block


@pytest.mark.parametrize("dense", [0, 6, 10**9])
@pytest.mark.parametrize("room", [20, 8_000_000])
def test_rare_numbers_are_counted_without_a_matrix(monkeypatch, dense, room):
    """Every number that two parts share was a column of a matrix, most of it zeros."""
    import pyarrow as pa

    monkeypatch.setattr(blocks, "DENSE", dense)
    rng = random.Random(dense + room)
    for n, m in ((20, 15), (1, 1), (0, 3), (3, 0)):
        left, right = ([sorted({int(rng.paretovariate(0.5)) % 90 for _ in range(rng.randint(0, 12))}) for _ in range(k)] for k in (n, m))
        shared, a, b = blocks.shared_counts(*(pa.chunked_array([pa.array(side, pa.list_(pa.int64()))]) for side in (left, right)), room)
        assert shared.tolist() == [[len(set(x) & set(y)) for y in right] for x in left]
        assert a.tolist() == [len(x) for x in left] and b.tolist() == [len(y) for y in right]


def test_ranks_within_papers_are_those_of_a_sort(monkeypatch):
    """All columns of a part were sorted for each row, whatever a paper's size."""
    rng = np.random.default_rng(4)
    for sizes in ([1], [3, 1, 12, 2], [1] * 9, []):
        paper = np.repeat(np.arange(len(sizes)), sizes)
        score = rng.integers(0, 4, (11, len(paper))) / 4
        ranks = match._paper_ranks(score, paper)
        for row in range(11 if len(paper) else 0):
            for p in range(len(sizes)):
                own = np.flatnonzero(paper == p)
                assert [int(ranks[row, c]) for c in sorted(own, key=lambda c: (-score[row, c], c))] == list(range(1, len(own) + 1))
        fast = sorted(zip(*(x.tolist() for x in match._best_places(score, paper, 2)))) if len(paper) else []
        monkeypatch.setattr(match, "SIDE", 0)
        assert fast == (sorted(zip(*(x.tolist() for x in match._best_places(score, paper, 2)))) if len(paper) else [])
        monkeypatch.undo()


def small_papers(seed):
    rng = random.Random(seed)
    tags = [None, "", *[" ".join(rng.choices(WORDS, k=rng.randint(1, 5))) for _ in range(30)], *[f"lone{i} word{i % 4}" for i in range(12)]]
    return [("paragraphs" if i % 4 else "turns", f"p{rng.randint(0, 25)}", i, rng.choice(tags), rng.choice(["x", ""]), "", rng.choice(tags)) for i in range(140)]


def test_steps_are_counted_without_their_rows(spark):
    """Every candidate and link was written to be counted."""
    rows = small_papers(5)
    units = spark.createDataFrame(rows, UNITS)
    top = match.top_matches(units)
    links = match.mutual_links(top)
    count = lambda df: Counter(r.granularity for r in df.select("granularity").collect())
    want = [count(top), count(links), count(links.filter("score >= 0.1"))]
    got = match.link_counts(units).collect()
    assert [{r.granularity: r[c] for r in got} for c in ("candidates", "links", "kept_links")] == want and len(got) == 2
    assert match.link_counts(units.unionByName(units.limit(1))) is None  # a unit that repeats


def test_papers_of_one_component_need_not_meet(spark, monkeypatch):
    """All papers met for groups, also those that were joined already."""
    rows = small_papers(6)
    units = spark.createDataFrame(rows, UNITS)
    want = Counter(map(tuple, match.threshold_groups(units, threshold=0.3).collect()))
    monkeypatch.setattr(blocks, "BLOCK", 16)
    monkeypatch.setattr(match, "ANCHORED", 1)
    written = []
    monkeypatch.setattr(match, "materialize", lambda df, name, f=materialize: written.append(name) or f(df, name))
    assert Counter(map(tuple, match.threshold_groups(units, threshold=0.3).collect())) == want and want
    assert "group-rest" in written


def test_two_papers_meet_once_for_their_best(spark, monkeypatch):
    """Each two parts met twice, and half of what they gave was dropped."""
    mirrored = []
    monkeypatch.setattr(match.blocks, "meet", lambda *a, f=blocks.meet, **k: mirrored.append(k.get("mirrored")) or f(*a, **k))
    rows = small_papers(7)
    found = match.match_units(spark.createDataFrame(rows, UNITS)).collect()
    assert mirrored == [True] and len(found) == len(set(found)) and all(r.paper < r.dst_paper for r in found)
