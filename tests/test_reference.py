"""Small hand-made cases for the reference's operators."""

import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from lumenforge.functions import text as T
from lumenforge.operators import align, assign, match, reading_order
from lumenforge.operators.components import connected_components
from lumenforge.sources import documents


def test_tokens_and_similarity(spark):
    rows = [("été Foo foo", "foo bar"), ("", ""), ("abcabc", "abc"), ("x" * 50, "y" * 250)]
    got = spark.createDataFrame(rows, "a string, b string").select(T.tokens(F.col("a")).alias("t"), T.text_similarity(F.col("a"), F.col("b")).alias("s"), T.ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert got[0].t == ["t", "foo"]
    assert got[1].s == 0.5
    assert [g.r for g in got] == [SequenceMatcher(None, a.lower(), b.lower()).ratio() for a, b in rows]


def test_rounding_is_that_of_python(spark):
    values = [0.0875, 0.4496, 0.5, 2.5]
    got = [r.y for r in spark.createDataFrame([(v,) for v in values], "x double").select(T.py_round(F.col("x"), 3).alias("y")).collect()]
    assert got == [round(v, 3) for v in values]


def test_markers(spark):
    text = "Intro words  1 ÉTÉ start middle\nMethods and more"
    row = spark.createDataFrame([(text, ["4. été  START", "nothing here", "methods"])], "t string, m array<string>").select(T.slice_by_markers(F.col("t"), F.col("m")).alias("s")).collect()[0]
    assert row.s == ["ÉTÉ start middle", None, "Methods and more"]


def test_top_matches_ties_and_mutual(spark):
    rows = [("g", 1, 1, "red fox"), ("g", 2, 1, "red fox"), ("g", 2, 2, "red fox"), ("g", 2, 3, "red fox"), ("g", 2, 4, "red fox"), ("g", 3, 1, "blue")]
    units = spark.createDataFrame(rows, "granularity string, paper int, unit int, tag string")
    top = match.top_matches(units)
    assert [(r.dst_unit, r.rk) for r in top.filter("paper = 1 and dst_paper = 2").orderBy("rk").collect()] == [(1, 1), (2, 2), (3, 3)]
    links = match.mutual_links(top).filter("score > 0")
    assert {(r.paper, r.unit, r.dst_paper, r.dst_unit) for r in links.collect()} == {(1, 1, 2, 1), (1, 1, 2, 2), (1, 1, 2, 3)}
    members = match.groups(links).collect()
    assert {(m.group_no, m["size"], m.paper, m.unit) for m in members} == {(1, 4, 1, 1), (1, 4, 2, 1), (1, 4, 2, 2), (1, 4, 2, 3)}


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (7, 7), (None, 4)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10} | {i: 100 for i in range(100, 141)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_reassignment_counts_new_groups(spark):
    schema = "paper int, unit int, group_id int"
    before, after = spark.createDataFrame([(1, 1, 5), (1, 2, None), (1, 3, 7)], schema), spark.createDataFrame([(1, 1, 5), (1, 2, 5), (1, 3, None)], schema)
    assert tuple(assign.reassigned(before, after).collect()[0]) == (1, 2)


def test_ranking_problem(spark):
    rows = [(["a", "b"], ["b", "a"]), (["a", "a"], ["a", "b"]), (["a"], ["a", "b"]), (["a", "x"], ["a", "b"]), ([], ["a"])]
    got = [r.p for r in spark.createDataFrame(rows, "r array<string>, e array<string>").select(assign.ranking_problem("r", "e").alias("p")).collect()]
    assert got == [None, "duplicate ids", "missing/extra ids", "missing/extra ids", "missing/extra ids"]


def test_reading_order(spark):
    words = [("d", 1, 600.0, 0, 10.0, 100.0, 0.0, "left"), ("d", 1, 600.0, 1, 350.0, 450.0, 0.5, "right"), ("d", 1, 600.0, 2, 10.0, 100.0, 12.0, "below"), ("d", 1, 600.0, 3, 104.0, 200.0, 12.0, "it")]
    got = reading_order.lines(spark.createDataFrame(words, "doc string, page int, page_width double, word_ord int, x0 double, x1 double, top double, text string")).orderBy("line_no").collect()
    assert [r.text for r in got] == ["left", "below it", "right"]


def test_offsets_count_characters(spark):
    text = "\U0001F600\U0001F600 Methods here \U0001F600 Results and"
    row = spark.createDataFrame([(text, ["Methods here", "2. Results"])], "t string, m array<string>").select(T.find_marker(F.col("t"), F.lit("Methods here"), F.lit(0)).alias("at"), T.find_marker(F.col("t"), F.lit("results"), F.lit(5)).alias("later"), T.slice_by_markers(F.col("t"), F.col("m")).alias("s")).collect()[0]
    assert (row.at, row.later, row.s) == (3, text.index("Results"), ["Methods here \U0001F600", "Results and"])


def words_frame(spark, words):
    return spark.createDataFrame(words, "doc string, page int, page_width double, word_ord int, x0 double, x1 double, top double, text string")


def test_short_words_left_of_the_middle_keep_a_line_left(spark):
    words = [("d", 1, 600.0, 0, 290.0, 295.0, 0.0, "a"), ("d", 1, 600.0, 1, 296.0, 340.0, 0.0, "b"), ("d", 1, 600.0, 2, 10.0, 60.0, 12.0, "c"), ("d", 2, 600.0, 0, 350.0, 400.0, 0.0, "z")]
    assert [r.text for r in reading_order.lines(words_frame(spark, words)).filter("page = 1").orderBy("line_no").collect()] == ["a b", "c"]
    pages = spark.createDataFrame([("d", p) for p in (1, 2, 3, 4)] + [("e", 1)], "doc string, page int")
    got = {r.doc: r.text for r in reading_order.document_text(words_frame(spark, words), pages).collect()}
    assert got == {"d": "a b\nc\n\nz\n\n\n\n", "e": ""}
    assert {r.doc: r.text for r in reading_order.document_text(words_frame(spark, words), pages, 2).collect()}["d"] == "a b\nc\n\nz"


def test_orders_on_cycles_and_per_paper(spark):
    graphs = {
        "x": {"p1": ["p2"], "p2": ["p1"], "p3": ["p3"], "p4": ["e", "nowhere"], "p5": ["p4", "p1"], "p6": []},
        "y": {f"q{i:02d}": [f"q{i + 1:02d}"] for i in range(30)} | {"q30": ["q15"]},
        "z": {"e": ["p"], "p": ["e", "p9"], "p9": []},
    }

    def order(args, own, p, trail=(), seen=None):
        if p in seen:
            return seen[p]
        if p in trail:
            return 0
        seen[p] = max((0 if a in own else order(args, own, a, (*trail, p), seen) + 1 for a in args[p] if a in own or a in args), default=0)
        return seen[p]

    props = spark.createDataFrame([(g, p, "r", a) for g, args in graphs.items() for p, a in args.items()], "paper string, id string, predicate string, args array<string>")
    entities = spark.createDataFrame([("x", "e"), ("z", "e")], "paper string, id string")
    want = {}
    for g, args in graphs.items():
        seen, own = {}, {"e"} if g in "xz" else set()
        for p in sorted(args):
            order(args, own, p, (), seen)
        want |= {(g, p): n for p, n in seen.items()}
    got = {(r.paper, r.id): r["order"] for r in align.proposition_orders(props, entities).collect()}
    assert got == want and (got["x", "p1"], got["x", "p2"]) == (2, 1)
    papers = spark.createDataFrame([("x",), ("none",)], "paper string")
    rows = {r.paper: tuple(r)[1:] for r in align.systematicity(props, papers, entities).collect()}
    assert rows["none"] == (0, 0, 0.0) and rows["x"][0] == 6 and rows["x"][1] == max(n for (g, _), n in want.items() if g == "x")


def test_traces_of_small_graphs(spark):
    entities = [(1, "a1", "alpha", "x"), (1, "a2", "beta", "x"), (2, "b1", "alpha", "x"), (2, "b2", "beta", "x"), (3, "c1", "alone", "x")]
    props = [(1, "p1", "uses", ["a1", "a2"]), (1, "p2", "uses", ["a2", "a1"]), (1, "p3", "odd", ["a1"]), (1, "p4", "on", ["p3"]), (1, "p5", "on", ["p4"]), (2, "q1", "Uses", ["b1", "b2"]), (2, "q3", "odd", ["zz"]), (2, "q4", "on", ["q3"]), (2, "q5", "on", ["q4"])]
    e, p = spark.createDataFrame(entities, "paper int, id string, name string, kind string"), spark.createDataFrame(props, "paper int, id string, predicate string, args array<string>")
    found = align.Alignment(e, p)
    rows = {(r.paper_a, r.paper_b): r for r in found.summary().collect()}
    assert set(rows) == {(1, 2), (1, 3), (2, 3)} and rows[1, 3].kernels_considered == 0 and rows[1, 3].systematicity_score == 0.0 and rows[1, 3].classification == "analogy"
    assert (rows[1, 2].kernels_considered, rows[1, 2].kernels_accepted) == (2, 1)
    trace = {(r.paper_a, r.paper_b): r for r in found.trace().collect()}
    t = trace[1, 2]
    removed = [{(x.a, x.b): x.reason for x in step.removed} for step in t.connectivity_passes]
    pass_one = removed[0]
    assert pass_one[("p3", "q3")] == "argument 0: one side is an entity, the other a proposition"
    assert pass_one[("p4", "q5")].startswith("argument 0: sub-proposition p3/q4 ") and removed[1][("p4", "q4")].startswith("argument 0: sub-proposition p3/q3 ")
    assert removed[2] == {("p5", "q5"): "argument 0: sub-proposition p4/q4 didn't survive an earlier pass"}
    left = len(t.candidates)
    for step in t.connectivity_passes:
        left -= len(step.removed)
        assert step.surviving_count == left
    assert [(x.a, x.b) for x in t.surviving] == [("p1", "q1"), ("p2", "q1")] and t.candidates == sorted(t.candidates)
    assert [m.decision for m in t.merge_steps] == ["accepted", "rejected"] and t.steps == 1 + 3 + 1 + 2 + 1
    c = t.merge_steps[1].conflict
    assert (c.id, c.side, c.existing_partner, c.wanted_partner) == ("a1", "a", "b1", "b2")
    assert trace[2, 3].steps == 3 and trace[2, 3].merge_steps == []
    events = found.events().filter("paper_a = 1 and paper_b = 2").orderBy("ordinal").collect()
    assert [e.ordinal for e in events] == list(range(1, len(events) + 1)) and [e.step for e in events] == sorted(e.step for e in events)
    of = lambda kind: [(e.a, e.b) for e in events if e.kind == kind]
    assert of("candidate") == [(x.a, x.b) for x in t.candidates] and of("survivor") == [(x.a, x.b) for x in t.surviving]
    assert [(e.step - 1, e.a, e.b, e.detail) for e in events if e.kind == "removed"] == [(s["pass"], x.a, x.b, x.reason) for s in t.connectivity_passes for x in s.removed]
    assert [(e.kind, e.a, e.b, e.step) for e in events[-2:]] == [(m.decision, m.root_a, m.root_b, 6 + n) for n, m in enumerate(t.merge_steps)]
    assert events[-1].detail == "a a1: is b1, wanted b2"
    links = found.correspondences().orderBy("kind", "place").collect()
    assert [(r.kind, r.a, r.b) for r in links] == [("entity", "a1", "b1"), ("entity", "a2", "b2"), ("prop", "p1", "q1")]
    assert links[0].name_similarity == 1.2 and links[2].order_a == 0


def test_alignment_of_small_graphs(spark):
    entities = [(1, "a1", "alpha", "x"), (1, "a2", "beta", "x"), (2, "b1", "alpha", "x"), (2, "b2", "gamma", "y")]
    props = [(1, "p1", "Uses", ["a1", "a2"]), (1, "p2", "causes", ["p1"]), (1, "p3", "odd", ["zz"]), (2, "q1", "uses", ["b1", "b2"]), (2, "q2", "causes", ["q1"]), (2, "q3", "odd", ["b1"])]
    e, p = spark.createDataFrame(entities, "paper int, id string, name string, kind string"), spark.createDataFrame(props, "paper int, id string, predicate string, args array<string>")
    ents = align.entity_candidates(e)
    alive, passes = align.arc_consistency(ents, align.proposition_candidates(p))
    assert {(r.a, r.b) for r in alive.collect()} == {("p1", "q1"), ("p2", "q2")}
    assert [(r["pass"], r.a) for r in passes.collect()] == [(1, "p3")]
    assert {(r.paper, r.id): r["order"] for r in align.proposition_orders(p).collect()}[(1, "p2")] == 1
    row = align.alignment(e, p).collect()[0]
    assert (row.kernels_considered, row.kernels_accepted, row.propositions, row.entities) == (2, 2, 2, 2)


def test_papers_roundtrip(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"paper_id": "b", "title": "B", "sections": [{"id": "s1", "tag": "t"}]}')
    (tmp_path / "a.json").write_text('{"paper_id": "a", "title": "A", "sections": [], "paragraphs": [{"id": "pa1", "tag": "u", "text": "x"}]}')
    papers = documents.read_papers(spark, str(tmp_path / "*.json"))
    order = documents.manifest(papers)
    assert [r.paper_id for r in order.orderBy("paper_ord").collect()] == ["a", "b"]
    assert {(r.granularity, r.paper_id, r.unit_id, r.title) for r in documents.units(papers, order).collect()} == {("sections", "b", "s1", ""), ("paragraphs", "a", "pa1", "")}


def unit_frame(spark, rows):
    return spark.createDataFrame(rows, "granularity string, paper string, unit int, tag string, prev_relation string, next_relation string, text string")


def random_units(seed, n=60):
    import random

    rng = random.Random(seed)
    words = "model data graph label noise recall search depth users study paper result method".split()
    pick = lambda k: " ".join(rng.choices(words, k=k))
    return [(rng.choice(["sections", "paragraphs"]), f"p{rng.randint(1, 6)}", i, rng.choice([pick(2), " " + pick(1).upper(), "", None]), rng.choice(["why", "Why ", "", None]), rng.choice(["next", ""]), rng.choice([pick(rng.randint(0, 9)), None])) for i in range(n)]


def test_mutual_best_matches_against_all_pairs(spark, monkeypatch):
    from lumenforge.operators import blocks

    monkeypatch.setattr(match.blocks, "BLOCK", 8)
    rows = random_units(3)
    words = lambda t: {w for w in re.findall("[a-z0-9]+", (t or "").lower()) if len(w) > 2 and w not in T.STOPWORDS}
    tags = lambda t: set(re.findall("[a-z0-9]+", (t or "").lower()))
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0

    def score(a, b):
        x, y = a[3] or "", b[3] or ""
        if a[0] == "sections":
            entity = 0.5 * share(tags(x), tags(y)) + 0.5 * SequenceMatcher(None, x.lower(), y.lower()).ratio()
        else:
            entity = sum(bool(u and v and u.strip().lower() == v.strip().lower()) for u, v in zip(a[3:6], b[3:6])) / 3
        return 0.5 * entity + 0.5 * share(words(a[6]), words(b[6])), entity, share(words(a[6]), words(b[6]))

    want = {}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1]:
                best = max(score(a, z)[0] for z in rows if z[0] == a[0] and z[1] == b[1])
                back = max(score(b, z)[0] for z in rows if z[0] == a[0] and z[1] == a[1])
                if score(a, b)[0] == best and score(b, a)[0] == back:
                    want[(a[1], a[2], b[1], b[2])] = (a[0], score(a, b))
    units = unit_frame(spark, rows)
    got = {tuple(r)[1:5]: r for r in match.match_units(units).collect()}
    assert set(got) == {k for k, (g, _) in want.items() if g == "paragraphs"}
    assert all(got[k].similarity == s[0] for k, (g, s) in want.items() if g == "paragraphs")
    sections = {tuple(r)[:4]: tuple(r)[4:] for r in match.match_sections(units).collect()}
    assert sections == {k: tuple(round(x, 3) for x in s) for k, (g, s) in want.items() if g == "sections"}
    reverse = {tuple(r)[1:5] for r in match.match_units(units, ["p4", "p2"]).collect()}
    assert reverse == {(c, d, a, b) for (a, b, c, d) in got if (a, c) == ("p2", "p4")}
    assert match.match_units(units.limit(0)).count() == 0 and blocks.BLOCK == 8


def test_top_matches_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(match.blocks, "BLOCK", 8)
    rows = random_units(4, 90)
    words = lambda t: set(re.findall("[a-z0-9]+", (t or "").lower()))
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    want = set()
    for a in rows:
        for paper in {r[1] for r in rows} - {a[1]}:
            others = sorted((r for r in rows if r[0] == a[0] and r[1] == paper), key=lambda r: (-share(words(a[3]), words(r[3])), r[2]))
            want |= {(a[0], a[1], a[2], paper, r[2], share(words(a[3]), words(r[3])), n) for n, r in enumerate(others[:3], 1)}
    got = match.top_matches(unit_frame(spark, rows)).collect()
    assert {(r.granularity, r.paper, r.unit, r.dst_paper, r.dst_unit, r.score, r.rk) for r in got} == want and len(got) == len(want)
    assert match.top_matches(unit_frame(spark, [])).count() == 0


def test_match_table_keeps_units_without_matches(spark):
    rows = [("sections", "b", 1, "why now", "", "", ""), ("sections", "a", 1, "why", "", "", ""), ("sections", "a", 2, "why now?", "", "", ""), ("paragraphs", "a", 3, "lone", "", "", "")]
    units = unit_frame(spark, rows)
    order = spark.createDataFrame([("b", 0), ("a", 1)], "paper string, paper_ord int")
    table = {(r.paper, r.unit): r for r in match.match_table(units, match.similarity_matches(units), order).collect()}
    assert table["a", 3].matches == [] and [(m.paper, m.unit) for m in table["b", 1].matches] == [("a", 2), ("a", 1)]
    ratio = lambda x, y: SequenceMatcher(None, x, y).ratio()
    assert [m.similarity for m in table["b", 1].matches] == [round(0.5 + 0.5 * ratio("why now", "why now?"), 3), round(0.25 + 0.5 * ratio("why now", "why"), 3)]


def test_text_is_attached_and_cut_to_paragraphs(spark):
    from lumenforge.operators import paragraphs

    raw = spark.createDataFrame([("a", "x 1. Intro text\n\nmore text 2 Methods\nbody here"), ("b", None)], "paper string, text string")
    sections = spark.createDataFrame([("a", 0, "s1", "1 INTRO", "why", "old"), ("a", 1, "s2", "not there", "what", ""), ("a", 2, "s3", "Methods", "how", ""), ("b", 0, "s1", "t", "u", ""), ("c", 0, "s1", None, "v", "")], "paper string, position int, section_id string, title string, tag string, text string")
    got = paragraphs.attach_text(sections, raw)
    rows = {(r.paper, r.position): r for r in got.collect()}
    assert [rows["a", i].text for i in range(3)] == ["Intro text\n\nmore text 2", paragraphs.MISSING, "Methods\nbody here"]
    assert rows["b", 0].is_missing and rows["c", 0].text == paragraphs.MISSING
    assert {r.paper: r.missing for r in paragraphs.missing_titles(got).collect()} == {"a": ["not there"], "b": ["t"], "c": [None]}
    cut = paragraphs.build_paragraphs(paragraphs.split_paragraphs(got.filter("paper = 'a'")))
    assert [(r.id, r.section_id, r.text) for r in cut.orderBy("position").collect()] == [("pa1", "s1", "Intro text"), ("pa2", "s1", "more text 2"), ("pa3", "s2", paragraphs.MISSING), ("pa4", "s3", "Methods\nbody here")]
    answer = "array<struct<tag:string,start_text:string,prev_relation:string,next_relation:string>>"
    long = spark.createDataFrame([("a", 0, "s1", "t", "y" * 25_001, [("x", "yy", None, None)]), ("a", 1, "s2", "u", "short", None), ("a", 2, "s3", "v", "one two", [("k", "two", None, "n"), ("l", "gone", "p", "")])], f"paper string, position int, section_id string, tag string, text string, paragraphs {answer}")
    built = paragraphs.build_paragraphs(long).orderBy("position").collect()
    assert [(r.id, r.tag, r.text, r.prev_relation, r.next_relation) for r in built] == [("pa1", "t", "y" * 25_001, "", ""), ("pa2", "u", "short", "", ""), ("pa3", "k", "two", "", "n"), ("pa4", "l", "gone", "p", "")]


def test_offline_extraction(spark):
    from lumenforge.operators import paragraphs

    raw = spark.createDataFrame([("a", "Title\n1 Intro\nAlice visits Berlin. Then nothing.\n2.1 Methods used\nBob\nRELATED WORK\nend"), ("b", "no heading"), ("c", None)], "paper string, text string")
    got = {r.paper: r.t for r in paragraphs.split_sections(raw).groupBy("paper").agg(F.sort_array(F.collect_list(F.struct("position", "section_id", "title", "tag"))).alias("t")).collect()}
    assert [(x.section_id, x.title, x.tag) for x in got["a"]] == [("s1", "1 Intro", "Intro"), ("s2", "2.1 Methods used", "Methods used"), ("s3", "RELATED WORK", "RELATED WORK")]
    assert [x.title for x in got["b"]] == ["b"] and [x.title for x in got["c"]] == ["c"]
    entities, props = paragraphs.sentence_graph(raw)
    assert {(r.paper, r.id) for r in entities.collect()} >= {("a", "e-alice"), ("a", "e-berlin")}
    assert [(r.predicate, r.args) for r in props.filter("evidence like '%Berlin%'").collect()] == [("visits", ["e-title", "e-intro"])]
    assert paragraphs.sentence_graph(raw.limit(0))[1].count() == 0


def test_listings_and_group_order(spark):
    units = spark.createDataFrame([("p1", 1, "why", "a\nb ", 0, "s1"), ("p1", 2, "how", None, 1, "s9"), ("p2", 1, None, "c", 2, "s1")], "paper string, unit int, tag string, text string, position int, section_id string")
    given = spark.createDataFrame([("p1", 1, "g2"), ("p1", 2, "g10"), ("p2", 1, "g10"), ("p2", 9, None)], "paper string, unit int, group_id string")
    sections = spark.createDataFrame([("p1", "s1", "intro?"), ("p2", "s1", "")], "paper string, section_id string, tag string")
    assert [(r.place, r.group_id, [(m.paper, m.unit) for m in r.members]) for r in assign.group_members(given, units).orderBy("place").collect()] == [(1, "g10", [("p1", 2), ("p2", 1)]), (2, "g2", [("p1", 1)])]
    listing = {r.group_id: r.listing for r in assign.member_listings(given, units, sections).collect()}
    assert listing == {"g2": '1. Paragraph question: "why"\n   Parent section question: "intro?"\n   Paragraph content: "a b"', "g10": '1. Paragraph question: "how"\n   Paragraph content: ""\n2. Paragraph question: ""\n   Paragraph content: "c"'}
    assert {r.paper: r.listing for r in assign.unit_listings(units).collect()}["p1"] == '- 1: "why" -- "a b"\n- 2: "how" -- ""'
    questions = spark.createDataFrame([("g2", 1, "b?"), ("g1", 0, "a?")], "group_id string, position int, question string")
    assert assign.question_listing(questions).collect()[0].listing == '- g1: "a?"\n- g2: "b?"'
    import pytest

    assert assign.require_questions(questions) is questions
    for bad in (questions.limit(0), questions.unionByName(spark.createDataFrame([("g3", 2, "")], questions.schema))):
        with pytest.raises(ValueError):
            assign.require_questions(bad)


def test_responses_and_keys(spark):
    rows = [('{"wrap": {"ranking": ["a", 3, "b", null]}}',), ('{"ranking": ["c"]}',), ('{"x": 1, "y": 2}',)]
    frame = spark.createDataFrame(rows, "r string").select(T.unwrap(F.col("r"), ["ranking"]).alias("r"))
    got = [r.r for r in frame.collect()]
    assert got[0] == '{"ranking":["a",3,"b",null]}' and got[1:] == [rows[1][0], rows[2][0]]
    ranking = frame.select(T.ranking_in_domain(F.get_json_object("r", "$.ranking")).alias("x")).collect()
    assert [r.x for r in ranking] == [["a", "b"], ["c"], None]
    keys = spark.createDataFrame([("a:b", "u1", ["u1"]), ("c", "u2", ["u1"])], "p string, u string, d array<string>").select(T.composite_key(F.col("p"), F.col("u")).alias("k"), T.in_domain(F.col("u"), F.col("d")).alias("v"))
    back = keys.select("k", "v", *[c.alias(n) for c, n in zip(T.split_key(F.col("k")), ("p", "u"))]).collect()
    assert [tuple(r) for r in back] == [("a:b:u1", "u1", "a:b", "u1"), ("c:u2", None, "c", "u2")]


def test_balance_counts_papers_without_ranking(spark):
    members = spark.createDataFrame([("g1", "a", 1), ("g1", "b", 2), ("g2", "c", 1)], "group_id string, paper string, unit int")
    ranks = spark.createDataFrame([("g1", "a", 1, 1), ("g1", "b", 1, 1), ("g1", "b", 2, 2), ("g2", "c", 1, 1)], "group_id string, paper string, unit int, rank int")
    papers = spark.createDataFrame([("a",), ("b",), ("c",)], "paper string")
    questions = spark.createDataFrame([("g2", 1, "q2"), ("g1", 0, "q1")], "group_id string, position int, question string")
    got = assign.balance_table(members, ranks, papers, questions).orderBy("place").collect()
    assert [(r.group_id, r.group_balance, r.member_count, r.overarching_question) for r in got] == [("g1", 33.3, 2, "q1"), ("g2", 33.3, 1, "q2")]
    assert {r.balance for r in assign.balance(members, ranks, papers.limit(0)).collect()} == {0.0}


def test_refinement_with_string_ids_resumes(spark, tmp_path, monkeypatch):
    units = spark.createDataFrame([("p1", "pa1", "alpha beta", "alpha beta"), ("p1", "pa2", "gamma", "gamma delta"), ("p2", "pa1", "alpha", "alpha"), ("p2", "pa2", None, None)], "paper string, unit string, tag string, text string")
    questions = spark.createDataFrame([("group_1", "alpha?"), ("group_2", "gamma?"), ("group_3", "omega?")], "group_id string, question string")
    out = assign.refine(units, questions, 2, folder=str(tmp_path / "run"))
    rows = {(r.iter, r.paper, r.unit): r.group_id for r in out.collect()}
    assert [rows[n, p, u] for n in (1, 2) for p, u in (("p1", "pa1"), ("p1", "pa2"), ("p2", "pa1"), ("p2", "pa2"))] == ["group_1", "group_2", "group_1", None] * 2
    monkeypatch.setattr(assign, "best_questions", None)
    again = assign.refine(units, questions, 2, folder=str(tmp_path / "run"))
    assert {(r.iter, r.paper, r.unit): r.group_id for r in again.collect()} == rows
    before = spark.createDataFrame([("p1", "pa1", "group_1")], "paper string, unit string, group_id string")
    assert {r.iter: (r.reassigned, r.total_assigned) for r in assign.refinement_counts(again, before).collect()} == {1: (2, 3), 2: (0, 3)}


def test_cache_learns_and_keeps_to_its_inputs(spark, tmp_path):
    from lumenforge.sources import stages

    calls = []

    def compute(misses):
        calls.append(sorted(r.k for r in misses.collect()))
        return misses.select("k", F.upper("text").alias("answer"))

    frame = lambda rows: spark.createDataFrame(rows, "k string, text string")
    path = str(tmp_path / "cache")
    for rows, asked in (([("a", "x"), ("b", "y"), ("a", "x")], ["a", "b"]), ([("a", "x"), ("c", "z")], ["c"]), ([("a", "changed")], ["a"]), ([("b", "y")], None)):
        got = {r.k: r.answer for r in stages.cached(frame(rows), path, ["k"], ["text"], compute).collect()}
        assert got == {k: t.upper() for k, t in rows}
        assert (calls.pop() if calls else None) == asked
    assert stages.cached(frame([]), str(tmp_path / "none"), ["k"], ["text"], compute).count() == 0


def test_sinks_inputs_and_subsets(spark, tmp_path):
    import json

    from lumenforge.sources import stages

    folder = tmp_path / "papers"
    folder.mkdir()
    for name, body in (("b", {"paper_id": "b", "title": "B", "sections": [{"id": "s1", "tag": "t"}]}), ("a", {"paper_id": "a", "title": "A", "sections": [], "paragraphs": []})):
        (folder / f"{name}.json").write_text(json.dumps(body))
    (folder / "manifest.json").write_text('[{"paper_id": "a", "title": "A", "file": "a.json"}]')
    papers = documents.read_papers(spark, str(folder / "*.json"))
    assert {r.paper_id for r in papers.collect()} == {"a", "b"} and documents.units(papers, documents.manifest(papers)).count() == 1
    picked = documents.subset(documents.manifest(papers), ["b", "a"]).orderBy("paper_ord").collect()
    assert [r.paper_id for r in picked] == ["b", "a"]
    import pytest

    with pytest.raises(ValueError):
        documents.subset(papers, ["a", "zz"])
    stages.write_papers(papers, str(tmp_path / "out"))
    again = spark.read.text(str(tmp_path / "out"), wholetext=True).collect()
    assert {json.loads(r.value)["title"] for r in again} == {"A", "B"}
    (tmp_path / "one.pdf").write_bytes(b"%PDF")
    files, missing = documents.input_files(spark, [str(tmp_path / "one.pdf"), str(tmp_path / "two.pdf")])
    assert [r.paper_id for r in files.collect()] == ["one"] and missing == [str(tmp_path / "two.pdf")]
    rows, observation = stages.observed(spark.range(5), "seen", even=F.count_if(F.col("id") % 2 == 0))
    stages.write_json(rows, str(tmp_path / "json"), ["id"])
    assert observation.get == {"rows": 5, "even": 3}
    calls = spark.createDataFrame([("a", 5, None, 1, 2), ("b", 0, 7, 1, 2), ("c", None, 0, 1, 2)], "label string, created int, read int, input int, output int")
    assert [(r.label, r.status) for r in stages.usage(calls).orderBy("label").collect()] == [("a", "wrote cache"), ("b", "read from cache")]
    ranks = spark.createDataFrame([("g", "p", 1, 2), ("g", "p", 2, 1), ("g", "q", 5, 1)], "group_id string, paper string, unit int, rank int")
    two = stages.matrix_two(assign.rankings(ranks, ["group_id", "paper"], "unit")).collect()
    assert [(r.group_id, r.papers) for r in two] == [("g", {"p": [2, 1], "q": [5]})]


def test_replacing_units_of_papers(spark):
    from lumenforge.operators import paragraphs

    papers = spark.createDataFrame([("a", "A", None, None), ("b", "B", None, None)], documents.PAPER)
    units = spark.createDataFrame([("a", 2, "pa2", "t2"), ("a", 1, "pa1", "t1")], "paper_id string, position int, id string, tag string")
    got = {r.paper_id: [(u.id, u.tag, u.text) for u in r.paragraphs] for r in paragraphs.replace_units(papers, units, "paragraphs").collect()}
    assert got == {"a": [("pa1", "t1", ""), ("pa2", "t2", "")], "b": []}


def test_join_of_rows_with_large_groups(spark):
    from lumenforge.plans.skew import join_groups

    rows = spark.createDataFrame([("hot", i) for i in range(3000)] + [(f"k{i}", i) for i in range(2000)] + [("lost", 1)], "k string, v int")
    groups = rows.filter("k <> 'lost'").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert join_groups(rows, groups, ["k"], "n", 5001).count() == 5000
    left = join_groups(rows, groups, ["k"], "n", 5001, "left")
    assert left.count() == 5001 and [r.k for r in left.filter("n is null").collect()] == ["lost"]
    assert join_groups(rows, groups, ["k"], "n", 5001, "left_semi").columns == ["k", "v"]


def test_slot_classes_hold_all_pairs(spark):
    from collections import Counter
    from itertools import combinations

    slots = ("tag", "prev_relation", "next_relation")
    rows = [(1, 1, " Red fox", "", "user"), (1, 2, "blue", "User ", None), (2, 1, "red FOX", "", "User"), (2, 2, "", "user", "bot"), (3, 1, "red hen", "user", "bot"), (3, 2, "blue", "bot", ""), (4, 1, None, None, None)]
    units = spark.createDataFrame(rows, "paper int, unit int, tag string, prev_relation string, next_relation string")
    clean = lambda x: (x or "").strip().lower()
    want = {(a[:2], b[:2]): n for a, b in combinations(rows, 2) if a[0] != b[0] and (n := sum(clean(x) == clean(y) != "" for x, y in zip(a[2:], b[2:])))}
    members = {}
    for r in match.slot_classes(units, slots).collect():
        members.setdefault((r.slot, r.value), []).append((r.paper, r.unit))
    got = Counter(pair for m in members.values() for pair in combinations(sorted(m), 2) if pair[0][0] != pair[1][0])
    assert dict(got) == want and set(want.values()) == {1, 2}


def test_slot_classes_query_against_all_pairs(spark):
    from collections import Counter
    from itertools import combinations

    from lumenforge.plans.queries import paragraph_slot_classes
    from lumenforge.sources.tables import conv_units

    path = "/root/testdata/sf0.001"
    rows = sorted((r.paper, r.unit, r.text, r.prev_relation, r.next_relation) for r in conv_units(spark, path).filter("paper < 12").collect())
    clean = lambda x: (x or "").strip().lower()
    want = {(a[:2], b[:2]): n for a, b in combinations(rows, 2) if a[0] != b[0] and (n := sum(clean(x) == clean(y) != "" for x, y in zip(a[2:], b[2:])))}
    members = {}
    for r in paragraph_slot_classes(spark, path).filter("paper < 12").collect():
        members.setdefault((r.slot, r.value), []).append((r.paper, r.unit))
    got = Counter(pair for m in members.values() for pair in combinations(sorted(m), 2) if pair[0][0] != pair[1][0])
    assert want and dict(got) == want


def test_super_groups_against_brute_force(spark):
    import random

    rng = random.Random(5)
    words = "how does the model learn from sparse noisy labels what limits recall in large graphs".split()
    questions = [" ".join(rng.choices(words, k=rng.randint(2, 7))) for _ in range(30)] + ["how does the model learn"] * 3 + [""]
    set_of = lambda t: set(re.findall("[a-z0-9]+", t.lower()))

    def similar(a, b):
        x, y = set_of(a), set_of(b)
        return 0.5 * (len(x & y) / len(x | y) if x | y else 0.0) + 0.5 * SequenceMatcher(None, a.lower(), b.lower()).ratio()

    top = {i: sorted(((similar(q, questions[j]), j) for j in range(len(questions)) if j != i), key=lambda z: -z[0])[:3] for i, q in enumerate(questions)}
    want_links = [(i, j, round(s, 3)) for i in top for s, j in top[i] if i < j and any(h == i for _, h in top[j])]
    # ids run against the positions, so that ties and directions show
    groups = spark.createDataFrame([(f"g{99 - i}", i, q) for i, q in enumerate(questions)], "group_id string, position int, question string")
    candidates = match.group_matches(groups)
    assert {(r.position, r.dst_position, r.rk) for r in candidates.collect()} == {(i, j, n) for i in top for n, (_, j) in enumerate(top[i], 1)}
    links = match.mutual_group_links(candidates)
    assert {(r.group_a, r.group_b, r.score) for r in links.collect()} == {(f"g{99 - i}", f"g{99 - j}", s) for i, j, s in want_links}
    sets = {i: {i} for i in range(len(questions))}
    kept = [x for x in want_links if x[2] >= 0.33]
    for i, j, _ in kept:
        if sets[i] is not sets[j]:
            sets[i] |= sets[j]
            for m in sets[j]:
                sets[m] = sets[i]
    ordered = []
    for i, _, _ in kept:
        if sets[i] not in ordered:
            ordered.append(sets[i])
    ordered.sort(key=lambda m: -len(m))
    got = match.super_groups(links).collect()
    assert {(r.super_group, r["size"], r.group_id) for r in got} == {(n, len(m), f"g{99 - i}") for n, m in enumerate(ordered, 1) for i in m}


def test_shared_folder_is_required_on_a_cluster(spark):
    from types import SimpleNamespace

    import pytest

    from lumenforge.plans import lineage

    def session(master, folder):
        return SimpleNamespace(conf={"spark.checkpoint.dir": folder} if folder else {}, sparkContext=SimpleNamespace(master=master))

    assert lineage.shared_dir(session("spark://host:7077", "hdfs://shared/")) == "hdfs://shared"
    assert lineage.shared_dir(session("local[4]", None)).startswith("/tmp/")
    with pytest.raises(ValueError):
        lineage.shared_dir(session("spark://host:7077", None))
    table = lineage.materialize(spark.range(3), "t")
    lineage.discard(table, None, spark.range(1))
    assert table._shared_path not in lineage._written
    from lumenforge.sources import stages

    assert not stages.exists(spark, table._shared_path)
