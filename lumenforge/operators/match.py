"""Cross-paper matching: scored pairs, top-k per other paper, mutual matches, groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenforge.functions import text as T
from lumenforge.operators import blocks, setjoin, similarity
from lumenforge.operators.components import connected_components, stars
from lumenforge.plans.lineage import materialize
from lumenforge.plans.prefix import numbered
from lumenforge.plans.skew import join_groups

SIDE = 12  # units of a paper that are ranked by comparing each two of them
PIECE = 200_000  # rows that leave a block together
ANCHORED = 8  # parts of a granularity from which on groups are found by anchors
TOGETHER = 64  # parts of units with the numbers of their words, some 300 KB each, that are shipped together


def _best_places(score: np.ndarray, paper: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and rank of the ``k`` best columns of each row within each paper; ties go to the earlier column. ``paper`` ascends."""
    if len(paper) and np.bincount(paper).max() <= SIDE:
        rank = _paper_ranks(score, paper)
        row, column = np.nonzero(rank <= k)
        return row, column, rank[row, column].astype(np.int64)
    order = np.argsort(-score, axis=1, kind="stable")
    order = np.take_along_axis(order, np.argsort(paper[order], axis=1, kind="stable"), axis=1)
    first = np.searchsorted(paper, paper)
    rank = np.broadcast_to(np.arange(len(paper)) - first, order.shape)
    row, place = np.nonzero(rank < k)
    return row, order[row, place], rank[row, place] + 1


def _paper_ranks(score: np.ndarray, paper: np.ndarray) -> np.ndarray:
    """Each column's rank among the columns of its paper, in every row; each two columns of a paper are compared once, ties go to the earlier."""
    rank = np.ones(score.shape, np.int16)
    for step in range(1, len(paper)):
        column = np.flatnonzero(paper[step:] == paper[:-step])
        if not len(column):
            break
        later = score[:, column + step] > score[:, column]
        rank[:, column] += later
        rank[:, column + step] += ~later
    return rank


def top_matches(units: DataFrame, k: int = 3) -> DataFrame:
    """``granularity, paper, unit, dst_paper, dst_unit, shared, total, score, rk``: of every other paper the ``k`` units most like it.

    Score is the Jaccard similarity of tag tokens, ties go to the earlier unit. What a paper offers to
    a tag depends on the tag alone, so distinct tags, each with up to 512 of its units, meet the first
    ``k`` units of each paper and tag, block by block (``blocks.meet``); the best of each paper
    are chosen inside a block and only they leave it. A paper that offers more than 512 units is dealt over several blocks, and what
    they chose for it meets again; so a task holds two parts of about 512 rows, whatever the papers.

    A null tag counts as empty; a tag without tokens scores 0 with all. Repeated rows are units of their
    own. An empty table, or a single paper, gives no rows.
    """
    kinds = dict(units.dtypes)
    units = units.select("granularity", "paper", "unit", F.coalesce("tag", F.lit("")).alias("tag"))
    tags = units.groupBy("granularity", "tag").agg(F.count(F.lit(1)).alias("n")).withColumn("tag_id", F.monotonically_increasing_id())
    tags = materialize(tags, "tags")
    rows = materialize(join_groups(units, tags, ["granularity", "tag"], "n", units.count()).select("granularity", "paper", "unit", "tag_id", "n"), "tag-units")
    words = materialize(blocks.number_words(tags.withColumn("w", T.tokens(F.col("tag"))), "tag_id", F.col("w")), "tag-words")
    left = rows.groupBy("granularity", "tag_id", F.pmod(F.xxhash64("paper", "unit"), F.ceil(F.col("n") / 512)).alias("chunk")).agg(F.collect_list(F.struct("paper", "unit")).alias("m"))
    left = left.select("granularity", "tag_id", "chunk", F.col("m.paper").alias("papers"), F.col("m.unit").alias("own"))
    # k units of a paper and tag are all that can be chosen
    first = F.row_number().over(Window.partitionBy("granularity", "paper", "tag_id").orderBy("unit"))
    offers = rows.withColumn("_n", first).filter(F.col("_n") <= k).select("granularity", F.col("paper").alias("dst_paper"), F.col("unit").alias("dst_unit"), "tag_id")
    names = ["granularity", "paper", "unit", "dst_paper", "dst_unit", "shared", "total", "score", "rk"]

    def solve(left: pa.Table, right: pa.Table):
        right = right.sort_by([("dst_paper", "ascending"), ("dst_unit", "ascending")])
        shared, a, b = blocks.shared_counts(left["words"], right["words"])
        total, score = blocks.jaccard(shared, a, b)
        paper = np.unique(right["dst_paper"].to_numpy(zero_copy_only=False), return_inverse=True)[1] if len(right) else np.zeros(0, int)
        row, at, rank = _best_places(score, paper, k)
        bounds, papers, own = _bounds(left["papers"]), _flat(left["papers"]), _flat(left["own"])
        many = np.diff(bounds)[row]
        target, unit, chunks = (right[c].combine_chunks() for c in ("dst_paper", "dst_unit", "chunks"))
        # what a block gives leaves it in pieces: a tag of many units has all their rows here
        cuts = np.searchsorted(np.cumsum(many), np.arange(PIECE, many.sum() + PIECE, PIECE), "left") + 1
        for low, high in zip([0, *cuts[:-1]], cuts):
            chosen = np.repeat(np.arange(low, min(high, len(row))), many[low:high])
            member = bounds[row][chosen] + np.arange(len(chosen)) - np.repeat(np.cumsum(many[low:high]) - many[low:high], many[low:high])
            i, j = row[chosen], at[chosen]
            out = pa.table(
                [pa.repeat(left["granularity"][0], len(member)), papers.take(pa.array(member)), own.take(pa.array(member)), target.take(pa.array(j)), unit.take(pa.array(j)),
                 pa.array(shared[i, j].astype(np.int32)), pa.array(total[i, j].astype(np.int32)), pa.array(score[i, j]), pa.array(rank[chosen].astype(np.int32)), chunks.take(pa.array(j))], [*names, "chunks"])
            yield out.filter(pc.not_equal(out["paper"], out["dst_paper"]))

    schema = f"granularity string, paper {kinds['paper']}, unit {kinds['unit']}, dst_paper {kinds['paper']}, dst_unit {kinds['unit']}, shared int, total int, score double, rk int"
    left = left.join(words, "tag_id")
    offers = join_groups(materialize(offers, "offers"), materialize(words.join(tags.select("tag_id", "n"), "tag_id"), "offer-words"), ["tag_id"], "n", rows.count()).drop("n")
    offers = blocks.with_chunks(materialize(offers, "match-right"), ["granularity", "dst_paper"], "dst_unit")
    met = blocks.meet(materialize(left, "match-left"), offers, ["granularity"], ["tag_id", "chunk"], ["dst_paper", "chunk"], solve, f"{schema}, chunks int")
    if offers.filter("chunks > 1").isEmpty():
        return met.drop("chunks")
    met = materialize(met, "match-chunks")
    again = F.row_number().over(Window.partitionBy("granularity", "paper", "unit", "dst_paper").orderBy(F.desc("score"), "dst_unit"))
    several = met.filter("chunks > 1").withColumn("rk", again).filter(F.col("rk") <= k)
    return met.filter("chunks = 1").unionByName(several).select(*names)


def _flat(column: pa.ChunkedArray) -> pa.Array:
    """The values of a list column, one after another."""
    chunks = [c.flatten() for c in column.chunks]
    return pa.concat_arrays(chunks) if chunks else pa.array([], column.type.value_type)


def _bounds(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy())])


def mutual_links(candidates: DataFrame) -> DataFrame:
    """Pairs that chose each other, in the direction of the earlier unit, with that direction's score.

    A null paper or unit has no link; a candidate that repeats is linked each time; an empty table gives no rows.
    """
    back = candidates.select("granularity", F.col("paper").alias("dst_paper"), F.col("unit").alias("dst_unit"), F.col("dst_paper").alias("paper"), F.col("dst_unit").alias("unit"))
    earlier = F.struct("paper", "unit") < F.struct("dst_paper", "dst_unit")
    return candidates.filter(earlier).join(back, ["granularity", "paper", "unit", "dst_paper", "dst_unit"])


def threshold_links(units: DataFrame, k: int = 3, threshold: float = 0.1) -> DataFrame:
    """``granularity, paper, unit, dst_paper, dst_unit, shared, total, score, rk``: ``mutual_links(top_matches(units, k))`` with a score of at least ``threshold`` (above 0).

    What ranks before a match that reaches the threshold reaches it as well, so ranks among such matches are ranks among all. Two papers decide about
    their links alone: those of up to ``blocks.BLOCK`` units stand whole in the parts of ``blocks.meet``, where links are chosen in both directions, so nothing
    but links leaves a task. Links of larger papers come from an index (``_index_links``).

    A null tag counts as empty; a unit without tokens, or a null paper or unit, has no link. Repeated rows are units of their own. An empty table, or a single paper, gives no rows.
    """
    rows = _link_rows(units)
    return _links_of(rows, _large_links(rows, k, threshold), k, threshold)


def threshold_groups(units: DataFrame, k: int = 3, threshold: float = 0.1) -> DataFrame:
    """``groups(threshold_links(units, k, threshold))``. Links leave a task as the fewest edges that join the same units, so they are never all written."""
    return _threshold_groups(_link_rows(units), k, threshold)[0]


def threshold_groups_and_links(units: DataFrame, k: int = 3, threshold: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """``groups_and_links(threshold_links(units, k, threshold))``. Links are chosen twice, for the groups and then beside their units' groups, so that none is written on the way."""
    rows = _link_rows(units)
    members, large = _threshold_groups(rows, k, threshold)
    of = members.select("granularity", "paper", "unit", "group_no")
    # a unit that repeats meets its one member
    named = materialize(rows.join(of, ["granularity", "paper", "unit"]), "link-rows")
    if large is not None:
        large = large.join(of, ["granularity", "paper", "unit"])
    return members, _links_of(named, large, k, threshold)


_LINK = ["granularity", "paper", "unit", "dst_paper", "dst_unit", "shared", "total", "score", "rk"]


def link_counts(units: DataFrame, k: int = 3, threshold: float = 0.1) -> DataFrame | None:
    """``granularity, candidates, links, kept_links``: how many rows ``top_matches``, ``mutual_links`` and its links of at least ``threshold`` have.

    Nothing but a row for each two parts leaves a task. None where a paper has more than ``blocks.BLOCK`` units or units repeat: those rows must be
    written to be counted. A null tag counts as empty; a null granularity, paper or unit is left out of the links, as it meets nothing.
    """
    ends = ["granularity", "paper", "unit"]
    rows = units.dropna(subset=ends).select(*ends, F.coalesce("tag", F.lit("")).alias("tag")).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "count-units")
    papers = units.dropna(subset=["granularity", "paper"]).groupBy("granularity", "paper").agg(F.count(F.lit(1)).alias("n"))
    papers = materialize(papers, "count-papers")
    if not papers.filter(F.col("n") > blocks.BLOCK).isEmpty() or rows.select(*ends).distinct().count() < rows.count():
        return None
    # a unit has k candidates of each other paper, or all its units
    offered = F.least(F.col("n"), F.lit(k))
    totals = papers.groupBy("granularity").agg((F.sum("n") * F.sum(offered) - F.sum(F.col("n") * offered)).alias("candidates"))
    words = materialize(blocks.number_words(rows.select("row", T.tokens(F.col("tag")).alias("w")), "row", F.col("w")), "count-words")
    rows = materialize(rows.drop("tag").join(words, "row").drop("row"), "count-rows")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = (t.sort_by([("paper", "ascending"), ("unit", "ascending")]) for t in (left, right))
        score = blocks.jaccard(*blocks.shared_counts(left["words"], right["words"]))[1]
        both = np.concatenate([t["paper"].to_numpy(zero_copy_only=False) for t in (left, right)])
        p, q = np.split(np.unique(both, return_inverse=True)[1], [len(left)])
        mutual = p[:, None] < q[None, :] if np.array_equal(p, q) else np.ones(score.shape, bool)
        for ranked, own in ((score, q), (score.T, p)):
            own = np.unique(own, return_inverse=True)[1]
            row, column, _ = _best_places(np.ascontiguousarray(ranked), own, k)
            chosen = np.zeros(ranked.shape, bool)
            chosen[row, column] = True
            mutual &= chosen if ranked is score else chosen.T
        counts = int(mutual.sum()), int((mutual & (score >= threshold)).sum())
        return pa.table([pa.array([left["granularity"][0].as_py()]), *(pa.array([c]) for c in counts)], ["granularity", "links", "kept_links"])

    met = blocks.meet(rows, rows, ["granularity"], ["paper"], ["paper"], solve, "granularity string, links long, kept_links long", mirrored=True, together=TOGETHER)
    met = met.groupBy("granularity").agg(F.sum("links").alias("links"), F.sum("kept_links").alias("kept_links"))
    return totals.join(met, "granularity", "left").na.fill(0)


def _link_rows(units: DataFrame) -> DataFrame:
    """``granularity, paper, unit, w, words, node, chunks`` of units with tokens: the tokens, their numbers, a number for each unit and in how many parts its paper stands."""
    ends = ["granularity", "paper", "unit"]
    rows = units.dropna(subset=ends).select(*ends, F.array_sort(T.tokens(F.coalesce("tag", F.lit("")))).alias("w")).filter(F.size("w") > 0)
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "link-units")
    words = materialize(blocks.number_words(rows.select("row", "w"), "row", F.col("w")), "link-words")
    nodes = materialize(rows.select(*ends).distinct().withColumn("node", F.monotonically_increasing_id()), "link-nodes")
    rows = materialize(rows.join(words, "row").join(nodes, ends), "link-rows")
    return blocks.with_chunks(rows, ["granularity", "paper"], "row").drop("row", "chunk")


def _ranks(group: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The rank of each pair in its group, from the best score down; ties keep their order."""
    order = np.lexsort((-score, group))
    ordered = group[order]
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order)) - np.searchsorted(ordered, ordered) + 1
    return out


def _mutual_pairs(left: pa.Table, right: pa.Table, k: int, threshold: float) -> tuple:
    """The units of two parts of whole papers, and of each link of theirs the places of the earlier and later unit, ``shared``, ``total``, ``score`` and ``rk``."""
    left, right = (t.sort_by([("paper", "ascending"), ("unit", "ascending")]) for t in (left, right))
    shared, a, b = blocks.shared_counts(left["words"], right["words"])
    total, score = blocks.jaccard(shared, a, b)
    both = pa.concat_tables([left, right])
    p, q = np.split(np.unique(both["paper"].to_numpy(zero_copy_only=False), return_inverse=True)[1], [len(left)])
    near = score >= threshold
    if len(p) and np.isin(p, q).any():
        # a part and itself, or papers among all: a paper doesn't meet itself, and of a part and itself each two meet once
        near &= p[:, None] < q[None, :] if np.array_equal(p, q) else p[:, None] != q[None, :]
    i, j = np.nonzero(near)
    raw, papers = score[i, j], len(left) + len(right)
    forth, back = _ranks(i * papers + q[j], raw), _ranks(j * papers + p[i], raw)
    keep = (forth <= k) & (back <= k)
    i, j, raw, forth, back = (x[keep] for x in (i, j, raw, forth, back))
    first = p[i] < q[j]
    ends = np.where(first, i, len(left) + j), np.where(first, len(left) + j, i)
    return both, *ends, shared[i, j].astype(np.int32), total[i, j].astype(np.int32), raw, np.where(first, forth, back).astype(np.int32)


def _links_of(rows: DataFrame, large: DataFrame | None, k: int, threshold: float) -> DataFrame:
    """The links of ``rows``, which have the earlier unit's ``group_no`` if ``rows`` do; ``large`` are those of papers in several parts."""
    kinds = dict(rows.dtypes)
    names = _LINK + ["group_no"] * ("group_no" in kinds)

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        both, a, b, *scores = _mutual_pairs(left, right, k, threshold)
        take = lambda c, at: both[c].combine_chunks().take(pa.array(at))
        columns = [take("granularity", a), take("paper", a), take("unit", a), take("paper", b), take("unit", b), *map(pa.array, scores)]
        return pa.table(columns + [take(c, a) for c in names[len(_LINK) :]], names)

    types = [kinds["granularity"], *[kinds[c] for c in ("paper", "unit")] * 2, "int", "int", "double", "int", *[kinds[c] for c in names[len(_LINK) :]]]
    whole = rows.filter("chunks = 1").select("granularity", "paper", "unit", "words", *names[len(_LINK) :])
    out = blocks.meet(whole, whole, ["granularity"], ["paper"], ["paper"], solve, ", ".join(f"{n} {t}" for n, t in zip(names, types)), mirrored=True, together=TOGETHER)
    return out if large is None else out.unionByName(large.select(*names))


def _threshold_groups(rows: DataFrame, k: int, threshold: float) -> tuple[DataFrame, DataFrame | None]:
    """The groups of ``rows`` and the links of papers in several parts, if there are any."""

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        both, a, b, *_ = _mutual_pairs(left, right, k, threshold)
        node = both["node"].to_numpy()
        return pa.table([pa.array(x, pa.int64()) for x in stars(node[a], node[b])], ["a", "b"])

    def joined(left: DataFrame, right: DataFrame, mirrored: bool) -> DataFrame:
        return blocks.meet(left, right, ["granularity"], ["paper"], ["paper"], solve, "a long, b long", mirrored=mirrored, together=TOGETHER)

    whole = rows.filter("chunks = 1").select("granularity", "paper", "unit", "words", "node")
    edges = _edges_beyond_anchors(materialize(whole, "group-whole"), joined)
    nodes = rows.select("granularity", "paper", "unit", "node").distinct()
    large = _large_links(rows, k, threshold)
    if large is not None:
        end = lambda c, p, u: nodes.select("granularity", F.col("paper").alias(p), F.col("unit").alias(u), F.col("node").alias(c))
        met = large.join(end("a", "paper", "unit"), ["granularity", "paper", "unit"]).join(end("b", "dst_paper", "dst_unit"), ["granularity", "dst_paper", "dst_unit"])
        edges = edges.unionByName(met.select("a", "b"))
    members = materialize(nodes.join(connected_components(edges), "node"), "group-members")
    # a component's first unit is the earlier end of its links, so it tells the order of first links
    totals = members.groupBy("granularity", "component").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("paper", "unit")).alias("first"))
    totals = numbered(totals, [F.desc("size"), F.col("first")], "group_no", ["granularity"])
    totals = materialize(totals.select("component", "size", F.col("group_no").cast("int")), "group-totals")
    out = join_groups(members, totals, ["component"], "size", members.count())
    return materialize(out.select("granularity", "group_no", "size", "paper", "unit"), "grouped"), large


def _edges_beyond_anchors(whole: DataFrame, joined) -> DataFrame:
    """Edges ``a, b`` of the components of the links of all papers, though not all papers meet: links between units that are joined already change no component.

    A few papers of each granularity, the anchors, meet all others first. What they join leaves a largest component in each granularity; two papers
    that stand in it with all their units need not meet. The papers that don't, the rest, meet all others.
    """
    papers = whole.groupBy("granularity", "paper").agg(F.count(F.lit(1)).alias("n"))
    papers = materialize(papers.withColumn("deal", F.xxhash64("paper")), "group-papers")
    sizes = papers.groupBy("granularity").agg(F.sum("n").alias("all"))
    if sizes.filter(F.col("all") > ANCHORED * blocks.BLOCK).isEmpty():
        return joined(whole, whole, True)
    # about a block of units of each granularity, by a hash of their papers
    part = F.pmod("deal", F.ceil(F.col("all") / blocks.BLOCK)) == 0
    chosen = papers.join(F.broadcast(sizes), "granularity").filter(part).select("granularity", "paper")
    anchors = materialize(whole.join(chosen, ["granularity", "paper"], "left_semi"), "group-anchors")
    first = materialize(joined(anchors, whole, False), "group-edges")
    labels = materialize(whole.select("granularity", "paper", "node").join(connected_components(first), "node", "left"), "group-labels")
    counts = labels.dropna(subset=["component"]).groupBy("granularity", "component").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy("granularity").agg(F.max_by("component", F.struct("n", "component")).alias("most"))
    outside = labels.join(F.broadcast(most), "granularity", "left").filter(~F.col("component").eqNullSafe(F.col("most")) | F.col("most").isNull())
    rest = whole.join(outside.select("granularity", "paper").distinct(), ["granularity", "paper"], "left_semi")
    return first.unionByName(joined(materialize(rest, "group-rest"), whole, False))


def _large_links(rows: DataFrame, k: int, threshold: float) -> DataFrame | None:
    """Written links with a paper of more than ``blocks.BLOCK`` units; None where there is no such paper."""
    if rows.filter("chunks > 1").isEmpty():
        return None
    return materialize(_index_links(rows, k, threshold), "large-links")


def _index_links(rows: DataFrame, k: int, threshold: float) -> DataFrame:
    """The links of which a paper stands in several parts (``chunks``), by an index of the rarer words (``setjoin.similar_pairs``).

    Units with equal token sets are one set there. What a paper offers to a set are the first ``k`` of its units with each set; sets rank the
    offers of each paper, and the offers of two sets meet where both ranked each other. Only pairs with a set of such a paper are looked for.
    """
    rows = rows.select("granularity", "paper", "unit", F.col("w").alias("words"), (F.col("chunks") > 1).alias("large"))
    rows = materialize(rows.withColumn("words_hash", F.sha2(F.to_json("words"), 256)), "link-units")
    kinds = rows.groupBy("granularity", "words_hash").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.max("large").alias("wanted"))
    kinds = materialize(kinds.withColumn("kind", F.monotonically_increasing_id()), "link-kinds")
    first = F.row_number().over(Window.partitionBy("granularity", "words_hash", "paper").orderBy("unit"))
    offers = rows.drop("words").withColumn("_n", first).filter(F.col("_n") <= k).drop("_n")
    offers = join_groups(materialize(offers, "link-offers"), kinds.drop("words"), ["granularity", "words_hash"], "n", rows.count()).select("granularity", "kind", "paper", "unit", "large")
    offers = materialize(offers, "link-offers")
    sets = setjoin.ordered_sets(kinds.select(F.col("kind").alias("key"), F.col("granularity").alias("group"), "words"), F.col("words"))
    sets = sets.join(kinds.select(F.col("kind").alias("key"), "wanted"), "key")
    pairs = materialize(setjoin.similar_pairs(materialize(sets, "link-sets"), threshold), "link-pairs")
    size = F.size("words")
    own = kinds.filter("wanted").select(F.col("kind").alias("a"), F.col("kind").alias("b"), size.alias("shared"), size.alias("total"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared", "total")).unionByName(own)
    score = (F.col("shared") / F.col("total")).alias("score")
    dst = offers.select("granularity", F.col("kind").alias("dst_kind"), F.col("paper").alias("dst_paper"), F.col("unit").alias("dst_unit"), F.col("large").alias("dst_large"))
    met = both.select(F.col("a").alias("kind"), F.col("b").alias("dst_kind"), "shared", "total", score).join(dst, "dst_kind")
    rk = F.row_number().over(Window.partitionBy("kind", "dst_paper").orderBy(F.desc("score"), "dst_unit"))
    ranked = materialize(met.withColumn("rk", rk).filter(F.col("rk") <= k), "link-ranks")
    back = ranked.select(F.col("kind").alias("dst_kind"), F.col("dst_kind").alias("kind"), F.col("dst_paper").alias("paper"), F.col("dst_unit").alias("unit"), F.col("dst_large").alias("large"))
    links = ranked.join(back, ["kind", "dst_kind"]).filter(F.col("large") | F.col("dst_large")).filter(F.struct("paper", "unit") < F.struct("dst_paper", "dst_unit")).filter(F.col("paper") != F.col("dst_paper"))
    return links.select(*_LINK)


def groups(links: DataFrame) -> DataFrame:
    """Members of the components of links: ``granularity, group_no, size, paper, unit``.

    Groups are numbered per granularity by size, ties by their first link in (unit, other paper, rank) order.
    A unit without links is in no group; an empty table gives no rows.
    """
    return groups_and_links(links)[0]


def groups_and_links(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The result of ``groups``, and ``links`` with their ``group_no``, in which ``(paper, unit, dst_paper, rk)`` is the order of links."""
    links = materialize(links, "links")
    ends = links.select("granularity", "paper", "unit", F.struct("paper", "unit", "dst_paper", "rk").alias("link"))
    other = links.select("granularity", F.col("dst_paper").alias("paper"), F.col("dst_unit").alias("unit"), F.struct("paper", "unit", "dst_paper", "rk").alias("link"))
    nodes = ends.unionByName(other).groupBy("granularity", "paper", "unit").agg(F.min("link").alias("link")).withColumn("node", F.monotonically_increasing_id())
    nodes = materialize(nodes, "group-nodes")
    side = lambda name, p, u: nodes.select("granularity", F.col("paper").alias(p), F.col("unit").alias(u), F.col("node").alias(name))
    edges = links.select("granularity", "paper", "unit", "dst_paper", "dst_unit").join(side("a", "paper", "unit"), ["granularity", "paper", "unit"]).join(side("b", "dst_paper", "dst_unit"), ["granularity", "dst_paper", "dst_unit"])
    parts = connected_components(edges.select("a", "b"))
    members = materialize(nodes.join(parts, "node"), "group-members")
    totals = members.groupBy("granularity", "component").agg(F.count(F.lit(1)).alias("size"), F.min("link").alias("first"))
    totals = numbered(totals, [F.desc("size"), F.col("first")], "group_no", ["granularity"])
    totals = materialize(totals.withColumn("group_no", F.col("group_no").cast("int")).drop("first"), "group-totals")
    out = join_groups(members, totals.drop("granularity"), ["component"], "size", members.count())
    out = materialize(out.select("granularity", "group_no", "size", "paper", "unit", "node"), "grouped")
    # a unit has at most k links of each other paper in its direction, so a member meets few links
    of = out.select("granularity", "paper", "unit", "group_no")
    return out.drop("node"), links.join(of, ["granularity", "paper", "unit"])


def nested_groups(links: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """``granularity, group_id, members, links``: a row for each group as its consumers read it, members by (paper, unit) and links in link order.

    Members and links carry ``title`` and ``tag`` of ``units`` (``granularity, paper, unit, title, tag``), empty where a unit is not there. A group is one row
    by its shape, so this is for the sink; ``groups_and_links`` holds the same as rows.
    """
    members, rows = groups_and_links(links)
    members, rows = with_titles(members, units, [""]), with_titles(rows, units, ["", "dst_"])
    member = F.struct("paper", "unit", "title", "tag")
    order = F.struct("paper", "unit", "dst_paper", "rk").alias("o")
    link = F.struct(order, *[F.col(c) for c in ("paper", "unit", "title", "tag", "dst_paper", "dst_unit", "dst_title", "dst_tag", "score")])
    a = members.groupBy("granularity", "group_no").agg(F.array_sort(F.collect_list(member)).alias("members"))
    b = rows.groupBy("granularity", "group_no").agg(F.transform(F.array_sort(F.collect_list(link)), lambda s: s.dropFields("o")).alias("links"))
    return a.join(b, ["granularity", "group_no"]).select("granularity", F.concat(F.lit("group_"), "group_no").alias("group_id"), "members", "links")


def with_titles(rows: DataFrame, units: DataFrame | None, ends: list[str]) -> DataFrame:
    """``rows`` with ``title`` and ``tag`` of each end (``paper, unit`` behind a prefix) from ``units``; empty where a unit is unknown or has none."""
    for end in ends:
        if units is None:
            rows = rows.withColumns({f"{end}title": F.lit(""), f"{end}tag": F.lit("")})
            continue
        own = units.select("granularity", *[F.col(c).alias(f"{end}{c}") for c in ("paper", "unit", "title", "tag")])
        # of repeated units any one names it
        own = own.groupBy("granularity", f"{end}paper", f"{end}unit").agg(*[F.min(f"{end}{c}").alias(f"{end}{c}") for c in ("title", "tag")])
        rows = rows.join(own, ["granularity", f"{end}paper", f"{end}unit"], "left").na.fill("", [f"{end}title", f"{end}tag"])
    return rows


def unit_similarity(granularity: Column, left: dict[str, Column], right: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Combined, entity and content similarity of two units: half the one and half the other.

    Entity similarity is, for sections, the text similarity of the tags, for all else a third for each of
    ``tag, prev_relation, next_relation`` that agrees. Content similarity is the Jaccard similarity of
    the content words of ``text``.
    """
    slots = {k: left[k] for k in T.SLOTS}, {k: right[k] for k in T.SLOTS}
    entity = F.when(granularity == "sections", T.text_similarity(left["tag"], right["tag"])).otherwise(T.slot_similarity(*slots) / 3)
    content = T.jaccard(T.content_tokens(left["text"]), T.content_tokens(right["text"]))
    return 0.5 * entity + 0.5 * content, entity, content


def match_units(units: DataFrame, papers: list | None = None) -> DataFrame:
    """Mutual best matches of the units of each two papers: ``granularity, paper, unit, dst_paper, dst_unit, similarity, slots, shared, total``.

    ``similarity`` is that of ``unit_similarity``: half the share of slots that agree, half the content similarity; ties are
    all best, and a best of 0 is one as well. Sections, whose tags are compared letter by letter, go through
    ``match_sections``. Of two papers the smaller id is ``paper``, or, if ``papers`` is given, only those
    are compared and the earlier listed is ``paper``. Papers of up to 512 units stand whole in their blocks on both sides, so both
    directions' best are found inside one; larger ones are dealt over several, which leave each direction's best, and those meet again.

    Null slots and texts count as empty. Repeated units are units of their own.
    """
    kinds = dict(units.dtypes)
    clean = [T.slot_value(F.col(c)).alias(c) for c in T.SLOTS]
    rows = units.select("granularity", "paper", "unit", *clean, "text").filter("granularity <> 'sections'")
    place = F.array_position(F.array(*map(F.lit, papers)), F.col("paper")) if papers else F.lit(0)
    rows = rows.withColumn("place", place.cast("int")).filter("place > 0" if papers else "true").withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "match-units")
    words = blocks.number_words(rows.select("row", T.content_tokens(F.coalesce("text", F.lit(""))).alias("w")), "row", F.col("w"))
    # slots are compared as numbers, so that a long one takes no room in a block
    values = rows.select("row", F.posexplode(F.array(*T.SLOTS)).alias("slot", "value")).filter("value <> ''")
    numbers = materialize(values.groupBy("value").agg(F.count(F.lit(1)).alias("n")).withColumn("number", F.monotonically_increasing_id()), "slot-values")
    filled = join_groups(values, numbers, ["value"], "n", 3 * rows.count()).groupBy("row").agg(*[F.max(F.when(F.col("slot") == i, F.col("number"))).alias(c) for i, c in enumerate(T.SLOTS)])
    rows = rows.drop("text", *T.SLOTS).join(words, "row").join(filled, "row", "left").na.fill(-1, list(T.SLOTS))
    rows = blocks.with_chunks(materialize(rows, "match-units"), ["granularity", "paper"], "row")

    def scored(left: pa.Table, right: pa.Table) -> tuple:
        shared, a, b = blocks.shared_counts(left["words"], right["words"])
        total, content = blocks.jaccard(shared, a, b)
        slots = np.zeros(shared.shape, np.int32)
        for c in T.SLOTS:
            x, y = (t[c].to_numpy() for t in (left, right))
            slots += (x[:, None] == y[None, :]) & (x >= 0)[:, None]
        # an empty side has no content in common; the rounding is that of the scalar expression
        return 0.5 * (slots / 3) + 0.5 * content, slots, shared, total

    def chosen(left: pa.Table, right: pa.Table, i: np.ndarray, j: np.ndarray, score, slots, shared, total) -> pa.Table:
        take = lambda t, c, at: t[c].combine_chunks().take(pa.array(at))
        return pa.table(
            [take(left, "granularity", i), take(left, "paper", i), take(left, "unit", i), take(right, "paper", j), take(right, "unit", j), pa.array(score[i, j]), pa.array(slots[i, j]), pa.array(shared[i, j].astype(np.int32)), pa.array(total[i, j].astype(np.int32)),
             take(left, "row", i), take(right, "row", j), take(left, "place", i), take(right, "place", j)],
            [*names, "row", "dst_row", "place", "dst_place"])

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        """Papers that stand whole in their parts, both directions at once."""
        left, right = (t.sort_by([("paper", "ascending")]) for t in (left, right))
        score, *rest = scored(left, right)
        (p, first_p), (q, first_q) = (np.unique(t["paper"].to_numpy(zero_copy_only=False), return_index=True) for t in (left, right))
        per_left, per_right = np.maximum.reduceat(score, first_q, axis=1), np.maximum.reduceat(score, first_p, axis=0)
        of_p, of_q = (np.searchsorted(f, np.arange(n), "right") - 1 for f, n in ((first_p, len(left)), (first_q, len(right))))
        places = [t["place"].to_numpy() for t in (left, right)]
        numbers = np.split(np.unique(np.concatenate([p, q]), return_inverse=True)[1], [len(p)])
        order = places if papers else [numbers[0][of_p], numbers[1][of_q]]
        # a part and itself meet once, so each two papers of it stand here in both orders
        count = order[0][:, None] < order[1][None, :] if np.array_equal(p, q) else order[0][:, None] != order[1][None, :]
        i, j = np.nonzero(count & (score == per_left[:, of_q]) & (score == per_right[of_p, :]))
        forth = order[0][i] < order[1][j]
        return pa.concat_tables([chosen(left, right, i[forth], j[forth], score, *rest), chosen(right, left, j[~forth], i[~forth], score.T, *(x.T for x in rest))])

    def best_of_part(left: pa.Table, right: pa.Table) -> pa.Table:
        """Of papers in several parts, each row's best in this part of the other paper, one direction."""
        right = right.sort_by([("paper", "ascending")])
        score, *rest = scored(left, right)
        p, (q, first_q) = left["paper"].to_numpy(zero_copy_only=False), np.unique(right["paper"].to_numpy(zero_copy_only=False), return_index=True)
        of_q = np.searchsorted(first_q, np.arange(len(right)), "right") - 1
        several = (left["chunks"].to_numpy() > 1)[:, None] | (right["chunks"].to_numpy() > 1)[None, :]
        i, j = np.nonzero((score == np.maximum.reduceat(score, first_q, axis=1)[:, of_q]) & several & (p[:, None] != q[of_q][None, :]))
        return chosen(left, right, i, j, score, *rest)

    names = ["granularity", "paper", "unit", "dst_paper", "dst_unit", "similarity", "slots", "shared", "total"]
    schema = f"granularity string, paper {kinds['paper']}, unit {kinds['unit']}, dst_paper {kinds['paper']}, dst_unit {kinds['unit']}, similarity double, slots int, shared int, total int, row long, dst_row long, place int, dst_place int"
    whole, parts = rows.filter("chunks = 1"), rows.filter("chunks > 1")
    out = blocks.meet(whole, whole, ["granularity"], ["paper"], ["paper"], solve, schema, mirrored=True, together=TOGETHER).select(*names)
    if parts.isEmpty():
        return out
    met = [blocks.meet(a, b, ["granularity"], ["row"], ["paper", "chunk"], best_of_part, schema) for a, b in ((parts, rows), (whole, parts))]
    best = materialize(met[0].unionByName(met[1]).withColumn("rk", F.rank().over(Window.partitionBy("row", "dst_paper").orderBy(F.desc("similarity")))).filter("rk = 1"), "match-best")
    back = best.select(F.col("dst_row").alias("row"), F.col("row").alias("dst_row"))
    links = best.filter("place < dst_place" if papers else "paper < dst_paper").join(back, ["row", "dst_row"], "left_semi")
    return out.unionByName(links.select(*names))


def match_sections(units: DataFrame) -> DataFrame:
    """Mutual best matches of sections of each two papers, the smaller id first: ``paper, unit, dst_paper, dst_unit, similarity, entity_similarity, content_similarity``.

    The tags' text similarity is not symmetric, so each direction ranks by its own scores; the similarities
    given are those of the first paper's direction, rounded to three digits. Tags and texts are tokenised once; sections meet in blocks, and
    the tags are compared letter by letter only where bounds let them (``similarity.best_in_block``). A paper of any size is dealt
    over blocks, whose best meet again. Null tags and texts count as empty; repeated rows are sections of their own; an empty table gives no rows.
    """
    kinds = dict(units.dtypes)
    rows = units.filter("granularity = 'sections'").select("paper", "unit", F.coalesce("tag", F.lit("")).alias("tag"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"), F.lit(0).alias("_g"))
    rows = materialize(rows, "sections")
    numbers = lambda words, name: materialize(blocks.number_words(rows.select("row", words.alias("w")), "row", F.col("w")).withColumnRenamed("words", name), name)
    own = rows.select("row", "_g", "paper", "unit", F.lower("tag").alias("low")).join(numbers(T.tokens(F.col("tag")), "tag_words"), "row").join(numbers(T.content_tokens(F.col("text")), "words"), "row")
    own = materialize(own, "sections")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        _, tags = blocks.jaccard(*blocks.shared_counts(left["tag_words"], right["tag_words"]))
        _, content = blocks.jaccard(*blocks.shared_counts(left["words"], right["words"]))
        papers = [t["paper"].to_numpy(zero_copy_only=False) for t in (left, right)]
        entity = lambda i, j, ratio: 0.5 * tags[i, j] + 0.5 * ratio
        combine = lambda i, j, ratio: 0.5 * entity(i, j, ratio) + 0.5 * content[i, j]
        group_of = np.unique(papers[1], return_inverse=True)[1]
        lows = [t["low"].to_pylist() for t in (left, right)]
        i, j, raw, _ = similarity.best_in_block(*lows, combine, np.arange(len(right)), group_of, None, 0.0, papers[0][:, None] == papers[1][None, :])
        ratios = [similarity.ratio(lows[0][a], lows[1][b]) for a, b in zip(i, j)]
        take = lambda t, c, at: t[c].combine_chunks().take(pa.array(at, pa.int64()))
        return pa.table(
            [take(left, "row", i), take(right, "row", j), take(left, "paper", i), take(left, "unit", i), take(right, "paper", j), take(right, "unit", j), pa.array(raw, pa.float64()),
             pa.array([float(entity(a, b, r)) for a, b, r in zip(i, j, ratios)], pa.float64()), pa.array([float(content[a, b]) for a, b in zip(i, j)], pa.float64())],
            ["row", "dst_row", "paper", "unit", "dst_paper", "dst_unit", "raw", "entity", "content"])

    schema = f"row long, dst_row long, paper {kinds['paper']}, unit {kinds['unit']}, dst_paper {kinds['paper']}, dst_unit {kinds['unit']}, raw double, entity double, content double"
    met = blocks.meet(own, own, ["_g"], ["row"], ["row"], solve, schema)
    best = F.rank().over(Window.partitionBy("row", "dst_paper").orderBy(F.desc("raw")))
    best = materialize(met.withColumn("rk", best).filter("rk = 1").drop("rk"), "section-best")
    back = best.select(F.col("dst_row").alias("row"), F.col("row").alias("dst_row"))
    links = best.filter("paper < dst_paper").join(back, ["row", "dst_row"], "left_semi")
    return links.select("paper", "unit", "dst_paper", "dst_unit", *[T.py_round(F.col(c), 3).alias(n) for c, n in (("raw", "similarity"), ("entity", "entity_similarity"), ("content", "content_similarity"))])


def group_matches(groups: DataFrame, k: int = 3, counted=None) -> DataFrame:
    """``group_id, position, dst_group, dst_position, raw, score, rk``: of all other groups the ``k`` whose question is most like its own.

    ``groups`` has ``group_id, position, question``; ties go to the earlier position. Scores are rounded to three
    digits after ranking. Equal questions are compared once, others exactly only where bounds let them (``similarity.best_texts``). A null question
    counts as empty; two empty ones score 0.5. Ids must differ; an empty table, or a single group, gives no rows.
    """
    rows = materialize(groups.select("group_id", "position", F.coalesce("question", F.lit("")).alias("text")), "group-questions")
    texts = materialize(rows.groupBy("text").agg(F.count(F.lit(1)).alias("n")).withColumns({"row": F.monotonically_increasing_id(), "block": F.lit(0)}), "group-texts")
    named = materialize(join_groups(rows, texts, ["text"], "n", rows.count()), "group-questions")
    # a group's own place among the best of its text is left out, so one more is looked for
    first = F.row_number().over(Window.partitionBy("row").orderBy("position", "group_id"))
    offers = named.withColumn("_n", first).filter(F.col("_n") <= k + 1).select("row", "block", "text", F.lit(0).alias("dst_group"), F.struct("position", "group_id").alias("dst"))
    best = similarity.best_texts(texts.select("row", "block", "text"), offers, k + 1, counted)
    lists = best.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rk", "dst", "raw"))).alias("m"))
    met = join_groups(named.select("row", "group_id", "position"), materialize(lists.join(texts.select("row", "n"), "row"), "group-lists"), ["row"], "n", named.count())
    others = F.slice(F.filter("m", lambda x: ~x["dst"]["group_id"].eqNullSafe(F.col("group_id"))), 1, k)
    met = met.select("group_id", "position", F.posexplode(others).alias("at", "x")).select("group_id", "position", "x.dst", "x.raw", (F.col("at") + 1).alias("rk"))
    return met.select("group_id", "position", F.col("dst.group_id").alias("dst_group"), F.col("dst.position").alias("dst_position"), "raw", T.py_round(F.col("raw"), 3).alias("score"), "rk")


def mutual_group_links(candidates: DataFrame) -> DataFrame:
    """``group_a, group_b, position, rk, score``: groups that chose each other, in the direction of the earlier one, with that direction's score. An empty table gives no rows."""
    back = candidates.select(F.col("group_id").alias("dst_group"), F.col("dst_group").alias("group_id"))
    links = candidates.filter(F.col("position") < F.col("dst_position")).join(back, ["group_id", "dst_group"])
    return links.select(F.col("group_id").alias("group_a"), F.col("dst_group").alias("group_b"), "position", "rk", "score")


def super_groups(links: DataFrame, threshold: float = 0.33) -> DataFrame:
    """``super_group, size, group_id``: components of the links of at least ``threshold``, by size, ties by first link.

    The score is the rounded one. A group without such a link is in no super-group; an empty table gives no rows.
    """
    return super_groups_and_links(links, threshold)[0]


def super_groups_and_links(links: DataFrame, threshold: float = 0.33) -> tuple[DataFrame, DataFrame]:
    """The result of ``super_groups``, and the links of at least ``threshold`` with their ``super_group``, in the order of ``(position, rk)``."""
    links = materialize(links.filter(F.col("score") >= threshold), "group-links")
    parts = materialize(connected_components(links.select(F.col("group_a").alias("a"), F.col("group_b").alias("b"))), "group-parts")
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    of = join_groups(parts, materialize(sizes, "group-sizes"), ["component"], "size", parts.count())
    of = materialize(of, "group-parts")
    linked = materialize(links.join(of.withColumnRenamed("node", "group_a"), "group_a"), "group-links")
    first = linked.groupBy("component", "size").agg(F.min(F.struct("position", "rk")).alias("first"))
    numbers = materialize(numbered(first, [F.desc("size"), F.col("first")], "super_group").select("component", "super_group", "size"), "super-numbers")
    members = join_groups(of.drop("size"), numbers, ["component"], "size", of.count()).select("super_group", "size", F.col("node").alias("group_id"))
    grown = materialize(numbers.drop("size").join(linked.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "component"), "super-numbers")
    return members, join_groups(linked.drop("size"), grown, ["component"], "n", linked.count()).drop("component", "n")


def nested_super_groups(links: DataFrame, questions: DataFrame, threshold: float = 0.33) -> DataFrame:
    """``super_group_id, members, links``: a row for each super-group as its consumers read it: members by id with their question, links in link order.

    ``questions`` is ``group_id, question``; an unknown group has an empty one.
    """
    members, rows = super_groups_and_links(links, threshold)
    named = members.join(questions.select("group_id", F.col("question").alias("overarching_question")), "group_id", "left").na.fill("", ["overarching_question"])
    a = named.groupBy("super_group").agg(F.array_sort(F.collect_list(F.struct("group_id", "overarching_question"))).alias("members"))
    link = F.struct(F.struct("position", "rk").alias("o"), "group_a", "group_b", "score")
    b = rows.groupBy("super_group").agg(F.transform(F.array_sort(F.collect_list(link)), lambda s: s.dropFields("o")).alias("links"))
    return a.join(b, "super_group").select(F.concat(F.lit("super_group_"), "super_group").alias("super_group_id"), "members", "links")


def slot_classes(units: DataFrame, slots: tuple[str, ...] = ("tag", "prev_relation", "next_relation")) -> DataFrame:
    """``slot, value, paper, unit``: each unit in its class of every slot that it fills.

    Two units agree in as many slots as they share classes, which holds the slot similarity of all pairs in
    at most a row per unit and slot; the pairs themselves grow with the square of a class.
    """
    filled = F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), T.slot_value(F.col(s)).alias("value")) for s in slots]))
    rows = units.select("paper", "unit", filled.alias("z")).filter("z.value <> ''")
    return rows.select("z.slot", F.substr("z.value", F.lit(2)).alias("value"), "paper", "unit")


def slot_pair_counts(units: DataFrame) -> DataFrame:
    """``slots, pairs, paper_pairs``: how many pairs of units of different papers, and of papers, agree in so many slots.

    ``units`` is ``paper`` and the values of ``T.SLOTS`` (see ``T.slot_value``). A value that stands in one paper alone agrees with none. What is left of
    a paper, its different slots with their numbers of units, is its profile; papers with one profile are counted together, so profiles, not papers, meet in blocks,
    which hold them whole. A null paper counts in no pair.
    """
    rows = materialize(units.filter("paper is not null").select("paper", *T.SLOTS, F.monotonically_increasing_id().alias("row")), "slot-units")
    values = rows.select("paper", "row", F.posexplode(F.array(*T.SLOTS)).alias("slot", "value")).filter("value <> ''")
    numbers = values.groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n"), F.min("paper").alias("low"), F.max("paper").alias("high")).filter("low <> high")
    numbers = materialize(numbers.select("slot", "value", "n", F.monotonically_increasing_id().alias("number")), "slot-values")
    filled = join_groups(values, numbers, ["slot", "value"], "n", values.count()).groupBy("paper", "row").agg(*[F.max(F.when(F.col("slot") == i, F.col("number"))).alias(c) for i, c in enumerate(T.SLOTS)])
    kinds = filled.na.fill(-1, list(T.SLOTS)).groupBy("paper", *T.SLOTS).agg(F.count(F.lit(1)).alias("units"))
    profiles = kinds.groupBy("paper").agg(F.array_sort(F.collect_list(F.struct(*T.SLOTS, "units"))).alias("kinds")).groupBy("kinds").agg(F.count(F.lit(1)).alias("papers"))
    profiles = materialize(profiles.withColumn("profile", F.monotonically_increasing_id()), "slot-profiles")
    own = materialize(profiles.select(F.lit(0).alias("_g"), "profile", "papers", F.inline("kinds")), "slot-kinds")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        slots = np.zeros((len(left), len(right)), np.int32)
        for c in T.SLOTS:
            x, y = (t[c].to_numpy() for t in (left, right))
            slots += (x[:, None] == y[None, :]) & (x >= 0)[:, None]
        (p, m, n), (q, k, o) = ([t[c].to_numpy() for c in ("profile", "papers", "units")] for t in (left, right))
        slots[p[:, None] > q[None, :]] = 0
        out = []
        for count in range(1, len(T.SLOTS) + 1):
            i, j = np.nonzero(slots == count)
            # two profiles pair each paper of one with each of the other, a profile each two of its own papers
            weight = np.where(p[i] == q[j], m[i] * (m[i] - 1) // 2, m[i] * k[j])
            first = np.unique(np.stack([p[i], q[j]]), axis=1, return_index=True)[1] if len(i) else np.zeros(0, int)
            out.append((count, int((weight * n[i] * o[j]).sum()), int(weight[first].sum())))
        return pa.table([pa.array(c) for c in zip(*out)], ["slots", "pairs", "paper_pairs"])

    counts = blocks.meet(own, own, ["_g"], ["profile"], ["profile"], solve, "slots int, pairs long, paper_pairs long")
    return counts.groupBy("slots").agg(F.sum("pairs").alias("pairs"), F.sum("paper_pairs").alias("paper_pairs")).filter("pairs > 0")


def similarity_matches(units: DataFrame, k: int = 3, threshold: float | None = None, sought: DataFrame | None = None, counted=None) -> DataFrame:
    """``granularity, paper, unit, tag, dst_paper, dst_unit, dst_tag, similarity, rk``: ``top_matches`` by whole text similarity.

    Ranks are by the raw score, the similarity given is rounded to three digits after that. Distinct tags are
    scored once, in both directions as the ratio is not symmetric, and only where bounds let them (``similarity.best_matches``); with
    ``threshold`` only matches that reach it after rounding are looked for, with ``sought`` (``granularity, tag``) only those of units with such a tag. A null tag counts as empty, repeated rows are units of their own.
    """
    units = units.select("granularity", "paper", "unit", F.coalesce("tag", F.lit("")).alias("tag"))
    tags = units.groupBy("granularity", "tag").agg(F.count(F.lit(1)).alias("n")).withColumn("row", F.monotonically_increasing_id())
    tags = materialize(tags, "similar-tags")
    named = materialize(join_groups(materialize(units, "similar-units"), tags, ["granularity", "tag"], "n", units.count()), "similar-units")
    first = F.row_number().over(Window.partitionBy("granularity", "paper", "row").orderBy("unit"))
    offers = named.withColumn("_n", first).filter(F.col("_n") <= k).select("row", F.col("granularity").alias("block"), F.col("tag").alias("text"), F.col("paper").alias("dst_group"), F.col("unit").alias("dst"))
    # half a unit of the third digit, and a little more for the rounding itself
    floor = 0.0 if threshold is None else threshold - 0.0005 - 1e-9
    asking = tags if sought is None else tags.join(sought, ["granularity", "tag"], "left_semi")
    best = materialize(similarity.best_matches(asking.select("row", F.col("granularity").alias("block"), F.col("tag").alias("text")), offers, k, floor, counted), "similar-best")
    named_tags = tags.select(F.col("row").alias("dst_row"), F.col("tag").alias("dst_tag"))
    best = best.select("row", F.col("dst_group").alias("dst_paper"), F.col("dst").alias("dst_unit"), "dst_row", T.py_round(F.col("raw"), 3).alias("similarity"), "rk").join(named_tags, "dst_row")
    per_tag = materialize(best.groupBy("row").agg(F.collect_list(F.struct("dst_paper", "dst_unit", "dst_tag", "similarity", "rk")).alias("matches")).join(tags.select("row", "n"), "row"), "similar-lists")
    out = join_groups(named.drop("n"), per_tag, ["row"], "n", named.count()).select("granularity", "paper", "unit", "tag", F.inline("matches"))
    out = out.filter(F.col("paper") != F.col("dst_paper"))
    return out if threshold is None else out.filter(F.col("similarity") >= threshold)


def similarity_links(units: DataFrame, k: int = 3, threshold: float = 0.45, counted=None) -> DataFrame:
    """Mutual links by whole text similarity that reach ``threshold`` after rounding: ``granularity, paper, unit, dst_paper, dst_unit, score, rk``.

    The score is that of the earlier unit's direction, which alone must reach the threshold. The later unit need only have chosen the earlier one, at
    any score, so matches are completed for the tags of such later units alone.
    """
    ends = ["granularity", "paper", "unit", "dst_paper", "dst_unit"]
    forward = similarity_matches(units, k, threshold, counted=counted).filter(F.struct("paper", "unit") < F.struct("dst_paper", "dst_unit"))
    forward = materialize(forward, "similar-forward")
    sought = materialize(forward.select("granularity", F.col("dst_tag").alias("tag")).distinct(), "similar-sought")
    back = similarity_matches(units, k, sought=sought, counted=counted)
    back = back.select("granularity", F.col("paper").alias("dst_paper"), F.col("unit").alias("dst_unit"), F.col("dst_paper").alias("paper"), F.col("dst_unit").alias("unit"))
    return forward.join(back, ends).select(*ends, F.col("similarity").alias("score"), "rk")


def match_table(units: DataFrame, matches: DataFrame, papers: DataFrame | None = None) -> DataFrame:
    """A row for every unit: ``granularity, paper, unit, tag, matches``, the matches by other paper and rank.

    Units without a match keep an empty list. Papers come in the order of ``papers`` (``paper, paper_ord``), or by id.
    """
    order = papers.select(F.col("paper").alias("dst_paper"), "paper_ord") if papers is not None else None
    rows = matches.join(order, "dst_paper") if order is not None else matches.withColumn("paper_ord", F.col("dst_paper"))
    listed = F.array_sort(F.collect_list(F.struct("paper_ord", "rk", F.col("dst_paper").alias("paper"), F.col("dst_unit").alias("unit"), F.col("dst_tag").alias("tag"), "similarity")))
    listed = rows.groupBy("granularity", "paper", "unit").agg(F.transform(listed, lambda m: F.struct(m["paper"].alias("paper"), m["unit"].alias("unit"), m["tag"].alias("tag"), m["similarity"].alias("similarity"))).alias("matches"))
    empty = F.array().cast(dict(listed.dtypes)["matches"])
    return units.select("granularity", "paper", "unit", "tag").join(listed, ["granularity", "paper", "unit"], "left").withColumn("matches", F.coalesce("matches", empty))
