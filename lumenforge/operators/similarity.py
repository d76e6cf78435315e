"""Best matches by whole text similarity: exact ratios only where upper bounds reach the scores found so far.

The ratio of two strings takes as much time as the product of their lengths. It is at most what their numbers of each
character allow, and what their longest common subsequence does; token sets compare in whole blocks. So a block of pairs first gets bounds and
each row then looks at its candidates from the best bound down, until none reaches the last of its ``k`` scores. Short texts meet
those that are one character away and those that share a rare token first (``best_texts``), which settles most rows without blocks.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable
from difflib import SequenceMatcher
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenforge.functions import text as T
from lumenforge.operators import blocks
from lumenforge.plans.lineage import materialize
from lumenforge.plans.skew import join_groups

NAME = 64  # characters of a text that is looked for one character away
RARE = 64  # texts that share a rare token
SHAPES = 2000  # kinds of texts by length, tokens and common tokens that bound each other
FEW = 512  # texts that meet in blocks at once

def ratio_bounds(left: list[str], right: list[str]) -> np.ndarray:
    """For each pair at least the ratio of the two strings: twice the characters that both have, over both lengths; 1 for two empty ones."""
    sides = [np.array([len(s) for s in side], np.int64) for side in (left, right)]
    codes = [np.frombuffer("".join(side).encode("utf-32-le"), np.uint32) for side in (left, right)]
    common = np.zeros((len(left), len(right)), np.int64)
    for c in np.intersect1d(*codes):
        a, b = (np.bincount(np.repeat(np.arange(len(n)), n)[code == c], minlength=len(n)) for n, code in zip(sides, codes))
        common += np.minimum(a[:, None], b[None, :])
    total = sides[0][:, None] + sides[1][None, :]
    return np.divide(2.0 * common, total, out=np.ones(common.shape), where=total > 0)


class _Target:
    """A string that others are compared with: its matcher and, for its characters, the bits of their places, each made once."""

    def __init__(self, text: str) -> None:
        self.text, self.matcher = text, SequenceMatcher(None, "", text)
        self.places: dict[str, int] = {}
        for i, c in enumerate(text):
            self.places[c] = self.places.get(c, 0) | 1 << i

    def ratio_bound(self, other: str) -> float:
        """The ratio if all of the longest common subsequence matched; blocks that match follow one another in both strings, so no ratio is above it."""
        total = len(self.text) + len(other)
        if not total:
            return 1.0
        every = left = (1 << len(self.text)) - 1
        for c in other:  # a bit of ``left`` falls with each character by which the subsequence grows
            hit = left & self.places.get(c, 0)
            left = (left + hit | left - hit) & every
        return 2.0 * (len(self.text) - left.bit_count()) / total

    def ratio(self, other: str) -> float:
        self.matcher.set_seq1(other)
        return self.matcher.ratio()


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def best_in_block(left: list[str], right: list[str], combine: Callable, text_of: np.ndarray, group_of: np.ndarray, k: int | None, floor: float | np.ndarray, same: np.ndarray | None = None) -> tuple[list[int], list[int], list[float], int]:
    """Rows, candidates and scores of the ``k`` best candidates of each row and group, and how many pairs were compared exactly.

    Candidates stand in order of preference; ``text_of`` and ``group_of`` give their text (a place in ``right``) and group.
    ``combine(row, text, ratio)`` is the score, which grows with the ratio; without ``k`` all candidates with the best score are chosen.
    ``same`` marks pairs of a row and a candidate that don't count; scores below ``floor``, one for all or one a row, don't either. A candidate is met with the bound
    of its characters, then, if that still reaches, with that of its common subsequence, and only then compared.
    """
    every = np.arange(len(right))
    bounds = ratio_bounds(left, right)
    targets: dict[int, _Target] = {}
    out: tuple[list[int], list[int], list[float]] = ([], [], [])
    compared = 0
    floors = np.broadcast_to(np.asarray(floor, float), len(left)).tolist()
    for i, (own, floor) in enumerate(zip(left, floors)):
        reach = combine(i, every, bounds[i])[text_of]
        counts = reach >= floor if same is None else (reach >= floor) & ~same[i]
        places = np.flatnonzero(counts)
        places = places[np.argsort(-reach[places], kind="stable")]
        heap = [(-x, j, 0) for x, j in zip(reach[places].tolist(), places.tolist())]  # sorted, so a heap
        best: dict[int, list[tuple[float, int]]] = {}
        known: tuple[dict[int, float], dict[int, float]] = ({}, {})
        while heap:
            bound, j, stage = heappop(heap)
            kept = best.setdefault(int(group_of[j]), [])
            # of equal scores the earlier candidate stays, so a later one with that bound need not be compared
            if -bound < floor or len(kept) >= (k or 1) and ((bound, j) > kept[-1] if k else bound > kept[-1][0]):
                continue
            t = int(text_of[j])
            target = targets.get(t) or targets.setdefault(t, _Target(right[t]))
            if stage == 2:
                insort(kept, (bound, j))
                del kept[k or len(kept) :]
                continue
            if t not in known[stage]:
                known[stage][t] = float(combine(i, t, target.ratio(own) if stage else target.ratio_bound(own)))
                compared += stage
            heappush(heap, (-known[stage][t], j, stage + 1))
        for kept in best.values():
            for score, j in kept:
                if k or score == kept[0][0]:
                    out[0].append(i), out[1].append(j), out[2].append(-score)
    return *out, compared


def best_matches(rows: DataFrame, offers: DataFrame, k: int, floor: float = 0.0, counted=None) -> DataFrame:
    """``row, dst_group, dst, dst_row, raw, rk``: of each group of ``offers`` the ``k`` most like each row.

    ``rows`` is ``row, block, text`` and ``offers`` is ``row, block, text, dst_group, dst``, where ``row`` numbers a text and those with one number have one text;
    rows and offers of one ``block`` value compare, ties go to the smaller ``dst``. Texts must not be null. Scores below ``floor`` are left out, and then
    ranks are those of all. Where offers have a column ``own``, the row of that number doesn't choose them; where rows have a column ``least``, what scores less is left out for them. Rows and offers meet in parts of ``blocks.BLOCK``; what
    leaves a part are its ``k`` best, which meet again, so a group may be of any size. ``counted`` is an accumulator of a pair of numbers:
    pairs of texts that met and pairs that were compared exactly.
    """
    rows, offers = materialize(rows, "similar-rows"), materialize(offers, "similar-offers")
    texts = rows.select("row", "text").unionByName(offers.select("row", "text")).groupBy("row").agg(F.first("text").alias("text"))
    words = materialize(blocks.number_words(texts.withColumn("w", T.tokens(F.col("text"))), "row", F.col("w")), "similar-words")
    low = lambda df: df.withColumn("low", F.lower("text")).drop("text").join(words, "row")
    kinds = dict(offers.dtypes)

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("dst_group", "ascending"), ("dst", "ascending")])
        names, first, text_of = np.unique(right["row"].to_numpy(), return_index=True, return_inverse=True)
        group_of = np.unique(right["dst_group"].to_numpy(zero_copy_only=False), return_inverse=True)[1]
        distinct = right.take(pa.array(first))
        _, jaccard = blocks.jaccard(*blocks.shared_counts(left["words"], distinct["words"]))
        same = left["row"].to_numpy()[:, None] == right["own"].to_numpy()[None, :]
        combine = lambda i, t, ratio: 0.5 * jaccard[i, t] + 0.5 * ratio
        floors = np.maximum(floor, left["least"].to_numpy())
        i, j, score, compared = best_in_block(left["low"].to_pylist(), distinct["low"].to_pylist(), combine, text_of, group_of, k, floors, same)
        if counted is not None:
            counted.add((left.num_rows * len(names), compared))
        take = lambda t, c, at: t[c].combine_chunks().take(pa.array(at, pa.int64()))
        return pa.table([take(left, "row", i), take(right, "dst_group", j), take(right, "dst", j), take(right, "row", j), pa.array(score, pa.float64())], ["row", "dst_group", "dst", "dst_row", "raw"])

    rows = rows.withColumn("least", F.coalesce(F.col("least") if "least" in rows.columns else F.lit(None).cast("double"), F.lit(0.0)))
    # an offer's own row, or a number that no row has
    offers = offers.withColumn("own", (F.col("own") if "own" in kinds else F.lit(-1)).cast("long"))
    met = blocks.meet(materialize(low(rows), "similar-left"), materialize(low(offers), "similar-right"), ["block"], ["row"], ["dst_group", "dst"], solve, f"row long, dst_group {kinds['dst_group']}, dst {kinds['dst']}, dst_row long, raw double")
    rk = F.row_number().over(Window.partitionBy("row", "dst_group").orderBy(F.desc("raw"), "dst"))
    return met.withColumn("rk", rk).filter(F.col("rk") <= k)


def best_texts(rows: DataFrame, offers: DataFrame, k: int, counted=None) -> DataFrame:
    """``best_matches(rows, offers, k)`` where ``rows`` are the texts of ``offers``, once each, and all are one block and one group.

    Texts of up to ``NAME`` characters meet those that become equal to them when at most one character is deleted on each side, and those that share a
    token of at most ``RARE`` texts. All others share common tokens only and miss two characters of the longer text, which bounds their score by
    ``_shape_bounds``. Rows with ``k`` matches above that bound are settled; the rest, and long texts, go through ``best_matches``.
    """
    rows, offers = materialize(rows, "near-rows"), materialize(offers, "near-offers")
    own = rows.select("row", F.lower("text").alias("low"), T.tokens(F.col("text")).alias("words")).withColumn("n", F.length("low"))
    own = materialize(own, "near-texts")
    bounds = _shape_bounds(own) if own.count() > FEW else None
    if bounds is None:
        return best_matches(rows, offers, k, counted=counted)
    short = own.filter(F.col("n") <= NAME)
    deleted = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.substr("low", F.lit(1), i - 1), F.substr("low", i + 1, F.col("n")))))
    variants = short.select("row", F.explode(F.array_distinct(F.concat(F.array("low"), F.coalesce(deleted, F.array().cast("array<string>"))))).alias("v"))
    spread = materialize(short.select("row", F.explode("words").alias("word")), "near-words")
    rare = spread.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(f"n between 2 and {RARE}").select("word")
    met = variants.select(F.concat(F.lit("v"), "v").alias("bucket"), "row").unionByName(spread.join(rare, "word").select(F.concat(F.lit("w"), "word").alias("bucket"), "row"))
    dst = dict(offers.dtypes)["dst"]
    texts = short.drop("n").join(offers.select("row", "dst"), "row")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chosen = met.join(texts, "row").select("bucket", "row", "low", "words", "dst").repartition(tasks, "bucket").sortWithinPartitions("bucket", "dst", "row")
    chosen = chosen.mapInArrow(lambda batches: _best_in_buckets(batches, k), f"row long, dst {dst}, dst_row long, raw double")
    # equal texts are as alike as a text without tokens, or with some, is to itself
    itself = texts.select("row", "dst", F.col("row").alias("dst_row"), F.when(F.size("words") > 0, 1.0).otherwise(0.5).alias("raw"))
    rk = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("raw"), "dst"))
    best = chosen.dropDuplicates(["row", "dst", "dst_row"]).unionByName(itself).withColumn("rk", rk).filter(F.col("rk") <= k)
    best = materialize(best.select("row", F.lit(0).alias("dst_group"), "dst", "dst_row", "raw", "rk"), "near-best")
    least = best.filter(F.col("rk") == k).select("row", F.col("raw").alias("least"))
    known = materialize(rows.join(least, "row", "left").join(bounds, "row", "left"), "near-known")
    settled = F.coalesce(F.col("least") > F.col("bound"), F.lit(False))
    rest = known.filter(~settled).select("row", "block", "text", "least")
    best = best.join(known.filter(settled).select("row"), "row", "left_semi")
    return best if rest.isEmpty() else best.unionByName(best_matches(rest, offers, k, counted=counted))


def _shape_bounds(own: DataFrame) -> DataFrame | None:
    """``row, bound`` of short texts: a score that no text reaches which shares no rare token and doesn't come one character near; None where kinds of texts are too many.

    A kind is a length, a number of tokens and the common tokens among them; of long texts only the number of tokens and the least length count.
    """
    own = own.select("row", "n", F.size("words").alias("a"), "words")
    short = own.filter(F.col("n") <= NAME)
    spread = materialize(short.select("row", F.explode("words").alias("word")), "shape-words")
    common = materialize(spread.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > RARE), "shape-common")
    if common.count() > SHAPES:
        return None
    lists = join_groups(spread, common, ["word"], "n", spread.count()).groupBy("row").agg(F.array_sort(F.collect_list("word")).alias("common"))
    short = short.drop("words").join(lists, "row", "left").withColumn("common", F.coalesce("common", F.array().cast("array<string>")))
    short = materialize(short, "shape-texts")
    kinds = short.select("n", "a", "common").distinct().limit(SHAPES + 1).collect()
    far = own.filter(F.col("n") > NAME).groupBy("a").agg(F.min("n").alias("n")).limit(SHAPES + 1).collect()
    if not kinds or len(kinds) + len(far) > SHAPES:
        return None
    n, a = (np.array([r[c] for r in kinds], float)[:, None] for c in ("n", "a"))
    words = {w: i for i, w in enumerate(sorted({w for r in kinds for w in r["common"]}))}
    has = np.zeros((len(kinds), len(words) + 1), np.float32)
    for i, r in enumerate(kinds):
        has[i, [words[w] for w in r["common"]]] = 1
    shared = (has @ has.T).astype(float)
    longest = np.maximum(n, n.T)
    bound = 0.5 * np.divide(shared, a + a.T - shared, out=np.zeros(shared.shape), where=shared > 0)
    bound += np.divide(np.minimum(np.minimum(n, n.T), np.maximum(longest - 2, 0)), n + n.T, out=np.zeros(shared.shape), where=longest > 0)
    bound = bound.max(1)
    if far:
        m, b = (np.array([r[c] for r in far], float)[None, :] for c in ("n", "a"))
        bound = np.maximum(bound, (0.5 * np.minimum(a, b) / np.maximum(np.maximum(a, b), 1) + n / (n + m)).max(1))
    # the margin is for the rounding of sums
    rows = [(int(r["n"]), int(r["a"]), list(r["common"]), float(x) + 1e-9) for r, x in zip(kinds, bound)]
    named = own.sparkSession.createDataFrame(rows, "n int, a int, common array<string>, bound double")
    return short.join(F.broadcast(named), ["n", "a", "common"]).select("row", "bound")


def _best_in_buckets(batches, k: int):
    """Of the rows of each bucket, which follow one another by ``dst``, the ``k`` best others of each."""
    for table in _whole(batches):
        buckets, rows, lows = (table[c].to_pylist() for c in ("bucket", "row", "low"))
        words = [frozenset(w) for w in table["words"].to_pylist()]
        out: tuple[list[int], list[int], list[float]] = ([], [], [])
        start = 0
        for end in range(1, len(buckets) + 1):
            if end < len(buckets) and buckets[end] == buckets[start]:
                continue
            if end - start > 1:
                _best_of_bucket(range(start, end), rows, lows, words, k, out)
            start = end
        take = lambda c, at: table[c].combine_chunks().take(pa.array(at, pa.int64()))
        found = pa.table([take("row", out[0]), take("dst", out[1]), take("row", out[1]), pa.array(out[2], pa.float64())], ["row", "dst", "dst_row", "raw"])
        yield from found.to_batches(max_chunksize=65_536)


def _best_of_bucket(places: range, rows: list[int], lows: list[str], words: list[frozenset], k: int, out: tuple) -> None:
    matchers: dict[str, SequenceMatcher] = {}
    for i in {rows[p]: p for p in places}.values():
        a, u = lows[i], words[i]
        reach = []
        for j in places:
            if rows[j] != rows[i]:
                b, v = lows[j], words[j]
                shared, n, m = len(u & v), len(a), len(b)
                token = 0.5 * (shared / (len(u) + len(v) - shared)) if shared else 0.0
                reach.append((-token - (0.5 if a == b else min(n, m, max(n, m) - 1) / (n + m)), j, token))
        kept: list[tuple[float, int]] = []
        for bound, j, token in sorted(reach):
            # of equal scores the earlier stays; halving is exact, so a bound that is reached equals the score
            if len(kept) >= k and (bound, j) > kept[-1]:
                break
            matcher = matchers.get(lows[j]) or matchers.setdefault(lows[j], SequenceMatcher(None, "", lows[j]))
            matcher.set_seq1(a)
            insort(kept, (-(token + 0.5 * matcher.ratio()), j))
            del kept[k:]
        for score, j in kept:
            out[0].append(i), out[1].append(j), out[2].append(-score)


def _whole(batches):
    """The rows as tables that hold every bucket whole."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = pc.index(batch.column(0), batch.column(0)[-1]).as_py()
        if cut or held and held[-1].column(0)[-1] != batch.column(0)[0]:
            if held or cut:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)] if cut else held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
