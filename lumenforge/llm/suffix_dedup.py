"""Substring deduplication by suffix order and longest factors: every byte inside a long enough repeated string is removed.

Equal strings of ``LENGTH`` bytes choose the same anchor, the leftmost of their ``GRAM``-byte grams with
the least hash. So the windows of a text fall into runs of consecutive starts with one anchor, and
only runs that share an anchor can hold equal windows. Runs that are equal as a whole are counted and
stand once; the different runs of an anchor meet in one suffix order. Its previous and next smaller
positions give each start its longest earlier factor, its previous and next larger ones the longest
later one; a start repeats if either reaches ``LENGTH``. The runs of an anchor that are too many for one
suffix order part by what follows and precedes it, which is exact, as often as it takes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenforge.llm import bitmaps, vectext
from lumenforge.plans.lineage import discard, materialize
from lumenforge.plans.skew import join_groups

LENGTH, GRAM = 200, 40
CHUNK = 1 << 19  # starts looked at together; a longer text is cut into chunks that overlap by LENGTH
MEMBERS = 1024  # different runs of one suffix order; more part further
SUFFIX_BYTES = 400_000  # bytes of suffix orders solved together
SLICE = 500  # rows of a batch that are Python objects at once
DEPTHS = (7, 14, 28, 56, 112)  # prefix lengths of the ranks below LENGTH


def _least_in_window(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``keys[i : i + width]`` for every full window, by doubling."""
    span, out = 1, keys
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: first start, number of starts, anchor's hash, anchor's place in the run.

    ``data`` are bytes, ``bounds`` the bounds of the texts in it. Windows don't cross them.
    """
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    places = np.arange(n - gram + 1)
    grams = vectext.span_hashes(data, places, places + gram)
    keys = (grams & ~np.uint64(0xFFFFF)) | places.astype(np.uint64)  # n < 2**20: ties go to the leftmost
    anchor = (_least_in_window(keys, length - gram + 1) & np.uint64(0xFFFFF)).astype(np.int64)
    starts = np.arange(n - length + 1)
    ends = bounds[np.searchsorted(bounds, starts, "right")] if len(bounds) else np.full(len(starts), n)
    ok = starts + length <= ends
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~ok[:-1]
    first = np.flatnonzero(new & ok)
    last_of = np.append(np.flatnonzero(new | ~ok), len(starts))
    count = last_of[np.searchsorted(last_of, first, "right")] - first
    at = anchor[first]
    return first, count, grams[at], at - first


def chunks(raw: bytes, length: int = LENGTH):
    for begin in range(0, max(len(raw) - length + 1, 1), CHUNK):
        yield begin, raw[begin : begin + CHUNK + length - 1]


def prefix_ranks(data: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each start the ranks of its prefixes of ``DEPTHS`` and of ``length`` bytes in suffix order (shorter ones are padded).

    Prefix doubling: ranks of 7 bytes, then of 14, 28, ... from pairs of ranks, and at last of ``length``
    from two overlapping parts; equal ranks are equal strings, and ranks order as suffixes do.
    """
    out = [_first_ranks(data)]
    for depth, step in _steps(length):
        after = np.zeros(len(data), np.int64)
        after[: len(data) - step] = out[-1][step:]
        out.append(np.unique(out[-1] * (len(data) + 2) + after, return_inverse=True)[1].astype(np.int64) + 1)
    return out


def _first_ranks(data: np.ndarray) -> np.ndarray:
    n = len(data)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = data.astype(np.uint64) + np.uint64(1)
    # nine bits a byte keep the padding apart: seven bytes fit into 64 bits
    key = np.zeros(n, np.uint64)
    for i in range(DEPTHS[0]):
        key = (key << np.uint64(9)) | padded[i : i + n]
    return np.unique(key, return_inverse=True)[1].astype(np.int64) + 1


def _steps(length: int) -> list[tuple[int, int]]:
    """The depths that are reached in turn and how far behind the other part stands."""
    depth, out = DEPTHS[0], []
    while depth < length:
        step = min(depth, length - depth)
        depth += step
        out.append((depth, step))
    return out


def start_ranks(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The last of ``prefix_ranks`` at ``starts``, which have ``length`` bytes each, ranked at the places alone that it follows from."""
    steps = _steps(length)
    wanted = [starts]  # places whose rank each depth needs, the last depth first
    for _, step in reversed(steps):
        mark = np.zeros(len(data), bool)
        mark[wanted[-1]] = mark[wanted[-1] + step] = True
        wanted.append(np.flatnonzero(mark))
    rank = _first_ranks(data)
    for (_, step), places in zip(steps, reversed(wanted[:-1])):
        ranked = np.unique(rank[places] * (len(data) + 2) + rank[places + step], return_inverse=True)[1].astype(np.int64) + 1
        rank = np.zeros(len(data), np.int64)
        rank[places] = ranked
    return rank[starts]


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each place the last earlier place with a smaller value, or -1.

    Every place looks at the one before it; while that holds no smaller value it goes on to where that
    one looks, as nothing between is smaller. Places settle in a logarithmic number of rounds.
    """
    look = np.arange(-1, len(values) - 1)
    open_ = np.arange(len(values))
    while len(open_):
        at = look[open_]
        open_ = open_[(at >= 0) & (values[np.maximum(at, 0)] >= values[open_])]
        look[open_] = look[look[open_]]
    return look


def neighbours(order: np.ndarray) -> tuple[np.ndarray, ...]:
    """Previous and next smaller, previous and next larger positions: for each place of a suffix order that place, or -1."""
    n = len(order)
    turned = lambda values: np.where((t := smaller_before(values[::-1])[::-1]) < 0, -1, n - 1 - t)
    return smaller_before(order), turned(order), smaller_before(-order), turned(-order)


def common_prefixes(ranks: list[np.ndarray], data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Length of the common prefix of starts ``a`` and ``b``, at most ``length``: from the ranks downward, then byte by byte."""
    n = len(data)
    whole = ranks[-1][a] == ranks[-1][b]
    out = np.zeros(len(a), np.int64)
    for depth, rank in reversed(list(zip(DEPTHS, ranks))):
        x, y = a + out, b + out
        inside = (x < n) & (y < n)
        same = inside & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)])
        out += depth * same
    for _ in range(DEPTHS[0] - 1):
        x, y = a + out, b + out
        out += (x < n) & (y < n) & (data[np.minimum(x, n - 1)] == data[np.minimum(y, n - 1)])
    return np.where(whole, length, np.minimum(out, length))


def _factor_sides(starts: np.ndarray, rank: np.ndarray):
    """For the earlier and for the later factors of ``starts``, given in ascending order with their ranks: pairs of indices, a start and its neighbour.

    Of all earlier starts the previous or the next smaller position in suffix order shares most; of all later ones a larger one.
    """
    order = np.argsort(rank, kind="stable")
    sides = neighbours(order)
    for pair in (sides[:2], sides[2:]):
        yield [(order[at], order[side[at]]) for side in pair for at in (np.flatnonzero(side >= 0),)]


def longest_factors(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``starts`` (ascending) the longest prefix, up to ``length``, that an earlier one has as well, and that a later one has.

    The first is the longest-previous-factor array, the second the same for later starts.
    """
    ranks = prefix_ranks(data, length)
    out = []
    for sides in _factor_sides(starts, ranks[-1][starts]):
        most = np.zeros(len(starts), np.int64)
        for place, other in sides:
            most[place] = np.maximum(most[place], common_prefixes(ranks, data, starts[place], starts[other], length))
        out.append(most)
    return tuple(out)


def repeated_starts(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether the longest earlier or the longest later factor of each start reaches ``length``: its neighbour's prefix of that length has the same rank."""
    rank = start_ranks(data, starts, length)
    out = np.zeros(len(starts), bool)
    for sides in _factor_sides(starts, rank):
        for place, other in sides:
            out[place] |= rank[place] == rank[other]
    return out


def _batched(texts: list[bytes], most: int = 400_000):
    """Consecutive short texts together; a long one in overlapping chunks: (data, bounds, owners, offsets)."""
    part, owner, total = [], [], 0
    for i, raw in enumerate(texts):
        if len(raw) < LENGTH:
            continue
        if len(raw) > most:
            for begin, piece in chunks(raw):
                yield piece, np.array([0, len(piece)]), [i], [begin]
            continue
        if total + len(raw) > most:
            yield b"".join(part), np.cumsum([0, *map(len, part)]), owner, [0] * len(owner)
            part, owner, total = [], [], 0
        part.append(raw), owner.append(i)
        total += len(raw)
    if part:
        yield b"".join(part), np.cumsum([0, *map(len, part)]), owner, [0] * len(owner)


def _slices(batches):
    """Batches as columns of Python objects, a few rows at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            yield [c.to_pylist() for c in batch.slice(i, SLICE).columns]


def _digest(raw: bytes, place: int) -> bytes:
    """128 bits of a run's bytes and its anchor's place in it."""
    return hashlib.blake2b(raw, digest_size=16, salt=place.to_bytes(2, "little")).digest()


RUNS = "key binary, anchor binary, run binary, place long, at int"


def _runs(batches):
    """(key, text) to rows of anchor runs; a text that this task has read already adds nothing new."""
    seen = set()
    for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
        texts = [t or b"" for t in batch.column(1).to_pylist()]
        for i, k in enumerate(batch.column(0).to_pylist()):
            if k in seen:
                texts[i] = b""
            elif len(seen) < 200_000:
                seen.add(k)
        for raw, bounds, owner, offset in _batched(texts):
            first, count, anchor, at = anchors(np.frombuffer(raw, np.uint8), bounds)
            text = np.searchsorted(bounds, first, "right") - 1
            start = first - bounds[text] + np.array(offset)[text]
            run = [_digest(raw[s:e], a) for s, e, a in zip(first.tolist(), (first + count - 1 + LENGTH).tolist(), at.tolist())]
            gram = anchor.astype(">u8").tobytes()
            columns = [
                batch.column(0).take(pa.array(np.array(owner, np.int64)[text])), pa.array([gram[i : i + 8] for i in range(0, len(gram), 8)], pa.binary()),
                pa.array(run, pa.binary()), pa.array(start << 20 | count, pa.int64()), pa.array(at, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "anchor", "run", "place", "at"])


SEGMENTS = "anchor binary, run binary, key binary, place long, at int, bytes binary"


def _segments(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in SEGMENTS.split(", ")])


def _cut_segments(batches):
    """(key, text, wanted runs) to the bytes of each wanted run."""
    for columns in _slices(batches):
        for key, text, wanted in zip(*columns):
            yield _segments([(w["anchor"], w["run"], key, w["place"], w["at"], text[(s := w["place"] >> 20) : s + (w["place"] & 0xFFFFF) - 1 + LENGTH]) for w in wanted])


def cells(level: int) -> list[tuple[int, int]]:
    """The ranges of distances from a window's start to its anchor that ``level`` parts; the last level has one distance to a range."""
    spread = LENGTH - GRAM + 1
    parts = min(1 << level, spread)
    edges = [spread * i // parts for i in range(parts + 1)]
    return list(zip(edges[:-1], edges[1:]))


def _part_segments(level: int):
    """Segments to the parts of their runs by distance from the anchor; the new anchor is what all windows of a part's distances share."""

    def run(batches):
        for columns in _slices(batches):
            rows = []
            for _, _, key, place, at, raw in zip(*columns):
                start, count = place >> 20, place & 0xFFFFF
                for low, high in cells(level):
                    a, b = max(at - high + 1, 0), min(at - low + 1, count)  # starts of the part
                    if a < b:
                        shared = hashlib.blake2b(raw[at - low : at - high + 1 + LENGTH], digest_size=16, salt=low.to_bytes(2, "little")).digest()
                        own = raw[a : b - 1 + LENGTH]
                        rows.append((shared, _digest(own, at - a), key, (start + a) << 20 | (b - a), at - a, own))
                if len(rows) > 4000:
                    yield _segments(rows)
                    rows = []
            yield _segments(rows)

    return run


def _covered(starts: np.ndarray) -> list[tuple[int, int]]:
    """Sorted starts of repeated windows to the ranges of bytes that they cover."""
    new = np.concatenate([[True], starts[1:] > starts[:-1] + LENGTH])
    first = np.flatnonzero(new)
    return list(zip(starts[first].tolist(), (starts[np.append(first[1:], len(starts)) - 1] + LENGTH).tolist()))


RANGES = "key binary, begin long, end long"


def _repeats(batches):
    """Segments in order of anchor to ranges (key, begin, end) whose windows occur in another run of their anchor."""

    def solve(rows):
        data = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
        bounds = np.cumsum([0, *(len(r[2]) for r in rows)])
        inside = np.arange(len(data))
        starts = inside[inside + LENGTH <= bounds[np.searchsorted(bounds, inside, "right")]]
        hits = starts[repeated_starts(data, starts)]
        text = np.searchsorted(bounds, hits, "right") - 1
        cut = np.flatnonzero(np.diff(text, prepend=-1))
        out = []
        for t, own in zip(text[cut].tolist(), np.split(hits, cut[1:])) if len(hits) else ():
            begin = rows[t][1] >> 20
            out += [(rows[t][0], begin + a, begin + b) for a, b in _covered(own - bounds[t])]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.binary(), pa.int64(), pa.int64()))], ["key", "begin", "end"])

    held, group, last, size = [], [], None, 0
    for columns in _slices(batches):
        for anchor, key, place, raw in zip(*columns):
            if anchor != last:
                held += group
                group, last = [], anchor
                if size > SUFFIX_BYTES:
                    yield solve(held)
                    held, size = [], 0
            group.append((key, place, raw))
            size += len(raw)
    if held or group:
        yield solve(held + group)


def _remainders(batches):
    """(key, text, ranges) to the digest of what is left of the text."""
    for columns in _slices(batches):
        rows = []
        for key, raw, ranges in zip(*columns):
            kept, at, removed, spans = [], 0, 0, 0
            for begin, end in sorted((r["begin"], r["end"]) for r in ranges):
                if begin > at or not spans:
                    kept.append(raw[at:begin])
                    spans += 1
                    removed += end - begin
                else:
                    removed += max(end - at, 0)
                at = max(at, end)
            kept.append(raw[at:])
            rows.append((key, removed, spans, hashlib.sha256(b"".join(kept)).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.string()))], ["key", "n_removed", "n_spans", "kept_sha256"])


def _kinds(runs: DataFrame, carried: list[str]) -> DataFrame:
    """The different runs of each anchor, how often they stand and one of their places."""
    at = F.struct("key", "place", "at", *[c for c in carried if c == "bytes"])
    return runs.groupBy("anchor", "run").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("one"))


def _ends(place) -> list:
    begin = F.shiftright(place, 20)
    return [begin.alias("begin"), (begin + place.bitwiseAND(F.lit(0xFFFFF)) - 1 + LENGTH).alias("end")]


def repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, n_bytes, n_removed, n_spans, kept_sha256``.

    Removes each byte that a string of ``LENGTH`` bytes covers which also starts elsewhere in the corpus, the
    same text included; matches stay inside texts and are judged on the input.

    1. Anchor runs of all texts are counted by anchor; the anchors that occur once, most, end there.
    2. Runs with equal bytes repeat as a whole and stand once from there on. 3. Anchors with several
    different runs send the bytes of one run of each kind to a suffix order with the others of the
    anchor. 4. Where more than ``MEMBERS`` kinds share an anchor, their runs part by the distance of
    windows from the anchor, and meet again by all bytes that windows at those distances share: 120
    bytes where the distances are halved, then 160, and so on up to the whole window. 2 to 4 repeat on
    the parts; with one distance to a part only equal runs share an anchor, so it ends. Ranges then
    meet their texts again; only texts with a repeated anchor are fetched.

    Null counts as empty; texts shorter than ``LENGTH`` lose nothing; equal texts that are long enough
    lose everything. Ids may be null or repeat; other columns are not read. An empty table gives no rows. Texts
    go by 128 bits of their SHA-256, and texts that share those but not the rest stop the query; runs go by
    128 bits of BLAKE2b.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("sha", F.sha2("text", 256))
    rows = rows.withColumn("key", F.unhex(F.substring("sha", 1, 32)))
    meta = materialize(rows.select("id", "key", F.octet_length("text").cast("long").alias("n_bytes"), "sha"), "sa-meta")
    copies = meta.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("sha").alias("low"), F.max("sha").alias("high"))
    one_text = F.when(F.col("low") == F.col("high"), F.col("copies")).otherwise(F.raise_error(F.lit("different texts agree in 128 bits of SHA-256")))
    copies = materialize(copies.select("key", one_text.alias("copies")), "sa-copies")

    runs = materialize(rows.select("key", "text").mapInArrow(_runs, RUNS), "sa-runs")
    often = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # most runs have an anchor of their own and go before they are shuffled; the few that a full filter lets through are told apart below
    near = bitmaps.split_by_filter(runs.withColumnRenamed("anchor", "h"), materialize(bitmaps.key_filter(often.select(F.col("anchor").alias("h"))), "sa-often"))
    met = materialize(near.filter("again").withColumnRenamed("h", "anchor").drop("again"), "sa-met")
    discard(runs)
    kinds = materialize(_kinds(met, []), "sa-kinds")
    several = materialize(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "sa-several")
    twice = join_groups(met.select("anchor", "run", "key", "place"), kinds.filter("n > 1").select("anchor", "run", "n"), ["anchor", "run"], "n", met.count(), "left_semi")
    ranges = [materialize(twice.select("key", *_ends(F.col("place"))), "sa-whole")]
    discard(met)
    wanted = join_groups(kinds, several, ["anchor"], "kinds", kinds.count(), "left_semi").select("anchor", "run", "one.*")
    asked = materialize(wanted.groupBy("key").agg(F.collect_list(F.struct("anchor", "run", "place", "at")).alias("wanted")), "sa-asked")
    # every text in which something repeats, once: equal texts are combined before the shuffle
    need = materialize(ranges[0].select("key").union(asked.select("key")).distinct().join(asked, "key", "left"), "sa-need")
    fetched = bitmaps.split_by_filter(rows.select(F.col("key").alias("h"), "text"), materialize(bitmaps.key_filter(need.select(F.col("key").alias("h"))), "sa-needed")).filter("again")
    texts = materialize(fetched.groupBy(F.col("h").alias("key")).agg(F.first("text").alias("text")).join(need, "key"), "sa-texts")
    discard(asked, need)
    segments = materialize(texts.filter("wanted is not null").mapInArrow(_cut_segments, SEGMENTS), "sa-segments")
    level = 0
    while True:
        total = segments.count()
        few = join_groups(segments, several.filter(F.col("kinds") <= MEMBERS), ["anchor"], "kinds", total, "left_semi").select("anchor", "key", "place", "bytes")
        ranges.append(few.repartition(tasks, "anchor").sortWithinPartitions("anchor", "key", "place").mapInArrow(_repeats, RANGES))
        many = several.filter(F.col("kinds") > MEMBERS)
        if many.isEmpty():
            break
        level += 1
        parts = join_groups(segments, many, ["anchor"], "kinds", total, "left_semi").select(*[c.split()[0] for c in SEGMENTS.split(", ")])
        parts = materialize(parts.mapInArrow(_part_segments(level), SEGMENTS), "sa-parts")
        kinds = materialize(_kinds(parts, ["bytes"]), "sa-kinds")
        again = join_groups(parts.select("anchor", "run", "key", "place"), kinds.filter("n > 1").select("anchor", "run", "n"), ["anchor", "run"], "n", parts.count(), "left_semi")
        ranges.append(again.select("key", *_ends(F.col("place"))))
        several = materialize(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "sa-several")
        segments = join_groups(kinds, several, ["anchor"], "kinds", kinds.count(), "left_semi").select("anchor", "run", "one.*")
        segments = materialize(segments.select(*[c.split()[0] for c in SEGMENTS.split(", ")]), "sa-segments")
    found = ranges[0]
    for more in ranges[1:]:
        found = found.unionByName(more)
    found = found.groupBy("key").agg(F.collect_set(F.struct("begin", "end")).alias("ranges"))
    left = texts.select("key", "text").join(found, "key").mapInArrow(_remainders, "key binary, n_removed long, n_spans long, kept_sha256 string")
    out = join_groups(meta, copies, ["key"], "copies", meta.count()).join(left, "key", "left")
    everything = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    none = F.lit(0).cast("long")
    return out.select(
        F.col("id").alias(id_col), "n_bytes",
        F.when(everything, F.col("n_bytes")).otherwise(F.coalesce("n_removed", none)).alias("n_removed"),
        F.when(everything, none + 1).otherwise(F.coalesce("n_spans", none)).alias("n_spans"),
        F.when(everything, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
