"""Near-duplicate join on word shingles: MinHash bands, Bayesian pruning, exact Jaccard of what is left."""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenforge.llm import bitmaps, vectext
from lumenforge.operators.components import connected_components
from lumenforge.plans.lineage import materialize
from lumenforge.plans.skew import join_groups

WORDS, THRESHOLD = 5, 0.8
HASHES, ROWS = 128, 4  # a pair at 0.8 shares none of the 32 bands of 4 with probability 5e-8
BANDS = HASHES // ROWS
BLOCK = 1024
BYTES = 48_000_000
TOLERANCE = 1e-6
STEPS = (32, 64, 96, 128)
_MULTIPLIERS = vectext.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the different word shingles of each text.

    Words are what white space parts, in lower case. A text of fewer words than a shingle is one
    shingle; a text without words has none.
    """
    out: list[np.ndarray] = []
    factors = vectext.mix(np.arange(11, 11 + words, dtype=np.uint64)) | np.uint64(1)
    for begin, end in vectext.pieces(texts, 400_000):
        _, cp, bounds = vectext.codepoints([t.lower() for t in texts[begin:end]])
        if not len(cp):
            out += [np.zeros(0, np.uint64)] * (end - begin)
            continue
        starts, ends = vectext.runs((vectext.classes(cp) & vectext.SPACE) == 0, bounds)
        hashes = vectext.span_hashes(cp, starts, ends)
        at = np.searchsorted(starts, bounds)
        n = max(len(hashes) - words + 1, 0)
        joined = np.zeros(n, np.uint64)
        for i in range(words):
            joined += hashes[i : i + n] * factors[i]
        joined = vectext.mix(joined)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= words:
                out.append(np.unique(joined[a : b - words + 1]))
            elif b > a:
                out.append(vectext.mix((hashes[a:b] * factors[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The upper halves of the minima of 128 multiplicative hashes."""
    least = np.full(HASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[i : i + 2048, None] * _MULTIPLIERS).min(0), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest equal values among ``n`` at which P(Jaccard >= threshold) still reaches ``tolerance``.

    With a uniform prior the posterior after m of n is Beta(m + 1, n - m + 1), whose upper tail is
    that of a binomial: P(J >= t) = P(Bin(n + 1, t) <= m).
    """
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def surviving(sigs: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which pairs (i, j) stay after each further 32 values of their signatures."""
    alive = np.arange(len(i))
    matches = np.zeros(len(i), np.int32)
    done = 0
    for n in STEPS:
        matches = matches + (sigs[i[alive], done:n] == sigs[j[alive], done:n]).sum(1, dtype=np.int32)
        keep = matches >= least_matches(n, threshold)
        alive, matches, done = alive[keep], matches[keep], n
    return alive


def local_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index connected to each of ``n`` nodes."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _blocks(batches, key_columns: int):
    """Consecutive rows with equal leading columns, as lists of columns."""
    held, last = None, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            key = row[:key_columns]
            if key != last:
                if held:
                    yield last, held
                held, last = [], key
            held.append(row[key_columns:])
    if held:
        yield last, held


def first_meetings(side: np.ndarray, low: int, high: int, band: int, sigs: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block's nodes that share ``band``, no band before it, and outlive the pruning.

    A block holds part ``low`` and part ``high`` of a bucket; ``side`` is each node's part.
    """
    bands = sigs.view("<u8").reshape(len(sigs), BANDS, ROWS // 2)
    left, right = np.flatnonzero(side == low), np.flatnonzero(side == high)
    out_i, out_j = [], []
    for a in left.tolist():
        others = right[right > a] if low == high else right
        if not len(others):
            continue
        equal = (bands[others, : band + 1] == bands[a, : band + 1]).all(2)
        others = others[equal[:, band] & ~equal[:, :band].any(1)]
        if len(others):
            i = np.full(len(others), a)
            ok = surviving(sigs, i, others, threshold)
            out_i.append(i[ok]), out_j.append(others[ok])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_i]), np.concatenate([none, *out_j])


MEMBERS = "bucket long, low long, high long, node long, part long, band int"


def _candidates(batches, threshold: float):
    """Rows (bucket, low, high, node, part, band, sig) to those, without signature, whose node has a surviving first meeting in its block."""
    for (bucket, low, high), rows in _blocks(batches, 3):
        band = rows[0][2]
        i, j = first_meetings(np.array([r[1] for r in rows]), low, high, band, np.frombuffer(b"".join(r[3] for r in rows), "<u4").reshape(-1, HASHES), threshold)
        hit = np.union1d(i, j).tolist()
        if hit:
            n = len(hit)
            columns = ([bucket] * n, [low] * n, [high] * n, [rows[x][0] for x in hit], [rows[x][1] for x in hit])
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array([band] * n, pa.int32())], [c.split()[0] for c in MEMBERS.split(", ")])
    vectext.trim()


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 blocks over shingles that two sets share."""
    n = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1
    number, owner = number[shared], owner[shared]
    out = np.zeros((n, n), np.float32)
    if len(number):
        number = np.unique(number, return_inverse=True)[1]
        width = max(1, 4_000_000 // n)
        bounds = np.searchsorted(number, np.arange(0, number[-1] + width + 1, width))
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            if b > a:
                block = np.zeros((n, width), np.float32)
                block[owner[a:b], number[a:b] - k * width] = 1
                out += block @ block.T
    return out


def _verify(batches, threshold: float):
    """Per block the exact similarity of its surviving first meetings: each node's number of links and its root among them."""
    for (_, low, high), rows in _blocks(batches, 3):
        i, j = first_meetings(np.array([r[1] for r in rows]), low, high, rows[0][2], np.frombuffer(b"".join(r[3] for r in rows), "<u4").reshape(-1, HASHES), threshold)
        if not len(i):
            continue
        sets = [np.frombuffer(r[4], np.uint64) for r in rows]
        sizes = np.array([len(s) for s in sets], np.float64)
        common = _overlaps(sets)[i, j].astype(np.float64)
        # common / union >= threshold, without dividing
        ok = (common >= threshold * (sizes[i] + sizes[j] - common) - 1e-9) & (common > 0)
        i, j = i[ok], j[ok]
        links = np.bincount(i, minlength=len(rows)) + np.bincount(j, minlength=len(rows))
        root = local_components(len(rows), i, j)
        hit = np.flatnonzero(links).tolist()
        if hit:
            yield pa.RecordBatch.from_arrays([pa.array([rows[x][0] for x in hit], pa.int64()), pa.array([rows[root[x]][0] for x in hit], pa.int64()), pa.array(links[hit], pa.int64())], ["node", "root", "links"])
    vectext.trim()


def _sides(parts: Column, own: Column) -> Column:
    """The block pairs that part ``own`` of ``parts`` takes part in."""
    return F.explode(F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda other: F.struct(F.least(own, other).alias("low"), F.greatest(own, other).alias("high"))))


def _text_key(text: Column) -> Column:
    """128 bits of the text's SHA-256; null counts as empty."""
    return F.unhex(F.substring(F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256), 1, 32))


def _sketch(batches):
    """(id, text_key, text) to sketches, without the text."""
    vectext.release()
    for batch in batches:
        for k in range(0, batch.num_rows, 1000):
            part = batch.slice(k, 1000)
            sets = shingle_sets([t or "" for t in part.column(2).to_pylist()])
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())], ["id", "text_key", "set_key", "sig", "n"])
    vectext.trim()


def _shingles(batches):
    """(node, text) to (node, shingles), 64 bits to each."""
    for batch in batches:
        for k in range(0, batch.num_rows, 1000):
            part = batch.slice(k, 1000)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1).to_pylist())], pa.binary())], ["node", "shingles"])
    vectext.trim()


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Rows as ``id, text_key, set_key`` and, for each set of shingles, ``set_key, node, class, min_id, n_copies, n_links``; both are tables."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), _text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    sketches = materialize(rows.mapInArrow(_sketch, "id long, text_key binary, set_key binary, sig binary, n long"), "sketches")
    nodes = sketches.filter("set_key is not null").groupBy("set_key").agg(F.min("id").alias("min_id"), F.count(F.lit(1)).alias("n_copies"), F.min("text_key").alias("text_key"), F.min("sig").alias("sig"), F.min("n").alias("n"))
    # numbers are fixed by writing them; no result depends on which node has which
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    band = lambda i: F.xxhash64(F.substring("sig", 16 * i + 1, 16), F.lit(i))
    bands = nodes.select("node", "n", F.posexplode(F.array(*map(band, range(BANDS)))).alias("band", "bucket"))
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles")).filter("size > 1")
    # a part holds about BLOCK nodes and BYTES of shingles, so a block of long texts is as large as one of short ones
    parts = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") * 8 / BYTES))
    shared = shared.withColumn("parts", parts).drop("shingles")
    members = bands.drop("n").join(shared, "bucket").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    members = members.join(nodes.select("node", "sig"), "node").select("bucket", "band", "node", "part", "sig", _sides(F.col("parts"), F.col("part")).alias("b"))
    members = members.select("bucket", F.col("b.low").alias("low"), F.col("b.high").alias("high"), "node", "part", "band", "sig")
    block = ["bucket", "low", "high"]
    met = members.repartition(tasks, *block).sortWithinPartitions(*block, "node").mapInArrow(lambda batches: _candidates(batches, threshold), MEMBERS)
    met = materialize(met, "candidates")

    wanted = materialize(met.select("node").distinct().join(nodes.select("node", "text_key"), "node"), "wanted")
    near = bitmaps.split_by_filter(rows.select("text_key", "text").withColumnRenamed("text_key", "h"), bitmaps.key_filter(wanted.select(F.col("text_key").alias("h")))).filter("again")
    texts = near.groupBy(F.col("h").alias("text_key")).agg(F.first("text").alias("text")).join(wanted, "text_key").select("node", "text")
    sets = materialize(texts.mapInArrow(_shingles, "node long, shingles binary"), "shingles")
    blocks = met.join(nodes.select("node", "sig"), "node").join(sets, "node").select(*block, "node", "part", "band", "sig", "shingles")
    links = blocks.repartition(tasks, *block).sortWithinPartitions(*block, "node").mapInArrow(lambda batches: _verify(batches, threshold), "node long, root long, links long")
    links = materialize(links, "links")
    parts = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    found = nodes.select("set_key", "node", "min_id", "n_copies").join(counts, "node", "left").join(parts, "node", "left")
    found = found.select("set_key", "node", F.coalesce("component", "node").alias("class"), "min_id", "n_copies", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"))
    return sketches.select("id", "text_key", "set_key"), materialize(found, "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``id, class_id, copy_id, n_copies, n_links``.

    ``copy_id`` is the smallest id with an equal shingle set, ``n_copies`` how many rows have it; ``n_links`` counts
    the other sets whose Jaccard similarity is at least ``threshold``; ``class_id`` is the smallest id that
    such links lead to. Ids are integers.

    1. Rows with equal sets become one node, so thousands of copies cost one. 2. Nodes that agree in a
    band of four MinHash values meet in its bucket. Buckets of over 1024 nodes or 48 MB of shingles are cut into parts,
    and every pair of parts is a block of its own. A pair is looked at where it meets first: after 32,
    64, 96 and 128 values it is dropped once P(similarity >= threshold) falls below 1e-6. What leaves a
    block are its nodes with a pair left, not the pairs. 3. The shingles of those nodes go to the blocks
    in which they have such a pair, and the pairs that are left, and no others, are verified by
    exact intersection there. Each pair counts in one block.

    Null and empty texts have no shingles: a class of their own each, without links. Rows are told apart
    by content: repeated ids with different texts are different nodes, rows with null ids are linked and
    counted like others, and a class or set of null ids alone has null for its smallest id. Other
    columns are not read. An empty table gives no rows.
    """
    rows, found = _classes(docs, id_col, text_col, threshold)
    smallest = materialize(found.groupBy("class").agg(F.min("min_id").alias("class_id"), F.count(F.lit(1)).alias("nodes")), "smallest")
    table = join_groups(found, smallest, ["class"], "nodes", found.count()).select("set_key", "class_id", F.col("min_id").alias("copy_id"), "n_copies", "n_links")
    table = materialize(table, "verdicts")
    empty, one = rows.filter("set_key is null"), F.lit(1).cast("long")
    out = join_groups(rows.filter("set_key is not null"), table, ["set_key"], "n_copies", rows.count()).select("id", "class_id", "copy_id", "n_copies", "n_links")
    out = out.unionByName(empty.select("id", F.col("id").alias("class_id"), F.col("id").alias("copy_id"), one.alias("n_copies"), (one - 1).alias("n_links")))
    return out.withColumnRenamed("id", id_col)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, whole and with their own columns; one of each class of near copies.

    The row with the smallest id stays, one with a null id only where all are null; ties go by the text's
    digest, then by the other columns. Texts without words are no copies of anything and all stay.
    Rows whose text is in no class of several rows pass without a shuffle. Columns may have any name; an
    empty table gives no rows.
    """
    rows, found = _classes(docs, id_col, text_col, threshold)
    sizes = found.groupBy("class").agg(F.sum("n_copies").alias("rows")).filter("rows > 1").select("class")
    found = materialize(found.join(sizes, "class").select("set_key", "class", "n_copies"), "several")
    affected = join_groups(rows.filter("set_key is not null"), found, ["set_key"], "n_copies", rows.count())
    ident = F.coalesce(F.col("id").cast("string"), F.lit(""))
    affected = materialize(affected.select("class", ident.alias("ident"), "text_key", F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key").alias("order")), "affected")
    stays = materialize(affected.groupBy("class").agg(F.min("order").alias("first"), F.count(F.lit(1)).alias("n")), "stays")
    verdicts = join_groups(affected, stays, ["class"], "n", affected.count()).groupBy("ident", "text_key").agg(F.max(F.col("order") == F.col("first")).alias("stays"))
    names = [f"_{i}" for i in range(len(docs.columns))]
    own_id, own_text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    whole = docs.toDF(*names).withColumn("h", _text_key(F.col(own_text)))
    whole = bitmaps.split_by_filter(whole, materialize(bitmaps.key_filter(affected.select(F.col("text_key").alias("h"))), "affected-bits"))
    asked = whole.filter("again").withColumn("ident", F.coalesce(F.col(own_id).cast("long").cast("string"), F.lit(""))).withColumnRenamed("h", "text_key")
    judged = asked.join(verdicts, ["ident", "text_key"], "left")
    others = judged.filter("stays is null").select(*names)
    order = F.xxhash64(F.to_json(F.struct(*[c for c in names if c != own_text])))
    chosen = judged.filter("stays").groupBy("ident", "text_key").agg(F.min_by(F.struct(*names), order).alias("row")).select("row.*")
    return whole.filter(~F.col("again")).select(*names).unionByName(others).unionByName(chosen).toDF(*docs.columns)
