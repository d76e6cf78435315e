"""All pairs of two sides as blocks of bounded size, scored by products of token matrices.

Where the result is itself a row for every unit and other paper, there is nothing to prune. Pairs then
never exist as rows: both sides are dealt into parts of about BLOCK rows, each two parts meet in one
task as two small tables, and what leaves it is chosen there.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lumenforge.plans.lineage import materialize
from lumenforge.plans.skew import join_groups

BLOCK = 512
WIDE = 16
DENSE = 1000  # pairs of rows that share a word, from which on it is a column of a matrix product


def number_words(rows: DataFrame, key: str, words: Column) -> DataFrame:
    """``key, words``: each row's distinct words as numbers of a vocabulary of all rows; a list without words stays empty.

    Words are numbered once and meet their rows by ``join_groups``, as a common word stands in most rows.
    """
    spread = materialize(rows.select(key, F.explode(words).alias("word")), "words")
    vocabulary = materialize(spread.groupBy("word").agg(F.count(F.lit(1)).alias("n")).withColumn("number", F.monotonically_increasing_id()), "vocabulary")
    lists = join_groups(spread, vocabulary, ["word"], "n", spread.count()).groupBy(key).agg(F.collect_list("number").alias("words"))
    return rows.select(key).join(lists, key, "left").select(key, F.coalesce("words", F.array().cast("array<long>")).alias("words"))


def meet(left: DataFrame, right: DataFrame, group: list[str], left_key: list[str], right_key: list[str], solve: Callable, schema: str, block: int | None = None, mirrored: bool = False, together: int | None = None) -> DataFrame:
    """``solve(part of left, part of right)``, a table or several one after another, for each two parts that agree in ``group``.

    Rows with equal ``left_key`` (``right_key``) stand in one part. Parts hold about ``block`` rows, more only
    where a key has more. The number of parts follows from the counts of each group. Parts without rows on one side give none.
    Up to ``together`` parts (``WIDE``) are shipped together and meet one by one in their task, which yields what they give at once.
    ``mirrored``: both sides are one table with one key, and each two parts, and each part with itself, meet once.
    """
    block, together = block or BLOCK, together or WIDE
    names = to_arrow_schema(StructType.fromDDL(schema))
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def parts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))

    # few wide parts are shipped, but enough that every task has some meetings
    wide = lambda n: F.least(F.col(n), F.greatest(F.ceil(F.col(n) / together), F.lit(ceil(2 * sqrt(tasks))))).cast("int")
    counts = parts(left, "_left").join(parts(right, "_right"), group).withColumns({"_l": wide("_left"), "_r": wide("_right"), "_group": F.monotonically_increasing_id()})
    counts = materialize(counts, "block-counts")

    def dealt(df: DataFrame, key: list[str], side: int) -> DataFrame:
        fine, own, other = ("_left", "_l", "_r") if side == 0 else ("_right", "_r", "_l")
        fresh = df.select(*[F.col(c).alias(c) for c in df.columns])  # both sides may be one table
        x = fresh.join(counts, group).withColumn("_fine", F.pmod(F.xxhash64(*key), F.col(fine)).cast("int"))
        data = [F.struct(*df.columns) if i == side else F.lit(None).cast(t.schema) for i, t in enumerate((left, right))]
        x = x.select("_group", data[0].alias("_a"), data[1].alias("_b"), "_fine", (F.col("_fine") % F.col(own)).alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other))
        x = x.filter("_l <= _r") if mirrored else x
        return x.select("_group", "_l", "_r", F.lit(side).alias("_side"), "_fine", "_a", "_b")

    def solved(batches):
        for table in _meetings(batches):
            sides = [_tiles(table.filter(pc.equal(table["_side"], i)), c) for i, c in enumerate(("_a", "_b"))]
            within = mirrored and table["_l"][0] == table["_r"][0]  # the same parts in the same order on both sides
            for i, a in enumerate(sides[0]):
                for b in sides[1][i if within else 0 :]:
                    out = solve(a, b)
                    for piece in [out] if isinstance(out, pa.Table) else out:
                        yield from piece.select(names.names).cast(names).to_batches(max_chunksize=65_536)

    both = dealt(left, left_key, 0).unionByName(dealt(right, right_key, 1))
    keys = ["_group", "_l", "_r"]
    return both.repartition(tasks, *keys).sortWithinPartitions(*keys, "_side", "_fine").mapInArrow(solved, schema)


def _meetings(batches):
    """The rows of each two wide parts, which follow one another, as a table."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            key = keys[:, a].tolist()
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _tiles(table: pa.Table, side: str) -> list[pa.Table]:
    """The rows of one side as a table for each part of about a block."""
    if not table.num_rows:
        return []
    fine = table["_fine"].to_numpy()
    data = table[side].combine_chunks()
    data = pa.concat_arrays(data.chunks) if isinstance(data, pa.ChunkedArray) else data
    rows = pa.Table.from_arrays(data.flatten(), names=[f.name for f in data.type])
    cuts = [0, *(np.flatnonzero(fine[1:] != fine[:-1]) + 1).tolist(), len(fine)]
    return [rows.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:])]


def with_chunks(rows: DataFrame, group: list[str], unit: str) -> DataFrame:
    """Add ``chunk`` and ``chunks``: groups of more than BLOCK rows are dealt by ``unit`` over chunks of about BLOCK rows, all others are one chunk.

    ``rows`` is read several times: pass a written table. Where no group is large nothing is joined.
    """
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > BLOCK).withColumn("chunks", F.ceil(F.col("_n") / BLOCK).cast("int"))
    sizes = materialize(sizes, "chunks")
    if sizes.isEmpty():
        return rows.withColumns({"chunks": F.lit(1), "chunk": F.lit(0)})
    met = join_groups(rows, sizes, group, "_n", rows.count(), "left").drop("_n").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    return met.withColumn("chunk", F.pmod(F.xxhash64(unit), F.col("chunks")).cast("int"))


def lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column in one array and the bounds of each list."""
    array = column.combine_chunks()
    array = pa.concat_arrays(array.chunks) if isinstance(array, pa.ChunkedArray) else array
    offsets = array.offsets.to_numpy()
    return array.values.to_numpy(zero_copy_only=False), offsets


def shared_counts(left: pa.ChunkedArray, right: pa.ChunkedArray, room: int = 8_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many numbers each list of ``left`` shares with each of ``right``, and the sizes of both sides' lists.

    Numbers that many pairs share are columns of a product of matrices; pairs that share one of the others are counted one by one.
    """
    (a, ab), (b, bb) = lists(left), lists(right)
    n, m = len(ab) - 1, len(bb) - 1
    sizes_a, sizes_b = np.diff(ab), np.diff(bb)
    out = np.zeros((n, m), np.float32)
    a, b = a[ab[0] : ab[-1]], b[bb[0] : bb[-1]]
    # words of both sides, numbered; np.unique sorts each side once
    (va, at_a, n_a), (vb, at_b, n_b) = (np.unique(x, return_inverse=True, return_counts=True) for x in (a, b))
    both, in_a, in_b = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    if len(both):
        pairs = n_a[in_a] * n_b[in_b]
        common = pairs > DENSE
        own = [np.repeat(np.arange(k), s) for k, s in ((n, sizes_a), (m, sizes_b))]
        hits = []
        for at, values, at_both in ((at_a, va, in_a), (at_b, vb, in_b)):
            place = np.full(len(values), -1)
            place[at_both[common]] = np.arange(common.sum())
            place[at_both[~common]] = -2 - np.arange((~common).sum())
            hits.append(place[at])
        width = max(1, room // (n + m))
        for low in range(0, int(common.sum()), width):
            sides = []
            for k, rows in enumerate((n, m)):
                ok = (hits[k] >= low) & (hits[k] < low + width)
                side = np.zeros((rows, min(width, int(common.sum()) - low)), np.float32)
                side[own[k][ok], hits[k][ok] - low] = 1
                sides.append(side)
            out += sides[0] @ sides[1].T
        # each row of a rare word on the left meets the few on the right
        rare = [(hits[k] <= -2).nonzero()[0] for k in (0, 1)]
        if len(rare[0]):
            word = [-2 - hits[k][rare[k]] for k in (0, 1)]
            order = np.argsort(word[1], kind="stable")
            rows_b, first = own[1][rare[1]][order], np.searchsorted(word[1][order], np.arange((~common).sum() + 1))
            for low, high in _pieces(np.diff(first)[word[0]], room):
                w = word[0][low:high]
                many = np.diff(first)[w]
                j = rows_b[np.repeat(first[w], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                i = np.repeat(own[0][rare[0][low:high]], many)
                out += np.bincount(i * m + j, minlength=n * m).reshape(n, m)
    return out.astype(np.int64), sizes_a.astype(np.int64), sizes_b.astype(np.int64)


def _pieces(sizes: np.ndarray, room: int):
    """Ranges of ``sizes`` that add up to about ``room`` each."""
    total = np.cumsum(sizes)
    cuts = np.unique([0, *np.searchsorted(total, np.arange(room, total[-1], room), "right"), len(sizes)])
    return zip(cuts[:-1].tolist(), cuts[1:].tolist())


def jaccard(shared: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the unions and shares of them; 0 where both are empty."""
    total = sizes_a[:, None] + sizes_b[None, :] - shared
    return total, np.divide(shared, total, out=np.zeros(shared.shape), where=total > 0)
