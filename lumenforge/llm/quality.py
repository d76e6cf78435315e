"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with a calibrated temperature."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenforge.llm import vectext
from lumenforge.llm.langid import held_out

ROWS, DIMS, MARKS, REACH, SEED = 1 << 16, 32, 4, 2, 12
LONGEST = 64
PART = 200_000  # tokens whose vectors are in memory together


def index_vectors() -> np.ndarray:
    """The index vector of each row: ``MARKS`` places of ``DIMS`` hold 1 or -1, the rest 0."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((ROWS, DIMS), np.float32)
    places = rng.random((ROWS, DIMS)).argsort(1)[:, :MARKS]
    out[np.arange(ROWS)[:, None], places] = rng.choice([-1, 1], (ROWS, MARKS))
    return out


def tokens(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For parts ``begin, end`` of ``texts``: the row of each token and the bounds of each text's tokens.

    Tokens are runs of letters, digits and ``_``, and runs of other marks, in pieces of at most ``LONGEST``; case counts. A token's row
    is its hash, so the table of word vectors has the same size whatever the vocabulary.
    """
    for begin, end in vectext.pieces(texts):
        _, cp, bounds = vectext.codepoints(texts[begin:end])
        kind = vectext.classes(cp) if len(cp) else np.zeros(0, np.uint8)
        word = ((kind & (vectext.WORD | vectext.NUMBER)) > 0) | (cp == ord("_"))
        (a, b), (c, d) = vectext.runs(word, bounds), vectext.runs(~word & ((kind & vectext.SPACE) == 0), bounds)
        starts, ends = np.concatenate([a, c]), np.concatenate([b, d])
        order = starts.argsort(kind="stable")
        starts, ends = starts[order], ends[order]
        parts = -(-(ends - starts) // LONGEST)
        if len(parts) and parts.max() > 1:
            number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            starts, ends = np.repeat(starts, parts) + number * LONGEST, np.repeat(ends, parts)
            ends = np.minimum(ends, starts + LONGEST)
        rows = (vectext.span_hashes(cp, starts, ends) % np.uint64(ROWS)).astype(np.int64) if len(starts) else np.zeros(0, np.int64)
        yield begin, end, rows, np.searchsorted(starts, bounds)


def context_sums(rows: np.ndarray, bounds: np.ndarray, index: np.ndarray, into: np.ndarray) -> None:
    """Add to ``into`` at each token's row the index vectors of the ``REACH`` tokens before and after it in its text."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for low in range(0, len(rows), PART):
        high = min(low + PART, len(rows))
        near = np.zeros((high - low, DIMS), np.float32)
        for step in (s for s in range(-REACH, REACH + 1) if s):
            at = np.arange(max(low, -step, 0), min(high, len(rows) - step))
            at = at[text[at] == text[at + step]]
            near[at - low] += index[rows[at + step]]
        order = rows[low:high].argsort(kind="stable")
        own = rows[low:high][order]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        into[own[first]] += np.add.reduceat(near[order], first, axis=0).astype(np.int32)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The word vectors of all texts: per row the sum of the index vectors around its tokens, without the mean direction, of length 1.

    Each task adds up its own texts and emits one row for each row of the table that it met; Spark sums those. The driver gets the
    table alone, ``ROWS`` by ``DIMS`` whatever the input. Rows that no token has stay zero.
    """
    names = [f"_{i}" for i in range(DIMS)]

    def run(batches):
        index, sums = index_vectors(), np.zeros((ROWS, DIMS), np.int32)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for _, _, rows, bounds in tokens(texts):
                if len(rows):
                    context_sums(rows, bounds, index, sums)
        met = np.flatnonzero(sums.any(1))
        if len(met):
            yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), *[pa.array(sums[met, i]) for i in range(DIMS)]], names=["row", *names])

    partial = docs.select(F.col(text_col).alias("text")).mapInArrow(run, ", ".join(["row int", *[f"{n} int" for n in names]]))
    found = partial.groupBy("row").agg(*[F.sum(n).cast("double").alias(n) for n in names]).toArrow()
    table = np.zeros((ROWS, DIMS))
    if found.num_rows:
        table[found["row"].to_numpy()] = np.column_stack([found[n].to_numpy() for n in names])
    return unit_rows(table)


def unit_rows(table: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(table, axis=1, keepdims=True)
    out = np.divide(table, length, out=np.zeros_like(table), where=length > 0)
    used = length[:, 0] > 0
    if used.any():
        out[used] -= out[used].mean(0)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=np.zeros_like(out), where=length > 1e-12).astype(np.float32)


FEATURES = 2 * DIMS + 3


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """Per text the mean and the spread of its tokens' vectors in each dimension, the length of the mean, the share of different tokens and the log of their number."""
    out = np.zeros((len(texts), FEATURES))
    for begin, end, rows, bounds in tokens(texts):
        n = np.diff(bounds)
        total, square = np.zeros((end - begin, DIMS)), np.zeros((end - begin, DIMS))
        text = np.repeat(np.arange(end - begin), n)
        for low in range(0, len(rows), PART):
            v, own = vectors[rows[low : low + PART]], text[low : low + PART]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            total[own[first]] += np.add.reduceat(v, first, axis=0)
            square[own[first]] += np.add.reduceat(v * v, first, axis=0)
        some = np.maximum(n, 1)[:, None]
        mean = total / some
        kinds = np.bincount(np.unique(text * ROWS + rows) // ROWS, minlength=end - begin) if len(rows) else np.zeros(end - begin)
        out[begin:end] = np.column_stack([mean, np.sqrt(np.maximum(square / some - mean**2, 0)), np.linalg.norm(mean, axis=1), kinds / some[:, 0], np.log1p(n)])
    return out


@dataclass
class Network:
    """Inputs are scaled by ``centre`` and ``scale``; tanh layer, linear output, divided by ``temperature``."""

    centre: np.ndarray
    scale: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    outer_bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.inner + self.inner_bias) @ self.outer + self.outer_bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, rounds: int = 1500, rate: float = 0.01, decay: float = 1e-3) -> Network:
    """Fit the two layers by Adam on the mean cross-entropy of all rows. A single class gives a network of its prior alone."""
    rng = np.random.default_rng(SEED)
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - centre) / scale
    share = (y.sum() + 1) / (len(y) + 2)
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), np.zeros(hidden), np.array(np.log(share / (1 - share)))]
    w[2] = rng.normal(0, 0.1, hidden)
    first, second = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
    if len(np.unique(y)) < 2:
        w[2], rounds = np.zeros(hidden), 0
    for t in range(1, rounds + 1):
        inner = np.tanh(z @ w[0] + w[1])
        p = 1 / (1 + np.exp(-np.clip(inner @ w[2] + w[3], -30, 30)))
        error = (p - y) / len(y)
        back = np.outer(error, w[2]) * (1 - inner**2)
        slopes = [z.T @ back + decay * w[0], back.sum(0), inner.T @ error + decay * w[2], error.sum()]
        step = rate * 0.5 * (1 + np.cos(np.pi * t / rounds))
        for i, g in enumerate(slopes):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            w[i] = w[i] - step * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return Network(centre, scale, w[0], w[1], w[2], float(w[3]))


def calibrate(network: Network, x: np.ndarray, y: np.ndarray) -> None:
    """The temperature in 0.1 to 10 with the least cross-entropy on rows that the network was not fitted to."""
    if not len(y):
        return
    logits = network.logits(x)
    loss = lambda t: np.logaddexp(0, np.where(y > 0.5, -1, 1) * logits / t).mean()
    network.temperature = float(min(np.geomspace(0.1, 10, 200), key=loss))


def _features(docs: DataFrame, vectors, text_col: str):
    """The rows of ``docs`` as Arrow batches with their pooled features behind them."""
    place = docs.columns.index(text_col)

    def run(batches, made):
        table = vectors.value
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                yield made(part, pooled([t or "" for t in part.column(place).to_pylist()], table))

    return run


def fit(docs: DataFrame, labels: DataFrame, vectors, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 20_000) -> Network | None:
    """Learn from labelled rows that are not held out: the ``most`` ids with the smallest hashes; every fifth calibrates.

    Labels are counted by 4096 ranges of the hash and taken up to the range that fills ``most``, so only those ranges are ranked. Chosen ids, ``most`` at most,
    are broadcast to the documents, and each row's pooled features alone reach the driver. An id with several labels has their mean, rounded up;
    null labels and ids are not learned from. None if no label is left.
    """
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("double").alias("label"))
    marks = marks.withColumn("key", F.md5(F.encode(F.col("id").cast("string"), "UTF-8"))).withColumn("range", F.substring("key", 1, 3))
    upto = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # 4096 rows at most
    ranges = marks.groupBy("range").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(upto, F.lit(0))).filter(F.col("before") < most).select("range")
    chosen = marks.join(F.broadcast(ranges), "range").orderBy("key").limit(most).select("id", "label", "key")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("text", "label", "key")
    run = _features(rows, vectors, "text")
    names = ["label", "key", *[f"_{i}" for i in range(FEATURES)]]

    def features(batches):
        yield from run(batches, lambda part, x: pa.RecordBatch.from_arrays([part.column(1), part.column(2), *[pa.array(x[:, i]) for i in range(FEATURES)]], names=names))

    found = rows.mapInArrow(features, ", ".join(["label double", "key string", *[f"_{i} double" for i in range(FEATURES)]])).toArrow().to_pandas()
    if not len(found):
        return None
    found = found.sort_values(list(found.columns)).reset_index(drop=True)
    x, y, last = found[names[2:]].to_numpy(), found["label"].to_numpy(), found["key"].map(lambda k: int(k[-6:], 16) % 5 == 0).to_numpy()
    if last.all() or not last.any():
        return train(x, y)
    network = train(x[~last], y[~last])
    calibrate(network, x[last], y[last])
    return network


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = 0.7, **options) -> DataFrame:
    """One row per input row: ``id, held_out, score, predicted``.

    Word vectors come from all texts, held out or not, as no label is needed for them; the network from labels that are not held out (see
    ``fit``). The score is the probability of label 1; ``predicted`` is 1 from ``cut`` on. Null texts are empty ones and have the score of a
    text without tokens; null ids are not held out; repeated rows score alike; without a label that may be learned from every score is 0.5.
    An empty table gives no rows. Other columns are not read, whatever they are called.
    """
    context = docs.sparkSession.sparkContext
    vectors = context.broadcast(word_vectors(docs, text_col))  # ROWS x DIMS numbers: 8 MB
    network = context.broadcast(fit(docs, labels, vectors, id_col, text_col, label_col, **options))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    run = _features(rows, vectors, "text")

    def scored(batches):
        model = network.value
        score = lambda x: model.score(x) if model else np.full(len(x), 0.5)
        yield from run(batches, lambda part, x: pa.RecordBatch.from_arrays([part.column(0), pa.array(score(x))], names=["id", "score"]))

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(scored, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
