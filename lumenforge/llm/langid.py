"""Language ID by interpolated Kneser-Ney character models, kept as sorted hash arrays."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from lumenforge.llm import vectext

ORDER = 4
LONGEST = 64
WORDS = re.compile(rf"[^\W\d_]{{1,{LONGEST}}}")
START, END = 1, 2
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of ``^word$`` for all words in one array, and each symbol's place in its word."""
    flat = np.frombuffer("".join(f"\x01{w}\x02" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    begins = np.flatnonzero(flat == START)
    place = np.arange(len(flat)) - np.repeat(begins, np.diff(np.append(begins, len(flat))))
    return flat, place


def _grams(flat: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order the hash of the n symbols that end at each place."""
    out = [vectext.mix((flat + np.uint64(1)) * MULTIPLIER)]
    for n in range(1, order):
        longer = np.zeros_like(out[0])
        longer[n:] = vectext.mix(out[-1][n:] + vectext.mix((flat[:-n] + np.uint64(n * 2097152 + 7)) * MULTIPLIER))
        out.append(longer)
    return out


@dataclass
class Model:
    """``keys[n]``: sorted hashes of all (n+1)-grams; ``logp[n]``, ``back[n]``: per key and language its log
    probability (NaN where unseen) and the log weight that it gives, as a context, to shorter ones."""

    langs: list[str]
    floor: float
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    back: list[np.ndarray]
    slope: float = 1.0
    offset: float = 0.0
    usual: np.ndarray | None = None  # cross-entropy of each language's own texts
    spread: tuple[float, float] = (0.0, 0.0)  # variance of a text's cross-entropy: a part that stays, and one for each 1/symbols
    cut: float = np.inf

    def score_words(self, words: list[str]) -> np.ndarray:
        """Per word and language the log probability of its symbols and its end; last column: their number."""
        flat, place = _codes(words)
        grams = _grams(flat, len(self.keys))
        lp = np.full((len(flat), len(self.langs)), self.floor, np.float32)
        below = None
        for n, keys in enumerate(self.keys):
            at = np.minimum(np.searchsorted(keys, grams[n]), len(keys) - 1)
            at[(keys[at] != grams[n]) | (place < n)] = -1
            if n:
                context = np.append(-1, below[:-1])
                weight = np.where((context >= 0)[:, None], self.back[n - 1][context], 0)
                lp = np.where((place >= n)[:, None], lp + weight, lp)
            own = np.where((at >= 0)[:, None], self.logp[n][at], np.nan)
            lp = np.where(np.isnan(own), lp, own)
            below = at
        lp[place == 0] = 0  # the start symbol is given
        begins = np.flatnonzero(place == 0)
        return np.column_stack([np.add.reduceat(lp, begins), np.diff(np.append(begins, len(flat))) - 1]).astype(np.float32)

    def surprise(self, entropy: np.ndarray, lang: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Standard deviations by which cross-entropies lie above the usual one of their language, for texts of their length."""
        return (entropy - self.usual[lang]) / np.sqrt(self.spread[0] + self.spread[1] / np.maximum(symbols, 1))

    def verdicts(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, calibrated score and whether accepted, from rows of log probabilities and numbers of symbols."""
        entropy = -sums[:, :-1] / np.maximum(sums[:, -1:], 1)
        best = entropy.argmin(1)
        score = 1 / (1 + np.exp(-np.clip(self.slope * margins(entropy, sums[:, -1]) + self.offset, -30, 30)))
        accepted = np.ones(len(sums), bool) if self.usual is None else self.surprise(entropy.min(1), best, sums[:, -1]) <= self.cut
        return best, score, accepted


def margins(entropy: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """How far the second best language lies behind the best, in units of a text's sampling error."""
    if entropy.shape[1] < 2:
        return np.sqrt(np.maximum(symbols, 1))
    ranked = np.partition(entropy, 1, axis=1)
    return (ranked[:, 1] - ranked[:, 0]) * np.sqrt(np.maximum(symbols, 1))


def train(words_by_lang: dict[str, dict[str, int]], order: int = ORDER) -> Model:
    """Fit one interpolated Kneser-Ney model per language from counts of its words.

    The longest grams use raw counts and shorter ones the number of different symbols before them
    (grams that begin a word keep raw counts). Each order's discount is n1 / (n1 + 2 n2).
    """
    langs = sorted(words_by_lang)
    tables = []
    symbols = set()
    for lang in langs:
        words = list(words_by_lang[lang])
        flat, place = _codes(words)
        symbols.update(np.unique(flat).tolist())
        weight = np.repeat(np.array([words_by_lang[lang][w] for w in words], np.float64), np.diff(np.append(np.flatnonzero(place == 0), len(flat))))
        grams = _grams(flat, order)
        counts = []
        for n in range(order):
            ok = place >= max(n, 1)  # a start symbol is never predicted
            keys, first, inverse = np.unique(grams[n][ok], return_index=True, return_inverse=True)
            raw = np.bincount(inverse, weight[ok], len(keys))
            position = np.flatnonzero(ok)[first]
            if n < order - 1:
                longer = place >= n + 1
                pairs, at = np.unique(grams[n + 1][longer], return_index=True)
                suffix = grams[n][np.flatnonzero(longer)[at]]
                kinds = np.bincount(np.searchsorted(keys, suffix), None, len(keys)).astype(np.float64)
                begins = place[position] == n  # nothing can stand before it
                raw = np.where(begins & (n > 0), raw, np.maximum(kinds, 1e-9))
            context = grams[n - 1][position - 1] if n else np.zeros(len(keys), np.uint64)
            counts.append((keys, raw, context, grams[n - 1][position] if n else None))
        tables.append(counts)
    floor = -np.log(len(symbols) + 1.0)
    models = []
    for counts in tables:
        logp, back = [], []
        lower = None
        for n, (keys, count, context, suffix) in enumerate(counts):
            ones, twos = (count < 1.5).sum(), ((count >= 1.5) & (count < 2.5)).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            groups, inverse = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(inverse, count, len(groups)), np.bincount(inverse, None, len(groups))
            held = np.minimum(discount, count)
            spare = np.bincount(inverse, held, len(groups)) / total
            shorter = np.exp(floor) if n == 0 else np.exp(lower[np.searchsorted(counts[n - 1][0], suffix)])
            p = (count - held) / total[inverse] + spare[inverse] * shorter
            lower = np.log(p)
            logp.append((keys, lower))
            back.append((groups, np.log(spare)))
        models.append((logp, back))
    keys, logps, backs = [], [], []
    for n in range(order):
        contexts = [m[1][n + 1][0] for m in models] if n + 1 < order else []
        all_keys = np.unique(np.concatenate([m[0][n][0] for m in models] + contexts))
        p, b = np.full((len(all_keys), len(langs)), np.nan, np.float32), np.zeros((len(all_keys), len(langs)), np.float32)
        for i, m in enumerate(models):
            p[np.searchsorted(all_keys, m[0][n][0]), i] = m[0][n][1]
            if n + 1 < order:
                b[np.searchsorted(all_keys, m[1][n + 1][0]), i] = m[1][n + 1][1]
        keys.append(all_keys)
        logps.append(p)
        backs.append(b)
    # with no symbol seen at all, a place falls to the floor with the weight of the empty context
    model = Model(langs, floor, keys, logps, backs)
    empty = np.array([m[1][0][1][0] for m in models], np.float32)
    model.floor = float(floor) + empty.min() if len(empty) else floor
    return model


def calibrate(model: Model, sums: np.ndarray, truth: np.ndarray, slack: float = 1.5) -> None:
    """Fit score = P(right) by logistic regression on the margin, and the rejection cut on cross-entropies.

    ``truth`` are language numbers. How far a text of its own language strays from the language's usual
    cross-entropy has a variance a + b / symbols, fitted by least squares. The cut is ``slack`` times
    the largest such deviation among the labelled texts, in standard deviations, and at least 6: texts
    like the labelled ones pass, and longer texts are held to a narrower range than short ones.
    """
    entropy = -sums[:, :-1] / np.maximum(sums[:, -1:], 1)
    best, margin = entropy.argmin(1), margins(entropy, sums[:, -1])
    # two prior texts at margin 0, one right and one wrong, keep separable data finite
    x = np.append(margin, [0, 0])
    y = np.append((best == truth).astype(float), [1, 0])
    a = b = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((y - p) * x).sum() - 1e-3 * a, (y - p).sum() - 1e-3 * b])
        h = p * (1 - p)
        hess = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        step *= min(1, 2 / max(np.abs(step).max(), 1e-9))
        a, b = a + step[0], b + step[1]
    model.slope, model.offset = max(float(a), 0.0), float(b)
    own, symbols = entropy[np.arange(len(truth)), truth], np.maximum(sums[:, -1], 1)
    if len(own) < 2:
        return
    overall = (own * symbols).sum() / symbols.sum()
    weight, total = np.bincount(truth, symbols, len(model.langs)), np.bincount(truth, own * symbols, len(model.langs))
    model.usual = np.where(weight > 0, total / np.maximum(weight, 1), overall)
    square, rate = (own - model.usual[truth]) ** 2, 1 / symbols
    varied = ((rate - rate.mean()) ** 2).sum()
    grows = max(float(((rate - rate.mean()) * (square - square.mean())).sum() / varied), 0.0) if varied > 0 else 0.0
    stays = max(float((square - grows * rate).mean()), 0.0)
    # no less than a hundredth of a symbol's usual cost, so that texts which are all alike leave room
    model.spread = (stays + (0.01 * overall) ** 2, max(grows, overall**2))
    model.cut = max(6.0, slack * float(model.surprise(own, truth, symbols).max()))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 600, max_chars: int = 50_000) -> Model | None:
    """Learn from labelled rows that are not held out: per language the ``per_language`` rows with the
    smallest hashed ids among texts of at most ``max_chars`` characters. Every third of them calibrates.

    Rows are counted by language and 4096 ranges of their hash; a language's ranges are taken up to the one
    that fills its share, so that only rows of those are ranked, and no language is one task's.
    What reaches the driver is bounded by these parameters times the number of languages. None if no
    row is labelled. Other columns are not read, whatever they are called.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    usable = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")) & (F.length("text") <= max_chars))
    key = F.md5(F.encode(F.col("id").cast("string"), "UTF-8"))
    usable = usable.withColumn("key", key).withColumn("range", F.substring("key", 1, 3))
    counts = usable.groupBy("lang", "range").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = counts.withColumn("before", F.coalesce(upto, F.lit(0))).filter(F.col("before") < per_language).select("lang", "range")
    # at most per_language ranges of each language
    near = usable.join(F.broadcast(ranges), ["lang", "range"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key", "id", "text"))
    chosen = near.withColumn("rank", rank).filter(F.col("rank") <= per_language).select("rank", "lang", "text").collect()
    found = [(r["rank"], r["lang"], WORDS.findall(r["text"].lower())) for r in chosen]
    found = [r for r in found if r[2]]
    if not found:
        return None
    learned = {lang for rank, lang, _ in found if rank % 3}
    counts_of: dict[str, dict[str, int]] = {}
    for rank, lang, words in found:
        if rank % 3 or lang not in learned:
            own = counts_of.setdefault(lang, {})
            for w in words:
                own[w] = own.get(w, 0) + 1
    model = train(counts_of)
    test = [r for r in found if r[0] % 3 == 0] or found
    words = sorted({w for r in test for w in r[2]})
    scores = dict(zip(words, model.score_words(words)))
    sums = np.array([np.sum([scores[w] for w in r[2]], axis=0, dtype=np.float64) for r in test])
    calibrate(model, sums, np.array([model.langs.index(r[1]) for r in test]))
    return model


class Scorer:
    """Sums of word scores per text; words that were seen before come from a bounded cache."""

    LIMIT = 150_000

    def __init__(self, model: Model) -> None:
        self.model, self.cache, self.scores = model, {}, np.zeros((0, len(model.langs) + 1), np.float32)

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of lower-cased texts: log probabilities by language and number of symbols; whether there is a letter."""
        out, letters = np.zeros((len(texts), len(self.model.langs) + 1)), np.zeros(len(texts), bool)
        for begin, end in vectext.pieces(texts):
            joined, cp, bounds = vectext.codepoints(texts[begin:end])
            if not len(cp):
                continue
            kind = vectext.classes(cp)
            starts, ends = vectext.runs((kind & vectext.WORD) > 0, bounds)
            parts = -(-(ends - starts) // LONGEST)  # very long runs are scored in parts
            if len(parts) and parts.max() > 1:
                number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                starts, ends = np.repeat(starts, parts) + number * LONGEST, np.repeat(ends, parts)
                ends = np.minimum(ends, starts + LONGEST)
            place = np.searchsorted(starts, bounds)
            upto = np.concatenate([[0], np.cumsum((kind & vectext.ALPHA) > 0)])
            letters[begin:end] = np.diff(upto[bounds]) > 0
            if not len(starts):
                continue
            # a word has at most LONGEST symbols, too few for the sums of powers to collide by structure
            keys, first, inverse = np.unique(vectext.span_hashes(cp, starts, ends), return_index=True, return_inverse=True)
            keys = keys.tolist()
            if len(self.cache) > self.LIMIT:
                self.cache, self.scores = {}, self.scores[:0]
            new = [i for i, k in enumerate(keys) if k not in self.cache]
            words = [joined[s:e] for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            self.cache.update(zip((keys[i] for i in new), range(len(self.cache), len(self.cache) + len(new))))
            self.scores = np.concatenate([self.scores, *(self.model.score_words(words[i : i + 20_000]) for i in range(0, len(words), 20_000))])
            word = np.fromiter(map(self.cache.__getitem__, keys), np.int64, len(keys))[inverse]
            some = np.flatnonzero(np.diff(place))
            out[begin + some] = np.add.reduceat(self.scores[word], place[:-1][some], dtype=np.float64)
        return out, letters


def detect(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with three columns added by one map over whole texts: language, score, accepted.

    The columns of ``docs`` come first, as ``_0, _1, ...`` in their order, whatever they are called; then
    ``lang_pred, score, accepted``. Null texts and texts without a letter are ``und`` with score 0 and not
    accepted, as is everything without a model.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)
    rows = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    schema = StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("accepted", BooleanType())])

    def run(batches):
        vectext.release()
        model = shared.value
        scorer = Scorer(model) if model else None
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = [t.lower() if t else "" for t in part.column(place).to_pylist()]
                if scorer:
                    sums, letters = scorer.sums(texts)
                    best, score, accepted = model.verdicts(sums)
                else:
                    best, score, accepted, letters = np.zeros(len(texts), int), np.zeros(len(texts)), np.ones(len(texts), bool), np.zeros(len(texts), bool)
                langs = [model.langs[b] if ok else "und" for b, ok in zip(best, letters)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(np.where(letters, score, 0.0), pa.float64()), pa.array(letters & accepted, pa.bool_())], names=schema.names)
        scorer = None
        vectext.trim()

    return rows.mapInArrow(run, schema)


def accepted_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of ``docs``, whole, whose language the models accept.

    Null texts, texts without a letter and texts that no learned language explains (see ``calibrate``) go;
    repeated rows are judged alike. Columns may have any name. An empty or unlabelled table keeps nothing.
    """
    out = detect(docs, fit(docs, id_col, text_col, lang_col, **options), text_col).filter("accepted")
    return out.select(*[f"_{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """One row per input row: ``id, held_out, lang_pred, score, accepted``; see ``fit`` and ``detect``.

    Null ids are not held out and not learned from; repeated rows are predicted alike; an empty table
    gives no rows. A rejected text (``accepted`` false) still names its nearest language.
    """
    model = fit(docs, id_col, text_col, lang_col, **options)
    out = detect(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model)
    return out.select(F.col("_0").alias(id_col), held_out(F.col("_0")).alias("held_out"), "lang_pred", "score", "accepted")
