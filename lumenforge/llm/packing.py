"""Best-fit packing: a configuration LP over the length histogram, solved by multiplicative weights, then rounded."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenforge.llm import vectext
from lumenforge.plans.lineage import materialize
from lumenforge.plans.prefix import prefix_sum

CAPACITY, END_ID = 1024, 2


def token_words(cp: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words that the byte-level tokenizer merges within.

    The words are those of its pattern: contractions, then letters, numbers or other marks with one
    blank before them, then white space, of which the last character before a word stands alone.
    """
    kind = vectext.classes(cp) & (vectext.LETTER | vectext.NUMBER | vectext.SPACE)
    n = len(cp)
    edge = np.zeros(n + 1, bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[bounds] = True
    begins = np.flatnonzero(edge[:n])
    ends = np.append(begins[1:], n)
    is_space = (kind[begins] & vectext.SPACE) > 0
    fresh = np.zeros(n + 1, bool)
    fresh[bounds] = True
    last = fresh[ends]  # runs at the end of their text
    start = np.zeros(n + 1, bool)
    start[begins] = True
    inner = is_space & ~last
    tail = ends[inner] - 1
    start[tail] = True
    start[ends[inner][cp[tail] == 32]] = False
    quote = np.flatnonzero((cp == 39) & start[:n] & ~fresh[1:])
    if len(quote):
        at = lambda i: np.where(quote + i < n, cp[np.minimum(quote + i, n - 1)], 0)
        one, two = at(1), np.where(fresh[np.minimum(quote + 2, n)], 0, at(2))
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for hit, size in ((short, 2), (~short & long, 3)):
            start[quote[hit] + 1] = False
            start[quote[hit] + size] = True
    start[bounds] = True
    starts = np.flatnonzero(start[:n])
    return starts, np.append(starts[1:], n)


class Encoder:
    """Token ids of whole texts, as the tokenizer's plain encoding gives them.

    Each different word goes through the tokenizer once, then comes from a bounded cache. The cache is
    found by a 64-bit hash, and every word that is taken from it is compared with the word that is
    stored there; where two words share a hash the second goes by its characters. Words of more than ``STORED``
    characters are met seldom and may be as long as a text: they are not kept beyond the call. An added token of
    the tokenizer that stands in a text is a word of its own and parts the text around it.
    """

    LIMIT, LETTERS, STORED = 400_000, 8_000_000, 64

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self._clear()

    def _clear(self) -> None:
        self.known, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # hashes in order and their words: a dict takes eight times the room
        self.odd: dict[str, int] = {}  # words whose hash is that of another
        self.ids, self.letters = vectext.Spans(np.uint32), vectext.Spans(np.uint32)

    def _add(self, joined: str, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> range:
        """Store the words at ``starts`` to ``ends`` with their ids; their places in the cache."""
        first = len(self.ids)
        self.ids.extend(*self._merged([joined[s:e] for s, e in zip(starts.tolist(), ends.tolist())]))
        lengths = ends - starts
        upto = np.cumsum(lengths)
        self.letters.extend(cp[np.repeat(starts - upto + lengths, lengths) + np.arange(upto[-1])], lengths)
        return range(first, first + len(starts))

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each has.

        Words that hold no white space and no added token go through the tokenizer as lines of one text: a line end is a word
        of its own whose id no other word has, so it tells where a word's ids end.
        """
        added = self.added if self.added is not None and self.added.search("\n".join(words)) else None
        plain = np.fromiter((not w[-1].isspace() and (added is None or added.search(w) is None) for w in words), bool, len(words)) & (self.line is not None)
        sizes = np.zeros(len(words), np.int64)
        flat = np.zeros(0, np.uint32)
        if plain.any():
            own = np.array(self.tokenizer.encode_batch_fast(["\n".join(w for w, p in zip(words, plain) if p) + "\n"], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(own == self.line)
            if len(at) == plain.sum() and at[-1] == len(own) - 1:
                sizes[plain], flat = np.diff(at, prepend=-1) - 1, own[own != self.line]
            else:  # a line end merged with its word after all
                plain[:] = False
        if not plain.all():
            rest = [e.ids for e in self.tokenizer.encode_batch_fast([w for w, p in zip(words, plain) if not p], add_special_tokens=False)]
            sizes[~plain] = [len(i) for i in rest]
            other, upto = np.fromiter(chain.from_iterable(rest), np.uint32), np.cumsum(sizes)
            out = np.zeros(upto[-1], np.uint32)
            of_plain = np.repeat(plain, sizes)
            out[of_plain], out[~of_plain] = flat, other
            flat = out
        return flat, sizes

    def _words(self, joined: str, cp: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of words; added tokens that lie inside one text are parted off first."""
        found = [m.span() for m in self.added.finditer(joined)] if self.added else []
        spans = np.array([(a, b) for a, b in found if np.searchsorted(bounds, a, "right") == np.searchsorted(bounds, b, "left")], np.int64).reshape(-1, 2)
        if not len(spans):
            return token_words(cp, bounds)
        starts, _ = token_words(cp, np.unique(np.concatenate([bounds, spans.ravel()])))
        at = np.searchsorted(spans[:, 0], starts, "right") - 1
        inside = (at >= 0) & (starts > spans[at, 0]) & (starts < spans[at, 1])
        starts = starts[~inside]
        return starts, np.append(starts[1:], len(cp))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array and the bounds of each."""
        joined, cp, bounds = vectext.codepoints(texts)
        if not len(cp):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        if len(self.ids) > self.LIMIT or self.letters.used > self.LETTERS:
            self._clear()
        starts, ends = self._words(joined, cp, bounds)
        keys, first, inverse = np.unique(vectext.span_hashes(cp, starts, ends), return_index=True, return_inverse=True)
        near = np.searchsorted(self.known, keys)
        found = np.zeros(len(keys), bool)
        if len(self.known):
            found = self.known[np.minimum(near, len(self.known) - 1)] == keys
        words = np.zeros(len(keys), np.int64)
        words[found] = self.places[near[found]]
        new = np.flatnonzero(~found)
        kept, odd = len(new), len(self.odd)
        if len(new):
            long = (ends - starts)[first[new]] > self.STORED
            kept -= int(long.sum())
            new = np.concatenate([new[~long], new[long]])  # long ones come last and go again below
            at = first[new]
            words[new] = self._add(joined, cp, starts[at], ends[at])
            stored = new[:kept]
            self.known, self.places = np.insert(self.known, near[stored], keys[stored]), np.insert(self.places, near[stored], words[stored].astype(np.int32))
        word = words[inverse]
        for i in np.flatnonzero(self.letters.differ(word, cp, starts, ends)).tolist():
            own = joined[starts[i] : ends[i]]
            if own not in self.odd:
                self.odd[own] = self._add(joined, cp, starts[i : i + 1], ends[i : i + 1])[0]
            word[i] = self.odd[own]
        ids, upto = self.ids.take(word)
        if kept < len(new):
            self._forget(len(new) - kept, len(self.odd) > odd)
        return ids, upto[np.searchsorted(starts, bounds)]

    def _forget(self, last: int, mixed: bool) -> None:
        """Drop the ``last`` words, which were stored last and are not known by their hash; all words if others were stored behind them."""
        if mixed:
            self._clear()
            return
        for spans in (self.ids, self.letters):
            spans.count -= last
            spans.used = int(spans.begin[spans.count])
            if len(spans.flat) > 1 << 16 and len(spans.flat) > 4 * spans.used:
                spans.flat = spans.flat[: max(1 << 16, 2 * spans.used)].copy()


def encoder(path: str) -> Encoder:
    """One encoder and cache for all tasks of a worker process, until it turns to another operator."""
    return vectext.kept(("encoder", path), lambda: Encoder(path))


PIECES = "piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` for every text: its ids and ``end_id``, cut where longer than ``capacity``.

    All pieces of a cut text but its first are full, so what is left to pack is one short piece.
    ``tokenizer`` is the path of a byte-level BPE file on the executors. Null text counts as empty.
    """
    kind = docs.schema[id_col].dataType

    def run(batches):
        own_encoder = encoder(tokenizer)
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for begin, end in vectext.pieces(texts, 400_000):
                ids, bounds = own_encoder.encode(texts[begin:end])
                doc, piece, start, length, crc = [], [], [], [], []
                for i in range(end - begin):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                    cut = (len(own) - 1) % capacity + 1
                    for k, (a, b) in enumerate(zip(range(cut - capacity, len(own), capacity), range(cut, len(own) + 1, capacity))):
                        a = max(a, 0)
                        doc.append(begin + i), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(own[a:b]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], [id_col, "piece", "start", "length", "ids_crc32"])
        vectext.trim()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, {PIECES}")


def price(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack by dynamic programming: for each room the most worth that fits and the length to put in last.

    ``lengths`` ascend; a choice of -1 leaves one token of the room empty.
    """
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    for c in range(int(lengths[0]), capacity + 1):
        k = upto[c]
        values = best[c - lengths[:k]] + worth[:k]
        i = int(values.argmax())
        if values[i] > best[c - 1]:
            best[c], choice[c] = values[i], i
        else:
            best[c] = best[c - 1]
    return best, choice


def solve(demand: dict[int, int], capacity: int, rounds: int = 200, step: float = 0.25, gap: float = 0.05) -> tuple[list[tuple[Counter, float]], float]:
    """The configuration LP (fewest sequences that hold ``demand``) by multiplicative weights.

    Each length has a weight, at first its share of a sequence (the dual of the volume bound). A round
    prices the fillings by a knapsack; of the best fillings that begin with each length it adds those
    near the best of all, no length twice, in an amount that covers ``step`` of the demand of
    their scarcest length, and multiplies the weights of what they hold by exp(-step * share covered).
    The fillings, scaled so that the least covered length is just covered, are the fractional solution.

    Each round's weights, divided by the best filling's, are a dual solution, whose value is a lower
    bound. Rounds end once the fractional solution is within ``gap`` of the best bound so far, at the
    latest after ``rounds``. Returns the fillings with their amounts, and the lower bound.
    """
    lengths = np.array(sorted(demand))
    need = np.array([demand[l] for l in lengths.tolist()], float)
    covered = np.zeros(len(lengths))
    amounts: Counter = Counter()
    base = lengths / capacity
    bound = 0.0
    for _ in range(rounds):
        weight = base * np.exp(-step * (covered - covered.min()))
        best, choice = price(lengths, weight, capacity)
        value = weight + best[capacity - lengths]
        top = value.max()
        bound = max(bound, float((need * weight).sum() / top))
        if covered.min() > 0 and sum(amounts.values()) / covered.min() <= (1 + gap) * bound:
            break
        busy = np.zeros(len(lengths), bool)
        for first in np.argsort(-value, kind="stable").tolist():
            if value[first] < (1 - step / 4) * top:
                break
            if busy[first]:
                continue
            filling, c = Counter({first: 1}), capacity - int(lengths[first])
            while c > 0:
                i = int(choice[c])
                if i < 0:
                    c -= 1
                    continue
                filling[i] += 1
                c -= int(lengths[i])
            if any(busy[i] for i in filling):
                continue
            amount = step * min(need[i] / k for i, k in filling.items())
            amounts[tuple(sorted(filling.items()))] += amount
            for i, k in filling.items():
                busy[i] = True
                covered[i] += amount * k / need[i]
    scale = 1 / max(covered.min(), 1e-9) if covered.min() > 0 else 1 / max(covered.mean(), 1e-9)
    return [(Counter({int(lengths[i]): k for i, k in key}), x * scale) for key, x in amounts.most_common()], bound


def best_fill(remaining: dict[int, int], room: int) -> Counter:
    """Lengths that together come nearest to ``room`` without passing it, the largest that will do."""
    sums, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for l in sorted((l for l in remaining if l <= room), reverse=True):
        left, unit = min(remaining[l], room // l), 1
        while left > 0:
            k = min(unit, left)
            steps.append((sums, l, k))
            sums = (sums | sums << (l * k)) & mask
            left, unit = left - k, unit * 2
        if sums >> room & 1:
            break
    at, out = sums.bit_length() - 1, Counter()
    for before, l, k in reversed(steps):
        if not before >> at & 1:
            out[l] += k
            at -= l * k
    return out


def _best_fit(remaining: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """The longest length left with the lengths that fill its sequence best, as many times as they last, until none is left."""
    remaining, out = {l: n for l, n in remaining.items() if n > 0}, []
    while remaining:
        longest = max(remaining)
        rest = dict(remaining)
        rest[longest] -= 1
        filling = best_fill({l: n for l, n in rest.items() if n}, capacity - longest)
        filling[longest] += 1
        times = min(remaining[l] // k for l, k in filling.items())
        out.append((filling, times))
        for l, k in filling.items():
            remaining[l] -= times * k
            if not remaining[l]:
                del remaining[l]
    return out


def _rounded(demand: dict[int, int], solution: list[tuple[Counter, float]], capacity: int) -> list[tuple[Counter, int]]:
    """The solution's fillings, each rounded down and within what is left; best-fit for the rest."""
    remaining, out = dict(demand), []
    for filling, x in solution:
        times = min(int(x), *(remaining[l] // k for l, k in filling.items()))
        if times > 0:
            out.append((filling, times))
            for l, k in filling.items():
                remaining[l] -= times * k
    return out + _best_fit(remaining, capacity)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 200) -> list[tuple[Counter, int]]:
    """Fillings and how many sequences use each; together they hold every length of ``histogram`` exactly.

    The fractional solution is rounded at several scales down to half of it (the smaller, the less it
    covers lengths beyond their demand and the more is left to best-fit); the rounding with the
    fewest sequences counts, and one that meets the LP's lower bound ends the search.
    """
    demand = {l: n for l, n in histogram.items() if n > 0}
    full = [(Counter({capacity: 1}), demand.pop(capacity))] if demand.get(capacity) else []
    if not demand:
        return full
    solution, bound = solve(demand, capacity, rounds)
    best = None
    for scale in (1.0, 0.9, 0.75, 0.5):
        found = _rounded(demand, [(f, x * scale) for f, x in solution], capacity)
        if best is None or sum(n for _, n in found) < sum(n for _, n in best):
            best = found
        if sum(n for _, n in best) <= math.ceil(bound - 1e-6):
            break
    return full + best


def places(fillings: list[tuple[Counter, int]]) -> dict[str, np.ndarray]:
    """The plan as ranges of ranks: pieces of ``length`` from rank ``first`` on stand ``each`` to a sequence."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for filling, times in fillings:
        offset = 0
        for l in sorted(filling, reverse=True):
            rows.append((l, used[l], filling[l], sequence, offset))
            used[l] += filling[l] * times
            offset += l * filling[l]
        sequence += times
    rows.sort()
    return dict(zip(("length", "first", "each", "sequence", "offset"), np.array(rows, np.int64).reshape(-1, 5).T))


def pack(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, rounds: int = 200) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    Only the histogram, at most ``capacity`` rows, comes to the driver, and the plan that goes back has
    a few ranges per filling. Pieces of one length are ranked by a hashed key through distributed
    prefix sums, so a length that a third of all rows share is no hot group; a piece's rank decides
    its sequence and offset. Repeated rows get places of their own.
    """
    key = F.md5(F.encode(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("piece").cast("string")), "UTF-8"))
    pieces = materialize(pieces.withColumn("_key", key), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    table = places(plan(histogram, capacity, rounds))
    ranked = prefix_sum(pieces.withColumn("_range", F.substring("_key", 1, 3)), ["length"], "_range", [F.col("_key"), F.col("ids_crc32")], F.lit(1).cast("long"), "_rank").drop("_range", "_key")
    shared = pieces.sparkSession.sparkContext.broadcast(table)
    columns = [c for c in ranked.columns if c != "_rank"]

    def run(batches):
        t = shared.value
        codes = t["length"] << 44 | t["first"]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            at = np.searchsorted(codes, length << 44 | rank, "right") - 1
            past = rank - t["first"][at]
            out = [t["sequence"][at] + past // t["each"][at], t["offset"][at] + past % t["each"][at] * length]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in columns], *[pa.array(x, pa.int64()) for x in out]], [*columns, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise, cut and pack every text: ``id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null texts are empty (one piece of ``end_id`` alone); null and repeated ids pass through; other
    columns are not read; an empty table gives no rows.
    """
    return pack(token_pieces(docs, tokenizer, id_col, text_col, capacity, end_id), id_col, capacity)
