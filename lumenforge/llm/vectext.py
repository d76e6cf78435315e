"""Whole batches of texts as arrays: code points, character classes, spans and their 64-bit hashes."""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Callable, Hashable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

WORD, ALPHA, LETTER, NUMBER, SPACE, KNOWN = 1, 2, 4, 8, 16, 128
#: Unicode White_Space. Fixed values.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

_classes = np.zeros(0x110000, np.uint8)
_classes[list(WHITE_SPACE)] = SPACE
_symbols: np.ndarray | None = None
_powers = _inverses = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def classes(cp: np.ndarray) -> np.ndarray:
    """Class bits of code points; kinds not met before are looked up once per process."""
    out = _classes[cp]
    if len(unknown := np.unique(cp[out < KNOWN])):
        for x in unknown.tolist():
            c = chr(x)
            kind = unicodedata.category(c)[0]
            word = c.isalnum() and not c.isdecimal()
            _classes[x] |= KNOWN | WORD * word | ALPHA * c.isalpha() | LETTER * (kind == "L") | NUMBER * (kind == "N")
        out = _classes[cp]
    return out


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    global _symbols, _powers, _inverses
    if _symbols is None:
        _symbols = mix(np.arange(1, 0x110001, dtype=np.uint64))
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        out = []
        for base in (_BASE, _INVERSE):
            p = np.ones(1, np.uint64)
            while len(p) < size:  # double: B^(m + i) = B^m B^i
                p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
            out.append(p)
        _powers, _inverses = out
    return _symbols, _powers, _inverses


LONG = 64
_kept: dict = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's


def kept(key: Hashable, make: Callable):
    """What a worker process keeps between tasks under ``key``. It keeps one thing: turning to another, it drops the last one's caches."""
    if key not in _kept:
        release()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Drop what ``kept`` holds; an operator whose tasks keep nothing calls it, as Spark gives it workers that served others before."""
    _kept.clear()
    trim()


def trim() -> None:
    """Give the memory of freed arrays back to the system: a worker that waits for its next task would hold it beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def span_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``cp[start:end]``, equal for equal content wherever it stands.

    Spans of up to ``LONG`` symbols are hashed by sums of powers modulo 2**64. Longer ones go through BLAKE2b,
    as strings that collide whatever the base exist from about a thousand symbols on.
    """
    symbols, powers, inverses = _tables(len(cp) + 1)
    sums = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(symbols[cp] * powers[: len(cp)], out=sums[1:])
    out = mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))
    long = np.flatnonzero(ends - starts > LONG)
    if len(long):
        wide = np.ascontiguousarray(cp, np.uint32)
        out[long] = [int.from_bytes(blake2b(wide[s:e].tobytes(), digest_size=8).digest(), "little") for s, e in zip(starts[long].tolist(), ends[long].tolist())]
    return out


class Spans:
    """Many short arrays in one that grows."""

    def __init__(self, kind: type) -> None:
        self.flat, self.begin, self.length, self.count, self.used = np.zeros(1 << 16, kind), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0, 0

    def __len__(self) -> int:
        return self.count

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Add arrays of ``sizes`` that stand one after another in ``flat``."""
        total, upto = len(flat), self.count + len(sizes)
        while upto > len(self.begin):
            self.begin, self.length = np.append(self.begin, np.zeros_like(self.begin)), np.append(self.length, np.zeros_like(self.length))
        while self.used + total > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.flat[self.used : self.used + total] = flat
        self.begin[self.count : upto] = self.used + np.cumsum(sizes) - sizes
        self.length[self.count : upto] = sizes
        self.count, self.used = upto, self.used + total

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen arrays one after another, and their bounds."""
        sizes = self.length[which]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[np.repeat(self.begin[which] - upto[:-1], sizes) + np.arange(upto[-1])], upto

    def differ(self, which: np.ndarray, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether array ``which[i]`` is another than ``symbols[starts[i]:ends[i]]``; the spans follow one another and fill ``symbols``."""
        other = self.length[which] != ends - starts
        if not other.any():
            own, _ = self.take(which)
            if np.array_equal(own, symbols):
                return other
        at = np.repeat(self.begin[which] - starts, ends - starts) + np.arange(len(symbols))
        wrong = self.flat[np.minimum(at, len(self.flat) - 1)] != symbols
        return other | np.logical_or.reduceat(wrong, starts) if len(starts) else other


def codepoints(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts in one string, as code points, and the bounds of each."""
    joined = "".join(texts)
    return joined, np.frombuffer(joined.encode("utf-32-le"), np.uint32), np.cumsum([0, *map(len, texts)])


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that don't cross ``bounds``."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[0] = edge[-1] = True
    edge[bounds] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (edge[:-1] | ~before))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (edge[1:] | ~after)) + 1
    return starts, ends


def pieces(texts: list, most: int = 800_000) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive parts of ``texts`` with about ``most`` characters each; a longer text stands alone."""
    begin = total = 0
    for i, t in enumerate(texts):
        if i > begin and total + len(t) > most:
            yield begin, i
            begin, total = i, 0
        total += len(t)
    if begin < len(texts):
        yield begin, len(texts)
