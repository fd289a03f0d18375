"""Words, windows and hashes of a whole Arrow batch of texts at once.

A batch is looked at as one byte buffer with one offset per text. All hashes are prefix sums of
``table[symbol] * base**i`` modulo 2**64, so that the hash of any stretch costs two look-ups.
Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
CHUNK = 1 << 20

SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
BLANK_SPLIT = np.ones(256, bool)
BLANK_SPLIT[list(SPACE)] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def seeded(seed: int) -> np.ndarray:
    """A 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=U) * U(0xD1B54A32D192ED03) + U(seed * 0x632BE59BD9B4E019 & (1 << 64) - 1))


BYTE_VALUES = seeded(1)
LOWER_VALUES = BYTE_VALUES[LOWER]
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK + 1024)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            values = np.full(size, base, U)
            values[0] = 1
            _powers[name] = np.cumprod(values, dtype=U)
        if n > 16 * CHUNK:  # a very long text: do not keep its tables
            return _powers.pop("up"), _powers.pop("down")
    return _powers["up"][:n], _powers["down"][:n]


class Stretch:
    """Hashes of stretches of a sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray):
        up, self.down = powers(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, U)
        np.cumsum(symbols * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, length: int) -> np.ndarray:
        """Of each stretch of one length."""
        n = max(0, len(self.sums) - length)
        return mix((self.sums[length : length + n] - self.sums[:n]) * self.down[:n])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[:n], out[width - have : width - have + n])
    return out[:n]


def joined(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes; a longer text comes alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


class Words:
    """Words of consecutive texts: maximal runs of the bytes marked in ``kind``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, values: np.ndarray | None = BYTE_VALUES):
        on = kind[data]
        first, last = on.copy(), on.copy()
        first[1:] &= ~on[:-1]
        last[:-1] &= ~on[1:]
        full = np.flatnonzero(offsets[1:] > offsets[:-1])
        at = offsets[:-1][full]
        first[at] = on[at]
        at = offsets[1:][full] - 1
        last[at] = on[at]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)  # words of text i: bounds[i] to bounds[i+1]
        self.counts = np.diff(self.bounds)
        self.text = np.repeat(np.arange(len(offsets) - 1), self.counts)
        if values is not None:
            self.bytes = Stretch(values[data])
            self.hash = self.bytes.of(self.start, self.end)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray, Stretch]:
        """Hash of each stretch of ``length`` words, and whether it lies in one text."""
        seq = Stretch(self.hash)
        hashes = seq.every(length)
        inside = self.text[length - 1 :] == self.text[: len(hashes)] if len(hashes) else np.zeros(0, bool)
        return hashes, inside, seq


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a per-position array over each text."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Positions below n that lie in any of the half-open stretches."""
    steps = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(steps)[:n] > 0


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start+1, ... of every stretch, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - begin, lengths)


class Lookup:
    """Numbers from 0 of a small set of hashes; -1 for all others."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(hashes & U(0xFFFF)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        if len(self.sorted):
            likely = np.flatnonzero(self.maybe[(hashes & U(0xFFFF)).astype(np.int64)])
            at = np.searchsorted(self.sorted, hashes[likely])
            at[at == len(self.sorted)] = 0
            same = self.sorted[at] == hashes[likely]
            out[likely[same]] = self.order[at[same]]
        return out


def word_hashes(words: list[str], values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """The hashes that ``Words`` gives to these words."""
    data, offsets = joined(pa.array(words, pa.string()))
    return Stretch(values[data]).of(offsets[:-1], offsets[1:])


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    out = np.zeros(len(keys), bool)
    out[order] = same[:-1] | same[1:]
    return out


def earlier(keys: np.ndarray) -> np.ndarray:
    """Whether each key stands at an earlier place too."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    out = np.zeros(len(keys), bool)
    out[order[1:]] = ordered[1:] == ordered[:-1]
    return out
