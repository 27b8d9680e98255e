"""Elias-Fano sequences and a two-level n-gram trie in memory-mapped files."""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass
from functools import cached_property

import numpy as np

_U = np.uint64
_WORDS = 8  # words of the upper bits in a block of the directory


def _select_in_word(words: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Place of the set bit of the given rank in each 64-bit word."""
    place = np.zeros(len(words), np.int64)
    words, ranks = words.copy(), ranks.copy()
    for width in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count(words & _U((1 << width) - 1)).astype(np.int64)
        upper = ranks >= below
        ranks = np.where(upper, ranks - below, ranks)
        words = np.where(upper, words >> _U(width), words)
        place += np.where(upper, width, 0)
    return place


class EliasFano:
    """A sorted sequence of 64-bit values: low bits packed, high bits in unary.

    `parts` are plain arrays, so they can be written to and mapped from a file.
    """

    def __init__(self, size: int, low_bits: int, parts: list[np.ndarray]):
        self.size, self.low_bits = size, low_bits
        self.low, self.high, self.zeros = parts

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        low_bits = max(0, min(56, (universe // max(1, n)).bit_length() - 1))
        low = np.zeros(n * low_bits // 8 + 9, np.uint8)
        at = np.arange(n, dtype=np.int64) * low_bits
        rest = (values & _U((1 << low_bits) - 1)) << (at & 7).astype(_U)
        over = np.where(at & 7, (values & _U((1 << low_bits) - 1)) >> _U(1) >> (63 - (at & 7)).astype(_U), _U(0))
        for i in range(8):  # neighbours share bytes, hence the unbuffered or
            np.bitwise_or.at(low, (at >> 3) + i, (rest >> _U(8 * i) & _U(255)).astype(np.uint8))
        np.bitwise_or.at(low, (at >> 3) + 8, (over & _U(255)).astype(np.uint8))
        ones = (values >> _U(low_bits)).astype(np.int64) + np.arange(n)
        length = (int(universe) >> low_bits) + n + 2
        length += -length % (64 * _WORDS)
        bits = np.zeros(length, np.uint8)
        bits[ones] = 1
        high = np.packbits(bits, bitorder="little").view(_U)
        zeros = np.bitwise_count(~high).reshape(-1, _WORDS).sum(1, dtype=np.int64)
        return cls(n, low_bits, [low, high, np.concatenate(([0], np.cumsum(zeros)))])

    def low_at(self, places: np.ndarray) -> np.ndarray:
        at = places * self.low_bits
        first = at >> 3
        raw = self.low[first[:, None] + np.arange(8)]
        value = np.ascontiguousarray(raw).view("<u8").ravel() >> (at & 7).astype(_U)
        last = self.low[first + 8].astype(_U)
        value |= np.where(at & 7, last << (63 - (at & 7)).astype(_U) << _U(1), _U(0))
        return value & _U((1 << self.low_bits) - 1)

    def _select0(self, ranks: np.ndarray) -> np.ndarray:
        """Place of the zero of each rank in the upper bits."""
        block = np.searchsorted(self.zeros, ranks, "right") - 1
        left = ranks - self.zeros[block]
        word = block * _WORDS
        for _ in range(_WORDS - 1):
            have = np.bitwise_count(~self.high[word]).astype(np.int64)
            beyond = left >= have
            left = np.where(beyond, left - have, left)
            word = np.where(beyond, word + 1, word)
            if not beyond.any():
                break
        return word * 64 + _select_in_word(~self.high[word], left)

    def below(self, high: np.ndarray) -> np.ndarray:
        """How many values have upper bits less than `high`."""
        out = np.zeros(len(high), np.int64)
        some = high > 0
        if some.any():
            out[some] = self._select0(high[some] - 1) - (high[some] - 1)
        return out

    def search(self, values: np.ndarray, begin: np.ndarray | int = 0, end: np.ndarray | None = None) -> np.ndarray:
        """Place of each value within [begin, end), -1 where it is absent: the run of its upper
        bits is found in the unary part and searched by low bits."""
        if not self.size or not len(values):
            return np.full(len(values), -1, np.int64)
        high = (values >> _U(self.low_bits)).astype(np.int64)
        start = np.maximum(self.below(high), begin)
        end = np.minimum(self.below(high + 1), self.size if end is None else end)
        want = values & _U((1 << self.low_bits) - 1)
        stop = end
        while (open_ := start < stop).any():
            at = np.flatnonzero(open_)
            middle = (start[at] + stop[at]) // 2
            less = self.low_at(middle) < want[at]
            start[at] = np.where(less, middle + 1, start[at])
            stop = stop.copy() if stop is end else stop
            stop[at] = np.where(less, stop[at], middle)
        found = start < end
        found[found] = self.low_at(start[found]) == want[found]
        return np.where(found, start, -1)

    @cached_property
    def _ones(self) -> np.ndarray:
        """How many values end before each word of the upper bits."""
        return np.cumsum(np.concatenate(([0], np.bitwise_count(self.high)))).astype(np.int64)

    def access(self, places: np.ndarray) -> np.ndarray:
        """The values at the given places."""
        word = np.searchsorted(self._ones, places, "right") - 1
        upper = word * 64 + _select_in_word(self.high[word], places - self._ones[word]) - places
        return upper.astype(_U) << _U(self.low_bits) | self.low_at(places)


# Steps of log10 a stored probability is rounded to; 0 stands for none.
STEPS = 2048


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * STEPS) + 1, 1, 65535).astype(np.uint16)


def dequantise(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.float64) - 1) / -STEPS


@dataclass
class Trie:
    """Contexts, each with its successors: the context's backoff and the successors'
    discounted probabilities, quantised. All levels are Elias-Fano sequences: the contexts, the
    pointers to where the successors of each begin, and the successors. Those of a context are
    raised by the last value of the range before, so the sequence rises and each range is read
    relative to its own start."""

    contexts: EliasFano
    backoffs: np.ndarray
    pointers: EliasFano
    successors: EliasFano
    probabilities: np.ndarray

    @classmethod
    def build(cls, contexts: np.ndarray, successors: np.ndarray, counts: np.ndarray, bits: int, discount: float) -> Trie:
        """From bigrams sorted by (context, successor) with their counts; successors have
        `bits` bits."""
        own, start = np.unique(contexts, return_index=True)
        size = np.diff(np.append(start, len(contexts)))
        total = np.add.reduceat(counts, start) if len(own) else np.zeros(0)
        at = np.repeat(np.arange(len(own)), size)
        last = successors[start + size - 1]
        if last.astype(np.float64).sum() >= 2.0**63:
            raise ValueError("too many contexts in one shard; deal them to more")
        above = np.cumsum(last, dtype=_U)
        values = (above - last)[at] + successors
        return cls(
            EliasFano.build(own, 1 << 64),
            quantise(np.log10(discount * size / total)),
            EliasFano.build(np.append(start, len(contexts)).astype(_U), len(contexts) + 1),
            EliasFano.build(values, (int(above[-1]) if len(own) else 0) + (1 << bits)),
            quantise(np.log10((counts - discount) / total[at])),
        )

    def mapped(self) -> Trie:
        """The same levels read from a file of this task's own folder, which is unlinked as
        soon as it is mapped, so nothing is left behind."""
        handle, path = tempfile.mkstemp(prefix="trie-")
        try:
            def put(array: np.ndarray) -> tuple:
                place = file.tell()
                file.write(np.ascontiguousarray(array).tobytes())
                file.write(b"\0" * (-file.tell() % 8))
                return array.dtype, place, len(array)

            with os.fdopen(handle, "wb") as file:
                levels = self.contexts, self.pointers, self.successors
                plain = [put(a) for a in (self.backoffs, self.probabilities)]
                coded = [[put(a) for a in (s.low, s.high, s.zeros)] for s in levels]
            got = lambda d, o, n: np.memmap(path, d, "r", o, (n,)) if n else np.zeros(0, d)
            backoffs, probabilities = (got(*x) for x in plain)
            contexts, pointers, successors = (
                EliasFano(s.size, s.low_bits, [got(*x) for x in parts]) for s, parts in zip(levels, coded, strict=True)
            )
            return Trie(contexts, backoffs, pointers, successors, probabilities)
        finally:
            os.unlink(path)

    def context_codes(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place or -1, code of the backoff or 0) of each context."""
        places, codes = self.contexts.search(contexts), np.zeros(len(contexts), np.uint16)
        known = places >= 0
        codes[known] = self.backoffs[places[known]]
        return places, codes

    def codes(self, places: np.ndarray, sizes: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """Code of the probability of each successor, 0 for none: so many of each context, which
        is given by its place; they are sought between its pointer and the next one."""
        out = np.zeros(len(successors), np.uint16)
        own = places[places >= 0]
        begin, end = (self.pointers.access(p).astype(np.int64) for p in (own, own + 1))
        above = np.zeros(len(own), _U)
        above[begin > 0] = self.successors.access(begin[begin > 0] - 1)
        known = np.flatnonzero(np.repeat(places >= 0, sizes))
        of = np.repeat(np.arange(len(own)), sizes[places >= 0])
        found = self.successors.search(above[of] + successors[known], begin[of], end[of])
        hit = found >= 0
        out[known[hit]] = self.probabilities[found[hit]]
        return out
