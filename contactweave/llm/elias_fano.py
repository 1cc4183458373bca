"""A two-level n-gram trie over Elias-Fano sequences, in one buffer that can be memory-mapped.

Level 1 holds the words, level 2 for each word the contexts it follows.
A context is stored as its number among the contexts seen, and the numbers of
one word's contexts follow those of the word before, shifted so that the
whole level is monotone.  Pointers from level 1 to level 2 are monotone too.
Probabilities are quantised.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class EliasFano:
    """A monotone sequence of 64-bit values: low bits packed, high bits in unary."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.flatnonzero(np.unpackbits(high, bitorder="little")[: len(high) * 8])[:n]
        self._upper = (ones - np.arange(len(ones))).astype(np.uint64)  # high part of each value
        self._mask = np.uint64((1 << low_bits) - 1)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(1, np.uint64), np.zeros(0, np.uint8))
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        shift, mask = np.uint64(low_bits), np.uint64((1 << low_bits) - 1)
        at = np.arange(n, dtype=np.uint64) * shift
        word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        packed = np.zeros(int(n * low_bits // 64) + 2, np.uint64)
        lows = values & mask
        np.bitwise_or.at(packed, word, lows << bit)
        over = (bit + shift) > np.uint64(64)
        np.bitwise_or.at(packed, word[over] + 1, lows[over] >> (np.uint64(64) - bit[over]))
        ones = (values >> shift).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1, np.uint8)
        unary[ones] = 1
        return cls(n, low_bits, packed, np.packbits(unary, bitorder="little"))

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i)
        if not self.low_bits:
            return self._upper[i]
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        low = self.low[word] >> bit
        rest = bit > np.uint64(0)
        low[rest] |= self.low[word[rest] + 1] << (np.uint64(64) - bit[rest])
        return (self._upper[i] << np.uint64(self.low_bits)) | (low & self._mask)

    def successor(self, values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """First place in [low, high) with a value of at least the wanted one; high if there is none."""
        values = np.asarray(values, np.uint64)
        low, high = np.array(low, np.int64), np.array(high, np.int64)
        # the high parts narrow the range, then halving over decoded values finds the place
        if self.n:
            upper = values >> np.uint64(self.low_bits)
            low = np.minimum(np.maximum(low, np.searchsorted(self._upper, upper, "left")), high)
            high = np.maximum(np.minimum(high, np.searchsorted(self._upper, upper, "right")), low)
        while True:
            wide = low < high
            if not wide.any():
                return low
            middle = (low[wide] + high[wide]) // 2
            small = self.get(middle) < values[wide]
            low[wide] = np.where(small, middle + 1, low[wide])
            high[wide] = np.where(small, high[wide], middle)

    def find(self, values: np.ndarray, low=None, high=None) -> np.ndarray:
        """Place of each value in its range, -1 where it isn't there."""
        values = np.asarray(values, np.uint64)
        low = np.zeros(len(values), np.int64) if low is None else low
        high = np.full(len(values), self.n, np.int64) if high is None else high
        at = self.successor(values, low, high)
        there = at < high
        there[there] = self.get(at[there]) == values[there]
        return np.where(there, at, -1)

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits, len(self.low), len(self.high)], np.uint64), self.low, _padded(self.high)]


def _padded(a: np.ndarray) -> np.ndarray:
    raw = a.tobytes()
    return np.frombuffer(raw + b"\0" * (-len(raw) % 8), np.uint64)


class Trie:
    """Words, their counts, and quantised probabilities of words after contexts."""

    def __init__(self, words, contexts, pointers, pairs, counts, codes, low, step):
        self.words, self.contexts, self.pointers, self.pairs = words, contexts, pointers, pairs
        self.counts, self.codes, self.low, self.step = counts, codes, low, step

    @classmethod
    def build(cls, word: np.ndarray, context: np.ndarray, value: np.ndarray, words: np.ndarray, counts: np.ndarray) -> Trie:
        """From distinct (word, context) pairs with a log probability, and sorted ``words`` with their counts."""
        contexts = np.unique(context)
        rank = np.searchsorted(words, word)
        key = rank.astype(np.uint64) * np.uint64(max(1, len(contexts))) + np.searchsorted(contexts, context).astype(np.uint64)
        order = np.argsort(key, kind="stable")
        pointers = np.concatenate(([0], np.cumsum(np.bincount(rank, minlength=len(words)))))
        low = float(value.min()) if len(value) else 0.0
        step = (float(value.max()) - low) / 65535 if len(value) else 0.0
        codes = np.round((value[order] - low) / step).astype(np.uint16) if step else np.zeros(len(value), np.uint16)
        return cls(
            EliasFano.of(words), EliasFano.of(contexts), EliasFano.of(pointers), EliasFano.of(key[order]),
            np.asarray(counts, np.uint64), codes, low, step,
        )

    def lookup(self, word: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count of each word (0 if unseen), whether it was seen after the context, and that pair's log probability."""
        at = self.words.find(word)
        known = at >= 0
        counts = np.zeros(len(word), np.int64)
        counts[known] = self.counts[at[known]].astype(np.int64)
        ctx = self.contexts.find(context)
        both = known & (ctx >= 0)
        seen, value = np.zeros(len(word), bool), np.zeros(len(word))
        if both.any():
            w = at[both]
            low, high = (self.pointers.get(x).astype(np.int64) for x in (w, w + 1))
            key = w.astype(np.uint64) * np.uint64(self.contexts.n) + ctx[both].astype(np.uint64)
            place = self.pairs.find(key, low, high)
            hit = place >= 0
            inner = np.zeros(len(place))
            inner[hit] = self.low + self.step * self.codes[place[hit]]
            seen[both], value[both] = hit, inner
        return counts, seen, value

    def to_bytes(self) -> bytes:
        head = np.array([self.low, self.step], np.float64).view(np.uint64)
        arrays = [head]
        for level in (self.words, self.contexts, self.pointers, self.pairs):
            arrays += level.parts()
        for a in (self.counts, self.codes):
            arrays += [np.array([len(a)], np.uint64), _padded(a)]
        return b"".join(a.tobytes() for a in arrays)

    @classmethod
    def from_buffer(cls, buffer) -> Trie:
        """Opens a buffer, such as ``numpy.memmap``, without copying its levels."""
        words = np.frombuffer(buffer, np.uint64)
        low, step = words[:2].view(np.float64)
        at, levels = 2, []
        for _ in range(4):
            n, bits, n_low, n_high = (int(x) for x in words[at : at + 4])
            at += 4
            packed = words[at : at + n_low]
            at += n_low
            high = words[at : at + -(-n_high // 8)].view(np.uint8)[:n_high]
            at += -(-n_high // 8)
            levels.append(EliasFano(n, bits, packed, high))
        n = int(words[at])
        counts = words[at + 1 : at + 1 + n]
        at += 1 + n
        n = int(words[at])
        codes = words[at + 1 : at + 1 + -(-n // 4)].view(np.uint16)[:n]
        return cls(*levels, counts, codes, float(low), float(step))
