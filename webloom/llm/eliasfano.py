"""Elias-Fano sequences and an n-gram trie of any order over them, kept in a file and read through memory maps.

A level stores, for all contexts one after the other, the words that follow. Within a context the words
are written relative to the context's number, so the whole level is one rising sequence; pointers into
it are another. Both are Elias-Fano coded: about two bits an entry above the entropy of the gaps. A lookup goes down the
levels; on each it is a successor search: the first entry not below the wanted value, which is then compared.

The mapped bits are read as they are: one count per 512 bits says in which block a bit of some rank lies, and
population counts find it there. Beside the map a sequence holds an eighth of a bit for each of its bits.
"""

from __future__ import annotations

import tempfile

import numpy as np

LOWEST = 12.0  # probabilities down to 10^-12 are told apart
LEVELS = 255


def quantised(p: np.ndarray) -> np.ndarray:
    """Codes 1..255 on a logarithmic scale; 0 stands for 0."""
    with np.errstate(divide="ignore"):
        code = np.rint(-np.log10(p) / LOWEST * (LEVELS - 1)) + 1
    return np.where(p > 0, np.minimum(code, LEVELS), 0).astype(np.uint8)


PROBABILITY = np.where(np.arange(LEVELS + 1) > 0, 10.0 ** (-(np.arange(LEVELS + 1) - 1) * LOWEST / (LEVELS - 1)), 0.0)


BLOCK = 512  # bits between two counts


class Sequence:
    """A rising sequence of integers below ``universe``."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low, self.high = n, width, low, high.view("<u8")
        blocks = np.bitwise_count(self.high).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.int64)
        self.ones = np.concatenate([[0], np.cumsum(blocks)])

    def select(self, rank: np.ndarray, bit: int) -> np.ndarray:
        """Places of the one bits (or zero bits) with these ranks, from 0; the place after the last bit where there is none."""
        before = self.ones if bit else np.arange(len(self.ones)) * BLOCK - self.ones
        out = np.full(len(rank), len(self.high) * 64, np.int64)
        there = np.flatnonzero(rank < before[-1])
        rank = rank[there]
        block = np.searchsorted(before, rank, "right") - 1
        rank = rank - before[block]
        word = block * (BLOCK // 64)
        for _ in range(BLOCK // 64 - 1):  # the word within the block
            count = np.bitwise_count(self.high[word] if bit else ~self.high[word]).astype(np.int64)
            on = rank >= count
            # once a word holds the rank, it stays
            rank, word = np.where(on, rank - count, rank), word + on
        value = np.asarray(self.high[word] if bit else ~self.high[word])
        place = np.zeros(len(rank), np.int64)
        for half in (32, 16, 8, 4, 2, 1):  # the bit within the word
            part = (value >> place.astype(np.uint64)) & np.uint64((1 << half) - 1)
            count = np.bitwise_count(part).astype(np.int64)
            on = rank >= count
            rank, place = np.where(on, rank - count, rank), place + half * on
        out[there] = word * 64 + place
        return out

    @staticmethod
    def coded(values: np.ndarray, universe: int) -> tuple[int, int, np.ndarray, np.ndarray]:
        n = len(values)
        width = max(0, min(48, int(universe // max(1, n)).bit_length() - 1))
        values = values.astype(np.uint64)
        low = np.zeros(0, np.uint8)
        if width:
            parts = values & np.uint64((1 << width) - 1)
            low = np.concatenate([np.packbits(((parts[i:i + 65536, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).reshape(-1),
                                              bitorder="little") for i in range(0, n, 65536)] or [low])
        top = (values >> np.uint64(width)).astype(np.int64)
        bits = np.zeros(-(-((int(top[-1]) if n else 0) + n + 1) // BLOCK) * BLOCK, np.uint8)
        bits[top + np.arange(n)] = 1
        return n, width, np.concatenate([low, np.zeros(8, np.uint8)]), np.packbits(bits, bitorder="little")

    def lows(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), np.uint64)
        bit = at.astype(np.int64) * self.width
        byte, value = bit >> 3, np.zeros(len(at), np.uint64)
        for k in range((self.width + 14) >> 3):
            value |= self.low[byte + k].astype(np.uint64) << np.uint64(8 * k)
        return (value >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.select(at, 1) - at).astype(np.uint64) << np.uint64(self.width)) | self.lows(at)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first entry that is not below x, ``n`` if there is none."""
        top = (x >> np.uint64(self.width)).astype(np.int64)
        # entries of one high part lie between two zeros
        low = np.where(top > 0, np.minimum(self.select(np.maximum(top - 1, 0), 0) - (top - 1), self.n), 0)
        high = np.minimum(self.select(top, 0) - top, self.n)
        low, high = np.clip(low, 0, self.n), np.clip(high, 0, self.n)
        wanted = x & np.uint64((1 << self.width) - 1) if self.width else np.zeros(len(x), np.uint64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_]) >> 1
            below = self.lows(middle) < wanted[open_]
            low[open_[below]] = middle[below] + 1
            high[open_[~below]] = middle[~below]


class Trie:
    """N-grams of any order with a code each: on every level pointers to followers, and followers relative to their context."""

    def __init__(self, grams: list[np.ndarray], codes: np.ndarray):
        """``grams`` has a column of words per place, rows in order, each once."""
        n = len(codes)
        head = np.ones(n, bool)
        head[1:] = grams[0][1:] != grams[0][:-1]
        number = np.cumsum(head) - 1
        vocabulary = np.unique(np.concatenate(grams[1:]))
        self.span = max(1, len(vocabulary))
        values = [grams[0][head], vocabulary]
        for column in grams[1:]:
            parents = int(number[-1]) + 1 if n else 0
            head = head.copy()
            head[1:] |= column[1:] != column[:-1]
            at = np.flatnonzero(head)
            values.append(np.searchsorted(number[at], np.arange(parents + 1)))
            values.append(number[at].astype(np.uint64) * np.uint64(self.span) + np.searchsorted(vocabulary, column[at]).astype(np.uint64))
            number = np.cumsum(head) - 1
        top = lambda v: int(v[-1]) + 1 if len(v) else 1
        parts = [Sequence.coded(v, top(v)) for v in values]
        arrays = [a for p in parts for a in (p[3], p[2])] + [codes]  # whole words first: their views stay aligned
        self.file = tempfile.TemporaryFile()  # without a name: gone with the process
        begins = []
        for a in arrays:
            begins.append(self.file.tell())
            self.file.write(a.tobytes() + bytes(-len(a) % 8))
        self.file.flush()
        self.bytes = self.file.tell()
        mapped = np.memmap(self.file, np.uint8, "r") if self.bytes else np.zeros(0, np.uint8)
        views = [mapped[at:at + len(a)] for at, a in zip(begins, arrays)]
        sequences = [Sequence(p[0], p[1], views[2 * i + 1], views[2 * i]) for i, p in enumerate(parts)]
        self.first, self.words = sequences[:2]
        self.levels = list(zip(sequences[2::2], sequences[3::2]))
        self.codes = views[-1]

    @staticmethod
    def _find(sequence: Sequence, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = sequence.successor(x)
        found = at < sequence.n
        found[found] = sequence.get(at[found]) == x[found]
        return at, found

    def _below(self, level: int, number: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of a level that are these words after these contexts, and whether they are there."""
        pointers, followers = self.levels[level]
        place, found = self._find(self.words, words)
        at, ask = np.zeros(len(words), np.int64), np.flatnonzero(found)
        at[ask], hit = self._find(followers, number[ask].astype(np.uint64) * np.uint64(self.span) + place[ask].astype(np.uint64))
        hit &= at[ask] < pointers.get(np.minimum(number[ask] + 1, pointers.n - 1)).astype(np.int64)
        found[ask] = hit
        return at, found

    def lookup(self, contexts: list[np.ndarray], sizes: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The code of each word after its context, 0 where the trie does not have it; a context stands for ``sizes`` words."""
        number, has = self._find(self.first, contexts[0])
        for level, column in enumerate(contexts[1:]):
            ask = np.flatnonzero(has)
            number[ask], has[ask] = self._below(level, number[ask], column[ask])
        number, has = np.repeat(number, sizes), np.repeat(has, sizes)
        out, ask = np.zeros(len(words), np.uint8), np.flatnonzero(has)
        if len(ask):
            at, found = self._below(len(contexts) - 1, number[ask], words[ask])
            out[ask[found]] = self.codes[at[found]]
        return out

    def close(self) -> None:
        self.file.close()
