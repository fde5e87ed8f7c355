"""Elias-Fano sequences and an n-gram trie of them, laid out in one file and memory-mapped for queries."""

from __future__ import annotations

import numpy as np

#: Queries or elements that are expanded into single bits at a time.
STRIP = 1 << 15
#: Widest low part: with the bits before it in its first byte, it lies within eight bytes.
WIDEST = 56


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest `width` bits of each value, end to end, and eight bytes of padding."""
    out = []
    for i in range(0, len(values) if width else 0, STRIP):  # a strip fills whole bytes
        bits = values[i : i + STRIP, None] >> np.arange(width, dtype=np.uint64) & np.uint64(1)
        out.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"))
    return np.concatenate([*out, np.zeros(8, np.uint8)])


class EliasFano:
    """A monotone sequence below a bound, searched without being decoded.

    Of each value, the low bits are stored as they are; the high parts are a bit vector in which every element is a one
    and every step to the next high part a zero.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, n: int, width: int):
        self.n, self.width, self.low, self.high = n, width, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones = np.concatenate(([0], np.cumsum(ones)))
        self.zeros = np.arange(len(high) + 1) * 64 - self.ones
        self.words = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))

    @staticmethod
    def encode(values: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(low bytes, high words, n, width of a low part) of sorted values below bound."""
        values = values.astype(np.uint64)
        n = len(values)
        width = min(WIDEST, max(0, (bound // max(n, 1)).bit_length() - 1))
        tops = (values >> np.uint64(width)).astype(np.int64)
        bits = np.zeros(-(-(n + (bound >> width) + 2) // 64) * 64, np.uint8)
        bits[tops + np.arange(n)] = 1
        return _pack(values, width), np.packbits(bits, bitorder="little").view("<u8"), n, width

    def _select(self, k: np.ndarray, sums: np.ndarray, flip: int) -> np.ndarray:
        """Place of the k-th (from 0) bit of the wanted kind."""
        out = np.empty(len(k), np.int64)
        for i in range(0, len(k), STRIP):
            part = k[i : i + STRIP]
            word = np.searchsorted(sums, part, side="right") - 1
            bits = np.unpackbits((self.high[word] ^ np.uint64(flip)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            left = part - sums[word]
            out[i : i + STRIP] = word * 64 + (np.cumsum(bits, axis=1, dtype=np.uint8) > left[:, None]).argmax(1)
        return out

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i * self.width
        return self.words[at >> 3] >> (at & 7).astype(np.uint64) & np.uint64((1 << self.width) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places i."""
        top = self._select(i, self.ones, 0) - i
        return top.astype(np.uint64) << np.uint64(self.width) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first element not below x, whether it is x)."""
        x = x.astype(np.uint64)
        top, rest = (x >> np.uint64(self.width)).astype(np.int64), x & np.uint64((1 << self.width) - 1)
        full = (1 << 64) - 1
        low = np.where(top > 0, self._select(np.maximum(top - 1, 0), self.zeros, full) - (top - 1), 0)
        end = self._select(top, self.zeros, full) - top
        high = end.copy()
        while (open_ := low < high).any():
            mid = (low + high) >> 1
            less = open_ & (self._low(np.minimum(mid, max(self.n - 1, 0))) < rest)
            low, high = np.where(less, mid + 1, low), np.where(open_ & ~less, mid, high)
        hit = low < end
        hit[hit] = self._low(low[hit]) == rest[hit]
        return low, hit


class Trie:
    """Two levels of an n-gram trie: contexts, and each context's successors with a quantised probability.

    Levels in the file: context hashes; pointers to each context's first successor (monotone); the successor words;
    for every successor its number among those words, relative to its context (context * words + number, monotone); and
    the codes of the probabilities.
    """

    LEVELS = ("contexts", "pointers", "vocabulary", "successors")

    @staticmethod
    def write(path: str, contexts: np.ndarray, sizes: np.ndarray, words: np.ndarray, codes: np.ndarray) -> list:
        """Lay the trie out in a file: contexts ascending, sizes[i] successors of each ascending. Returns the layout."""
        vocabulary = np.unique(words)
        owner = np.repeat(np.arange(len(contexts)), sizes)
        relative = owner * len(vocabulary) + np.searchsorted(vocabulary, words)
        pointers = np.concatenate(([0], np.cumsum(sizes)))
        base = int(contexts[0]) if len(contexts) else 0
        layout: list = [base, len(vocabulary)]
        with open(path, "wb") as f:
            for values, bound in (
                (contexts - np.uint64(base), (int(contexts[-1]) if len(contexts) else 0) - base + 1),
                (pointers, len(words) + 1),
                (vocabulary, 1 << 64),
                (relative, len(contexts) * len(vocabulary) + 1),
            ):
                low, high, n, width = EliasFano.encode(values, bound)
                f.write(b"\0" * (-f.tell() % 8))
                at = f.tell()
                f.write(high.tobytes() + low.tobytes())
                layout.append((at, len(high), len(low), n, width))
            f.write(b"\0" * (-f.tell() % 8))
            layout.append((f.tell(), len(codes)))
            f.write(codes.astype("<u2").tobytes() + b"\0" * 8)
        return layout

    def __init__(self, path: str, layout: list):
        raw = np.memmap(path, np.uint8, "r")
        self.base, self.words = np.uint64(layout[0]), layout[1]
        for name, (at, n_high, n_low, n, width) in zip(self.LEVELS, layout[2:-1], strict=True):
            high = raw[at : at + 8 * n_high].view("<u8")
            setattr(self, name, EliasFano(raw[at + 8 * n_high : at + 8 * n_high + n_low], high, n, width))
        at, n = layout[-1]
        self.codes = raw[at : at + 2 * n].view("<u2")
        self.last = int(self.contexts.get(np.array([self.contexts.n - 1]))[0]) if self.contexts.n else -1

    def context(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each context, -1 where unknown; number of its successors)."""
        found = np.full(len(hashes), -1, np.int64)
        size = np.zeros(len(hashes), np.int64)
        ok = np.flatnonzero((hashes >= self.base) & (hashes - self.base <= np.uint64(max(self.last, 0)))) if self.contexts.n else []
        if len(ok):
            at, hit = self.contexts.successor(hashes[ok] - self.base)
            found[ok[hit]] = at[hit]
            size[ok[hit]] = (self.pointers.get(at[hit] + 1) - self.pointers.get(at[hit])).astype(np.int64)
        return found, size

    def code(self, context: np.ndarray, words: np.ndarray, absent: int) -> np.ndarray:
        """Code of each (context number, word); absent where the context or the successor is unknown."""
        out = np.full(len(words), absent, np.int64)
        if not self.words:
            return out
        known, inverse = np.unique(words, return_inverse=True)
        number, hit = self.vocabulary.successor(known)
        ok = np.flatnonzero((context >= 0) & hit[inverse])
        at, hit = self.successors.successor(context[ok] * self.words + number[inverse[ok]])
        out[ok[hit]] = self.codes[at[hit]]
        return out
