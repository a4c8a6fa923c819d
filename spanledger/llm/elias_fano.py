"""Monotone sequences in Elias-Fano form, held in a memory-mapped file and searched many keys at a time.

A value's low bits are stored as they are, its high bits in unary: a one for each
value, a zero for each step of the high part.  With the ones counted before each
word, the n-th value and the range of values that share a high part are found
without decoding the rest, at about two bits a value beyond the low bits.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

U64 = np.uint64


#: The place of the one of each rank in each byte.
IN_BYTE = np.array(
    [[([k for k in range(8) if byte >> k & 1] + [0] * 8)[rank] for rank in range(8)] for byte in range(256)], np.uint8
).ravel()


ONES, SIGNS = U64(0x0101010101010101), U64(0x8080808080808080)
FIVES, THREES, FIFTEENS = U64(0x5555555555555555), U64(0x3333333333333333), U64(0x0F0F0F0F0F0F0F0F)
#: Keys searched at a time: their arrays stay in a core's cache.
AT_ONCE = 1 << 14


def _select(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the one of this rank in each word."""
    sums = words - ((words >> U64(1)) & FIVES)
    sums = (sums & THREES) + ((sums >> U64(2)) & THREES)
    # Byte k: the ones in bytes 0 to k.
    sums = ((sums + (sums >> U64(4))) & FIFTEENS) * ONES
    rank = rank.astype(U64)
    # Bytes before whose end no more ones stand than the rank.
    shift = np.bitwise_count(((rank * ONES | SIGNS) - sums) & SIGNS).astype(U64) << U64(3)
    before = ((sums << U64(8)) >> shift) & U64(255)
    byte = (words >> shift) & U64(255)
    return shift.astype(np.int64) + IN_BYTE[(byte << U64(3) | (rank - before)).astype(np.int64)]


class Monotone:
    """A sorted sequence of numbers below 2**62."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.low, self.high, self.before = (arrays[k] for k in ("low", "high", "before"))
        self.n, self.bits, self.top = (int(x) for x in arrays["shape"])
        self.zeros = np.arange(len(self.before), dtype=np.int64) * 64 - self.before

    @staticmethod
    def arrays(values: np.ndarray) -> dict[str, np.ndarray]:
        """The parts that ``Monotone`` reads."""
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, ((top + 1) // n).bit_length() - 1) if n else 0
        index = np.arange(n, dtype=np.int64)
        unary = np.zeros(-(-(n + (top >> bits) + 3) // 64) * 64, np.uint8)
        unary[(values >> bits) + index] = 1
        high = np.packbits(unary, bitorder="little").view("<u8")
        ones = np.bitwise_count(high).astype(np.int64)
        low = np.zeros(n * bits // 64 + 2, U64)
        if bits:
            part = (values & ((1 << bits) - 1)).astype(U64)
            at, shift = index * bits >> 6, (index * bits & 63).astype(U64)
            np.add.at(low, at, part << shift)
            over = np.flatnonzero(shift.astype(np.int64) + bits > 64)
            np.add.at(low, at[over] + 1, part[over] >> (U64(64) - shift[over]))
        return {"low": low, "high": high, "before": np.cumsum(ones) - ones, "shape": np.array([n, bits, top])}

    def _low(self, index: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(index), np.int64)
        at, shift = index * self.bits >> 6, (index * self.bits & 63).astype(U64)
        value = self.low[at] >> shift
        # Shifting by 64 is undefined, so the next word comes in two steps.
        value |= (self.low[at + 1] << (U64(63) - shift)) << U64(1)
        return (value & U64((1 << self.bits) - 1)).astype(np.int64)

    def _begin(self, high: np.ndarray) -> np.ndarray:
        """The bit behind the zero that ends the part before: there the ones of this high part begin."""
        want = np.maximum(high - 1, 0)
        word = np.searchsorted(self.zeros, want, side="right") - 1
        return np.where(high > 0, word * 64 + _select(~self.high[word], want - self.zeros[word]) + 1, 0)

    def _range(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From and to which place the values have this high part."""
        place = self._begin(high)
        start = place - high
        word, shift = place >> 6, (place & 63).astype(U64)
        after = self.high[word] >> shift
        follow = self.high[np.minimum(word + 1, len(self.high) - 1)]
        after |= (follow << (U64(63) - shift)) << U64(1)
        gap = ~after
        run = np.bitwise_count((gap & (~gap + U64(1))) - U64(1)).astype(np.int64)
        # Parts of 64 values or more end where the next part begins.
        long = np.flatnonzero(run >= 64)
        if len(long):
            run[long] = self._begin(high[long] + 1) - (high[long] + 1) - start[long]
        return start, start + run

    def get(self, index: np.ndarray) -> np.ndarray:
        """The values at these places."""
        word = np.searchsorted(self.before, index, side="right") - 1
        place = word * 64 + _select(self.high[word], index - self.before[word])
        return (place - index) << self.bits | self._low(index)

    def find(self, values: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
        """The place of each value, -1 where it is missing or not ``wanted``."""
        out = np.full(len(values), -1, np.int64)
        inside = (values >= 0) & (values <= self.top) if self.n else np.zeros(len(values), bool)
        asked = np.flatnonzero(inside if wanted is None else inside & wanted)
        for at in range(0, len(asked), AT_ONCE):
            some = asked[at : at + AT_ONCE]
            out[some] = self._find(values[some])
        return out

    def _find(self, values: np.ndarray) -> np.ndarray:
        out = np.full(len(values), -1, np.int64)
        high, target = values >> self.bits, values & ((1 << self.bits) - 1)
        left, end = self._range(high)
        right = end.copy()
        open_ = np.flatnonzero(left < right)
        # Successor search among the values of one high part.
        while len(open_):
            middle = (left[open_] + right[open_]) >> 1
            below = self._low(middle) < target[open_]
            left[open_] = np.where(below, middle + 1, left[open_])
            right[open_] = np.where(below, right[open_], middle)
            open_ = open_[left[open_] < right[open_]]
        hit = np.flatnonzero(left < end)
        hit = hit[self._low(left[hit]) == target[hit]]
        out[hit] = left[hit]
        return out


class Mapped:
    """Arrays written to one file and mapped from it; the file has no name any more once it is open."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        file, path = tempfile.mkstemp(prefix="levels-")
        try:
            with os.fdopen(file, "wb") as out:
                places = {}
                for name, values in arrays.items():
                    places[name] = out.tell(), values.dtype, len(values)
                    raw = values.tobytes()
                    out.write(raw + bytes(-len(raw) % 8))
            size = os.path.getsize(path)
            # A plain view of the map: results of its own class are slower to make.
            whole = np.asarray(np.memmap(path, np.uint8, "r")) if size else np.zeros(0, np.uint8)
        finally:
            os.unlink(path)
        self.arrays = {
            name: whole[at : at + n * kind.itemsize].view(kind) for name, (at, kind, n) in places.items()
        }

    def monotone(self, name: str) -> Monotone:
        return Monotone({k: self.arrays[f"{name}.{k}"] for k in ("low", "high", "before", "shape")})
