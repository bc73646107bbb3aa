"""Elias-Fano sequences as flat files: rising whole numbers in about 2 + log2(universe / n) bits each."""

from __future__ import annotations

import numpy as np

BLOCK = 64
_ONES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)  # the lowest and the highest bit of each byte
_BYTE = np.zeros((256, 8), np.int64)  # place of the k-th set bit of a byte
for _b in range(256):
    _on = [k for k in range(8) if _b >> k & 1]
    _BYTE[_b, : len(_on)] = _on


def _section(*parts: np.ndarray) -> bytes:
    """Arrays one after another, each padded to 8 bytes."""
    return b"".join(x.tobytes() + bytes(-x.nbytes % 8) for x in parts)


def encode(values: np.ndarray) -> bytes:
    """The file of rising (or equal) uint64 numbers below 2^63, at most 2^30 of them. Besides the sequence it has the
    number of set bits before each 64 bits of the upper parts, which makes every select a search and one lookup."""
    values = values.astype(np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    low = min(56, max(0, (top // max(1, n)).bit_length() - 1))
    high = (values >> np.uint64(low)).astype(np.int64)
    bits = int(high[-1]) + n + 1 if n else 1
    blocks = -(-bits // BLOCK)
    upper = np.zeros(blocks * BLOCK, np.uint8)
    upper[high + np.arange(n)] = 1
    packed = np.packbits(upper, bitorder="little")
    before = np.concatenate(([0], np.cumsum(upper.reshape(blocks, BLOCK).sum(axis=1, dtype=np.int64)))).astype("<u4")
    lows = np.zeros(0, np.uint8)
    if low and n:
        spread = (values[:, None] >> np.arange(low, dtype=np.uint64)[None, :] & np.uint64(1)).astype(np.uint8) if n <= 1 << 16 else None
        if spread is None:
            parts = []
            for a in range(0, n, 1 << 16):  # whole bytes at each cut, as 2^16 is a multiple of 8
                part = values[a : a + (1 << 16)]
                parts.append(np.packbits((part[:, None] >> np.arange(low, dtype=np.uint64)[None, :] & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little"))
            lows = np.concatenate(parts)
        else:
            lows = np.packbits(spread.ravel(), bitorder="little")
    lows = np.concatenate([lows, np.zeros(8 + -(len(lows) + 8) % 8, np.uint8)])
    return _section(np.array([n, low, blocks, len(lows)], "<u8"), before, packed, lows)


class EliasFano:
    """A mapped sequence. `size` is the number of bytes it takes from the start of `data`."""

    def __init__(self, data: np.ndarray):
        data = data.view(np.ndarray)
        self.n, self.low, blocks, lows = (int(x) for x in data[:32].view("<u8"))
        at = 32
        self.before = data[at : at + 4 * (blocks + 1)].view("<u4")
        at += 8 * (blocks // 2 + 1)
        self.upper = data[at : at + 8 * blocks].view("<u8")
        at += 8 * blocks
        raw = data[at : at + lows]
        self.lows = np.lib.stride_tricks.as_strided(raw[:8].view("<u8"), (lows - 7,), (1,))
        self.size = at + lows
        self.bits = blocks * BLOCK

    def _clear(self) -> np.ndarray:
        """The number of bits that are not set before each 64."""
        return np.arange(len(self.before), dtype=np.uint32) * np.uint32(BLOCK) - self.before

    def _select(self, k: np.ndarray, clear: np.ndarray | None = None) -> np.ndarray:
        """The place of the k-th (from 0) bit that is set; with `clear`, of the k-th that is not."""
        before = self.before if clear is None else clear
        word = np.searchsorted(before, k.astype(np.uint32), "right") - 1
        left = (k - before[word]).astype(np.uint64)
        bits = self.upper[word]
        if clear is not None:
            bits = ~bits
        # Byte i of `upto` is the number of bits in the bytes 0 to i; all eight are compared with `left` at once.
        upto = np.bitwise_count(bits.view(np.uint8)).view("<u8") * _ONES
        octet = np.bitwise_count((left * _ONES | _TOPS) - upto & _TOPS).astype(np.uint64)
        shift = octet << np.uint64(3)
        own = bits >> shift & np.uint64(255)
        left -= upto << np.uint64(8) >> shift & np.uint64(255)
        return word * BLOCK + shift.view(np.int64) + _BYTE[own.view(np.int64), left.view(np.int64)]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low
        return self.lows[bit >> 3] >> (bit & 7).astype(np.uint64) & np.uint64((1 << self.low) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.uint64)
        return ((self._select(i) - i).astype(np.uint64) << np.uint64(self.low)) | self._low(i)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, the first of equal ones, or -1: the successors within one run of equal high parts."""
        values = np.asarray(values, np.uint64)
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        high = (values >> np.uint64(self.low)).astype(np.int64)
        zeros = self.bits - int(self.before[-1])
        asked = np.flatnonzero(high < zeros)
        high, want = high[asked], values[asked] & np.uint64((1 << self.low) - 1)
        start, clear = np.zeros(len(asked), np.int64), self._clear()
        some = np.flatnonzero(high > 0)
        start[some] = self._select(high[some] - 1, clear) - (high[some] - 1)
        end = self._select(high, clear) - high
        low, top, open_ = start.copy(), end.copy(), np.flatnonzero(start < end)
        while len(open_):  # within the numbers of one high part, which are many where a run is dense
            middle = (low[open_] + top[open_]) >> 1
            less = self._low(middle) < want[open_]
            low[open_[less]] = middle[less] + 1
            top[open_[~less]] = middle[~less]
            open_ = open_[low[open_] < top[open_]]
        inside = np.flatnonzero(low < end)
        hit = inside[self._low(low[inside]) == want[inside]]
        out[asked[hit]] = low[hit]
        return out
