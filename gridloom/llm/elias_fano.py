"""Non-decreasing whole numbers in near-minimal space, any of them found by a select.

Each number is cut in two: its low bits are stored as they are, its high bits in unary, as the ``i``-th one of a bit vector at
``high + i``. A sequence of ``n`` numbers up to ``u`` takes ``2 + log2(u / n)`` bits a number, and an eighth of a bit for the places of
every 256th one, from which a select counts on.
"""

from __future__ import annotations

import struct

import numpy as np

#: A place of every so many ones is kept, in 32 bits.
STEP = 256
_HEAD = struct.Struct("<QQB")


class EliasFano:
    """Numbers in a buffer that ``encode`` made; the buffer is not copied."""

    def __init__(self, buffer):
        self.n, self.last, self.low_bits = _HEAD.unpack_from(buffer)
        data = np.frombuffer(buffer, np.uint8, offset=_HEAD.size)
        low, high = _sizes(self.n, self.last, self.low_bits)
        self._low, self._high = data[:low], data[low : low + high]
        self._places = data[low + high : low + high + 4 * -(-self.n // STEP)].view("<u4")

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        """Bytes of non-decreasing unsigned numbers; ValueError where they decrease or their bits outgrow 32-bit places."""
        values = np.asarray(values, np.uint64)
        if (values[1:] < values[:-1]).any():
            raise ValueError("numbers must not decrease")
        n, last = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (last // n).bit_length() - 1) if n else 0
        low, high = _sizes(n, last, low_bits)
        if 8 * high >= 1 << 32:
            raise ValueError("too many numbers for one sequence")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(8 * high, np.uint8)
        bits[ones] = 1
        return _HEAD.pack(n, last, low_bits) + _packed(values, low_bits) + np.packbits(bits, bitorder="little").tobytes() + ones[::STEP].astype("<u4").tobytes()

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """The ``i``-th number: one select, and its low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self._places[i // STEP]), i % STEP
        word = int.from_bytes(self._high[at // 8 : at // 8 + 8].tobytes(), "little") >> at % 8 << at % 8
        base = at // 8
        while left >= word.bit_count():
            left -= word.bit_count()
            base += 8
            word = int.from_bytes(self._high[base : base + 8].tobytes(), "little")
        for _ in range(left):
            word &= word - 1
        high = 8 * base + (word & -word).bit_length() - 1 - i
        first = i * self.low_bits
        bits = int.from_bytes(self._low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little") >> first % 8
        return high << self.low_bits | bits & (1 << self.low_bits) - 1

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Numbers ``start`` to ``stop - 1`` (unsigned), by the places around them; only their part of the bits is read."""
        if stop <= start:
            return np.zeros(0, np.uint64)
        first = start // STEP
        after = -(-stop // STEP)
        lo = int(self._places[first]) // 8
        hi = int(self._places[after]) // 8 + 1 if after < len(self._places) else len(self._high)
        ones = np.flatnonzero(np.unpackbits(self._high[lo:hi], bitorder="little")[int(self._places[first]) - 8 * lo :]) + int(self._places[first])
        high = ones[start - first * STEP : stop - first * STEP] - np.arange(start, stop)
        return high.astype(np.uint64) << np.uint64(self.low_bits) | _unpacked(self._low, start, stop, self.low_bits)

    def first_at_least(self, value: int) -> int:
        """Place of the first number that is ``value`` or more; the length where none is."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self[mid] < value else (lo, mid)
        return lo


def _sizes(n: int, last: int, low_bits: int) -> tuple[int, int]:
    """Bytes of the low bits and of the high ones."""
    return -(-n * low_bits // 8), -(-(n + (last >> low_bits) + 1) // 8)


def _packed(values: np.ndarray, width: int, block: int = 8192) -> bytes:
    """The lowest ``width`` bits of each, one after another; a block is a whole number of bytes."""
    if not width:
        return b""
    bit = np.arange(width, dtype=np.uint64)
    return b"".join(np.packbits((values[k : k + block, None] >> bit & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes() for k in range(0, len(values), block))


def _unpacked(data: np.ndarray, start: int, stop: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(stop - start, np.uint64)
    first = start * width
    bits = np.unpackbits(data[first // 8 : -(-stop * width // 8)], bitorder="little")[first % 8 : first % 8 + (stop - start) * width]
    return (bits.reshape(-1, width).astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
