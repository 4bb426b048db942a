"""Elias-Fano coding of non-decreasing numbers, with a select structure.

n numbers below u take about 2 + log2(u / n) bits each: the low bits as they
are, the high bits in unary. Every STEP-th set bit of the unary part has its
place noted, so that select looks at a bounded stretch only.
"""

from __future__ import annotations

import struct
import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STEP = 256
HEAD = "<QQB"


def encode(values: np.ndarray) -> bytes:
    values = np.asarray(values, dtype=np.uint64)
    n = len(values)
    if not n:
        return struct.pack(HEAD, 0, 0, 0)
    top = int(values[-1])
    low = max(0, ((top + 1) // n).bit_length() - 1)
    bits = (values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
    place = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    unary = np.zeros((int(place[-1]) // 8 + 1) * 8, dtype=np.uint8)
    unary[place] = 1
    return struct.pack(HEAD, n, len(unary) // 8, low) + np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes() + np.packbits(unary, bitorder="little").tobytes() + place[::STEP].astype("<u4" if place[-1] < 1 << 32 else "<u8").tobytes()


class EliasFano:
    """Reads what encode wrote, from the start of buffer."""

    def __init__(self, buffer: bytes | memoryview):
        buffer = memoryview(buffer)
        self.n, size, self.low = struct.unpack_from(HEAD, buffer)
        at = struct.calcsize(HEAD)
        self.lows = np.frombuffer(buffer, np.uint8, (self.n * self.low + 7) // 8, at)
        at += len(self.lows)
        self.unary = np.frombuffer(buffer, np.uint8, size, at)
        at += size
        wide = "<u4" if 8 * size < 1 << 32 else "<u8"
        self.samples = np.frombuffer(buffer, wide, (self.n + STEP - 1) // STEP, at)
        self.size = at + self.samples.nbytes

    def select(self, i: int) -> int:
        """The i-th number, counted from 0."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // STEP]), i % STEP
        end = int(self.samples[i // STEP + 1]) if i // STEP + 1 < len(self.samples) else 8 * len(self.unary) - 1
        ones = np.flatnonzero(np.unpackbits(self.unary[place // 8 : end // 8 + 1], bitorder="little")) + place // 8 * 8
        high = int(ones[np.searchsorted(ones, place) + left]) - i
        first = i * self.low
        bits = np.unpackbits(self.lows[first // 8 : (first + self.low + 7) // 8], bitorder="little")[first % 8 : first % 8 + self.low]
        return (high << self.low) | sum(int(b) << k for k, b in enumerate(bits))

    def all(self) -> np.ndarray:
        """All numbers."""
        high = np.flatnonzero(np.unpackbits(self.unary, bitorder="little"))[: self.n] - np.arange(self.n)
        bits = np.unpackbits(self.lows, bitorder="little")[: self.n * self.low].reshape(self.n, self.low).astype(np.int64)
        return (high << self.low) + bits @ (1 << np.arange(self.low, dtype=np.int64))
