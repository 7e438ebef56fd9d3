"""Elias-Fano coding of a non-decreasing sequence with select structures.

A value's low ``width`` bits are packed; its high part is a run of zeros ended by a one. About
``2 + log2(largest / count)`` bits a value, plus one 32-bit select sample for every ``STEP``
values; there is no table of 64-bit offsets.

Layout, little-endian: magic ``EF01``, count u64, largest u64, width u8, number of high bytes u64,
low bytes, high bytes, samples (u32: byte of the high part with every STEP-th one; u8: ones before
it in that byte).
"""

from __future__ import annotations

import struct

import numpy as np

STEP = 256
_HEAD = struct.Struct("<4sQQBQ")
_ONES = np.array([bin(b).count("1") for b in range(256)], np.int64)


def encode(values: np.ndarray) -> bytes:
    v = np.asarray(values, np.uint64)
    n = len(v)
    if n and (np.diff(v.astype(np.int64)) < 0).any():
        raise ValueError("values must not decrease")
    top = int(v[-1]) if n else 0
    width = max(0, (top // n).bit_length() - 1) if n else 0
    low = np.packbits(((v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") if width else np.zeros(0, np.uint8)
    at = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
    size = (int(at[-1]) >> 3) + 1 if n else 0
    bits = np.zeros(size * 8, np.uint8)
    bits[at] = 1
    high = np.packbits(bits, bitorder="little")
    picked = at[::STEP]
    before = [int(_ONES[high[p >> 3] & ((1 << (p & 7)) - 1)]) for p in picked.tolist()]
    return _HEAD.pack(b"EF01", n, top, width, len(high)) + low.tobytes() + high.tobytes() + (picked >> 3).astype("<u4").tobytes() + np.array(before, np.uint8).tobytes()


class EliasFano:
    """Reads what ``encode`` made; holds only the coded bytes."""

    def __init__(self, data: bytes):
        magic, self.count, self.largest, self.width, n_high = _HEAD.unpack_from(data)
        if magic != b"EF01":
            raise ValueError("not an Elias-Fano file")
        at = _HEAD.size
        n_low = (self.count * self.width + 7) // 8
        self.low = np.frombuffer(data, np.uint8, n_low, at)
        self.high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        n_samples = -(-self.count // STEP)
        self.sample = np.frombuffer(data, "<u4", n_samples, at + n_low + n_high)
        self.before = np.frombuffer(data, np.uint8, n_samples, at + n_low + n_high + 4 * n_samples)

    def __len__(self) -> int:
        return self.count

    def select(self, i: int) -> int:
        """Value number ``i``."""
        return int(self.values(i, i + 1)[0])

    def values(self, start: int, stop: int) -> np.ndarray:
        """Values ``start`` up to ``stop``, from the nearest select sample on."""
        if not 0 <= start <= stop <= self.count:
            raise IndexError((start, stop))
        if start == stop:
            return np.zeros(0, np.int64)
        s = start // STEP
        end = (stop - 1) // STEP + 1
        first, last = int(self.sample[s]), int(self.sample[end]) + 1 if end < len(self.sample) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[first:last], bitorder="little"))[int(self.before[s]) :] + 8 * first
        ones = ones[start - s * STEP : stop - s * STEP]
        high = (ones - np.arange(start, stop)).astype(np.int64)
        if not self.width:
            return high
        a, b = start * self.width, stop * self.width
        bits = np.unpackbits(self.low[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 : (a & 7) + b - a].reshape(-1, self.width)
        return (high << self.width) | (bits.astype(np.int64) << np.arange(self.width)).sum(axis=1)
