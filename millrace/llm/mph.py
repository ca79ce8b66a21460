"""Minimal perfect hashing: n keys onto 0..n-1, by a cascade of bit arrays of keys that hash alone."""

from __future__ import annotations

import struct

import numpy as np

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _slot(h: np.ndarray, level: int, seed: int, size: int) -> np.ndarray:
    x = h + np.uint64(((level + 1) * 0x9E3779B97F4A7C15 + seed * 0xD6E8FEB86659FD93) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class MinimalPerfectHash:
    """Built over distinct 64-bit key hashes.

    On each level the keys left are hashed to twice as many bits; keys alone on
    their bit are settled there, the others go on.  A key's number is the rank
    of its bit, so a lookup reads a bit or two and one count: constant time, and
    about four bits a key.
    """

    def __init__(self, sizes: list[int], bits: np.ndarray, seed: int = 0):
        self.sizes, self.bits, self.seed = sizes, bits, seed
        self.ranks = np.r_[0, np.cumsum(np.bitwise_count(bits), dtype=np.int64)]

    def __len__(self) -> int:
        return int(self.ranks[-1])

    @classmethod
    def build(cls, hashes: np.ndarray, seed: int = 0) -> MinimalPerfectHash:
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("hashes must be distinct")
        left, sizes, levels = hashes, [], []
        while len(left):
            size = max(64, -(-2 * len(left) // 64) * 64)
            at = _slot(left, len(sizes), seed, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, "<u8"), seed)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each key; of a strange key some number, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        todo, base = np.arange(len(hashes)), 0
        for level, size in enumerate(self.sizes):
            at = base + _slot(hashes[todo], level, self.seed, size)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = (self.ranks[at >> 6] + below)[hit]
            todo, base = todo[~hit], base + size
        return out

    def to_bytes(self) -> bytes:
        return struct.pack("<QQQ", self.seed, len(self.sizes), len(self.bits)) + np.array(self.sizes, "<u8").tobytes() + self.bits.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[MinimalPerfectHash, int]:
        """The hash and how many bytes it took."""
        seed, levels, words = struct.unpack_from("<QQQ", data)
        sizes = np.frombuffer(data, "<u8", levels, 24).astype(int).tolist()
        end = 24 + 8 * levels
        return cls(sizes, np.frombuffer(data, "<u8", words, end), seed), end + 8 * words
