"""Minimal perfect hash of (key, copy) pairs, vectorised: levels of bit arrays.

Level l hashes the keys that are still open into ``2 * open`` slots; a slot hit by one key gets
a set bit, keys that share a slot go to the next level. A key's number is the rank of its bit,
so n keys get exactly the numbers 0..n-1. Keys left after ``LEVELS`` levels are stored by value.
Lookups try at most ``LEVELS`` levels, two on average.
"""

from __future__ import annotations

import numpy as np

LEVELS = 40
_U = np.uint64


def mix(key: np.ndarray, copy: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of int64 keys and small copy numbers (finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = key.astype(np.int64).view(_U) + copy.astype(_U) * _U(0xD6E8FEB86659FD93)
        x = x + _U((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def fingerprint(key: np.ndarray, copy: np.ndarray) -> np.ndarray:
    return (mix(key, copy, 1_000_003) >> _U(32)).astype(np.uint32)


class MinimalPerfectHash:
    def __init__(self, sizes, bits, left_key, left_copy):
        self.sizes, self.bits = [int(s) for s in sizes], bits  # bits: one packed array per level
        self.left_key, self.left_copy = left_key, left_copy
        self.ranks, total = [], 0
        for b in bits:
            counts = np.bitwise_count(b).astype(np.int64)
            self.ranks.append(total + np.concatenate([[0], np.cumsum(counts)[:-1]])
                              if len(b) else np.zeros(0, np.int64))
            total += int(counts.sum())
        self.n = total + len(left_key)

    @classmethod
    def build(cls, key: np.ndarray, copy: np.ndarray) -> "MinimalPerfectHash":
        """Of distinct (key, copy) pairs."""
        sizes, bits = [], []
        for level in range(LEVELS):
            if not len(key):
                break
            size = max(64, -(-2 * len(key) // 8) * 8)
            slot = (mix(key, copy, level) % _U(size)).astype(np.int64)
            alone = np.bincount(slot, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(alone, bitorder="little"))
            rest = ~alone[slot]
            key, copy = key[rest], copy[rest]
        return cls(sizes, bits, key.astype(np.int64), copy.astype(np.int64))

    def find(self, key: np.ndarray, copy: np.ndarray) -> np.ndarray:
        """The number of each pair; for pairs that were never added any number or -1 (compare
        the stored fingerprint)."""
        out = np.full(len(key), -1, np.int64)
        open_ = np.arange(len(key))
        for level, (size, b, rank) in enumerate(zip(self.sizes, self.bits, self.ranks)):
            if not len(open_):
                return out
            slot = (mix(key[open_], copy[open_], level) % _U(size)).astype(np.int64)
            byte, bit = slot >> 3, (slot & 7).astype(np.uint8)
            hit = (b[byte] >> bit) & 1 == 1
            below = np.bitwise_count(b[byte] & ((np.uint8(1) << bit) - np.uint8(1)))
            out[open_[hit]] = (rank[byte] + below)[hit]
            open_ = open_[~hit]
        base = self.n - len(self.left_key)
        for i in open_:
            at = np.flatnonzero((self.left_key == key[i]) & (self.left_copy == copy[i]))
            if len(at):
                out[i] = base + at[0]
        return out

    def arrays(self) -> dict[str, np.ndarray]:
        return {"sizes": np.array(self.sizes, np.int64),
                "bits": np.concatenate(self.bits) if self.bits else np.zeros(0, np.uint8),
                "left_key": self.left_key, "left_copy": self.left_copy}

    @classmethod
    def of(cls, a) -> "MinimalPerfectHash":
        ends = np.cumsum(a["sizes"] // 8)
        bits = [a["bits"][e - s // 8:e] for s, e in zip(a["sizes"], ends)]
        return cls(a["sizes"], bits, a["left_key"], a["left_copy"])
