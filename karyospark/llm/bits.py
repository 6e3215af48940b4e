"""Vectorised 64-bit mixing, minimal perfect hashes and Bloom bit arrays (numpy)."""

from __future__ import annotations

import numpy as np

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(keys: np.ndarray, seed: int = 0) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit keys, another one for each seed."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + _GOLDEN * np.uint64(seed + 1)
        z = (z ^ (z >> np.uint64(30))) * _A
        z = (z ^ (z >> np.uint64(27))) * _B
        return z ^ (z >> np.uint64(31))


def get_bits(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1)


def _mix_two(keys: np.ndarray, seed: int) -> np.ndarray:
    return mix(keys[:, 0] ^ mix(keys[:, 1], 1), seed) ^ mix(keys[:, 1], seed + 2)


class MinimalPerfectHash:
    """Levels of bit arrays: a key sits at the first level where no other remaining key shares its bit.

    About 3.7 bits a key at ``gamma`` 2.  ``lookup`` gives each of the n keys
    its own number from 0 to n-1; other keys get -1 or any number, so callers
    compare a stored fingerprint or the key itself.  Keys must be distinct.
    """

    def __init__(self, levels: list[np.ndarray], sizes: list[int]):
        self.levels, self.sizes = levels, sizes
        counts = np.concatenate([np.zeros(1, np.int64), *(np.bitwise_count(x).astype(np.int64) for x in levels)]) if levels else np.zeros(1, np.int64)
        self.before = np.cumsum(counts)
        self.starts = np.cumsum([0, *(len(x) for x in levels)])

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0, max_levels: int = 64) -> MinimalPerfectHash:
        left, levels, sizes = np.asarray(keys, np.uint64), [], []
        while len(left):
            if len(levels) == max_levels:
                raise ValueError("keys are not distinct")
            m = max(8, int(gamma * len(left)) + 7 & ~7)
            at = (mix(left, len(levels)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            sizes.append(m)
            left = left[~alone[at]]
        return cls(levels, sizes)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, np.uint64)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for k, (bits, m) in enumerate(zip(self.levels, self.sizes, strict=True)):
            if not len(todo):
                break
            at = mix(keys[todo], k) % np.uint64(m)
            byte = (at >> np.uint64(3)).astype(np.int64)
            low = (at & np.uint64(7)).astype(np.uint8)
            hit = (bits[byte] >> low) & np.uint8(1) == 1
            b, below = byte[hit], (np.uint8(1) << low[hit]) - np.uint8(1)
            out[todo[hit]] = self.before[self.starts[k] + b] + np.bitwise_count(bits[b] & below)
            todo = todo[~hit]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.sizes), *self.sizes], np.int64)
        return head.tobytes() + b"".join(x.tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> MinimalPerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes = np.frombuffer(data, np.int64, n, 8).tolist()
        levels, at = [], 8 * (n + 1)
        for m in sizes:
            levels.append(np.frombuffer(data, np.uint8, m // 8, at))
            at += m // 8
        return cls(levels, sizes)


class BloomBits:
    """A Bloom filter over 128-bit keys (rows of two numbers); positions depend on the seed."""

    def __init__(self, bits: np.ndarray, m: int, k: int, seed: int):
        self.bits, self.m, self.k, self.seed = bits, m, k, seed

    @classmethod
    def build(cls, keys: np.ndarray, rate: float, seed: int) -> BloomBits:
        rate = min(max(rate, 1e-6), 0.5)
        m = max(64, int(np.ceil(len(keys) * -np.log(rate) / np.log(2) ** 2)) + 7 & ~7)
        k = max(1, round(-np.log2(rate)))
        flags = np.zeros(m, bool)
        for i in range(k):
            flags[(_mix_two(keys, seed * 64 + i) % np.uint64(m)).astype(np.int64)] = True
        return cls(np.packbits(flags, bitorder="little"), m, k, seed)

    def test(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for i in range(self.k):
            out &= get_bits(self.bits, _mix_two(keys, self.seed * 64 + i) % np.uint64(self.m)).astype(bool)
        return out

    def to_bytes(self) -> bytes:
        return np.array([self.m, self.k, self.seed], np.int64).tobytes() + self.bits.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> BloomBits:
        m, k, seed = np.frombuffer(data, np.int64, 3).tolist()
        return cls(np.frombuffer(data, np.uint8, -1, 24), m, k, seed)
