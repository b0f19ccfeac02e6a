"""A minimal perfect hash over 64-bit key pairs, in NumPy.

Keys fall into shards by their leading bits. In a shard, every level hashes the keys that are left
into a bit array of twice their number; keys alone in their cell set its bit and are done, the
others go to the next level. A key's slot is the rank of its bit. Any key gets some slot or none, so
the second half of every key is stored by slot and compared at each look-up.
"""

from __future__ import annotations

import numpy as np

from orbweave.llm.wordblocks import mix

SHARD_BITS = 6
#: Two keys that no level tells apart would go on for ever; no set of distinct keys comes near.
MOST_LEVELS = 100
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0xD1B54A32D192ED03


def _cells(x: np.ndarray, level: int, size) -> np.ndarray:
    return (mix(x + np.uint64(_STEP * (level + 1) % (1 << 64))) % size).astype(np.int64)


def build_shard(k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the levels, bits of all levels packed, and ``k2`` in the order of the slots."""
    x = k1 + k2 * _ODD
    left, sizes, bits, places, offset = np.arange(len(x)), [], [], np.zeros(len(x), dtype=np.int64), 0
    while len(left):
        if len(sizes) == MOST_LEVELS:
            raise ValueError("keys are not distinct")
        size = 64 * -(-2 * len(left) // 64)
        cell = _cells(x[left], len(sizes), np.uint64(size))
        alone = np.bincount(cell, minlength=size) == 1
        done = alone[cell]
        places[left[done]] = offset + cell[done]
        sizes.append(size)
        bits.append(np.packbits(alone, bitorder="little"))
        left, offset = left[~done], offset + size
    packed = np.concatenate(bits) if bits else np.zeros(0, dtype=np.uint8)
    return np.array(sizes, dtype=np.int64), packed, k2[np.argsort(places)]


class PerfectHash:
    """Slots 0 .. n - 1 of n key pairs."""

    def __init__(self, shards: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]):
        """``shards``: (number, sizes, packed bits, stored keys) as of ``build_shard``, in any order."""
        shards = sorted(shards, key=lambda s: s[0])
        self.levels = max((len(s[1]) for s in shards), default=0)
        self.size = np.zeros((1 << SHARD_BITS, self.levels), dtype=np.uint64)
        self.offset = np.zeros((1 << SHARD_BITS, self.levels), dtype=np.int64)
        at = 0
        for number, sizes, _, _ in shards:
            self.size[number, : len(sizes)] = sizes
            self.offset[number, : len(sizes)] = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
        join = lambda k, kind: np.concatenate([s[k] for s in shards]).view(kind) if shards else np.zeros(0, dtype=kind)
        self.words = join(2, np.uint64)
        self.rank = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))))
        self.keys = join(3, np.uint64)

    def __len__(self) -> int:
        return len(self.keys)

    def slots(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Slot of each key pair, -1 for those not held."""
        out = np.full(len(k1), -1, dtype=np.int64)
        x, shard, left = k1 + k2 * _ODD, (k1 >> np.uint64(64 - SHARD_BITS)).astype(np.int64), np.arange(len(k1))
        for level in range(self.levels):
            size = self.size[shard[left], level]
            left, size = left[size > 0], size[size > 0]
            if not len(left):
                break
            bit = self.offset[shard[left], level] + _cells(x[left], level, size)
            word, low = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            hit = (word >> low) & np.uint64(1) == 1
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << low[hit]) - np.uint64(1)))
            out[left[hit]] = self.rank[bit[hit] >> 6] + below
            left = left[~hit]
        found = out >= 0
        found[found] = self.keys[out[found]] == k2[found]
        out[~found] = -1
        return out
