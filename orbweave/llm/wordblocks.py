"""Word arithmetic on whole blocks of text with NumPy.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which is what
``bytes.split()`` yields and what the pattern ``[^\\x20\\x09-\\x0D]+`` matches.
Hashes are 64-bit polynomials over random byte values, finished by an
avalanche step; they depend on the word's bytes only, never on the process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

BYTE_VALUES = np.random.Generator(np.random.PCG64(20240117)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[65:91] = BYTE_VALUES[97:123]

_powers: dict[str, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done, step = 1, base
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(step)
        done, step = done + take, step * step & _MASK
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, SLICE + 1024)
        _powers["up"] = _power_table(_BASE, size)
        _powers["down"] = _power_table(pow(_BASE, -1, 1 << 64), size)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche step on uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxhash64_long(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of 8-byte integers, equal to the SQL function ``xxhash64`` on a bigint column."""
    h = np.uint64(seed) + _P5 + np.uint64(8)
    h = _rotate(h ^ (_rotate(x.view(np.uint64) * _P2, 31) * _P1), 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def word_hashes(data: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words of data, in order."""
    a = np.frombuffer(data, dtype=np.uint8)
    values = LOWER_VALUES if lower else BYTE_VALUES
    starts, hashes, at, n = [], [], 0, len(a)
    while at < n:
        to = min(n, at + SLICE)
        while to < n and not IS_SPACE[a[to]]:  # the slice ends where a word ends
            gap = np.flatnonzero(IS_SPACE[a[to : to + 4096]])
            to += int(gap[0]) if len(gap) else min(4096, n - to)
        part = a[at:to]
        space = np.empty(len(part) + 2, dtype=np.int8)
        space[0] = space[-1] = 1
        space[1:-1] = IS_SPACE[part]
        turn = np.diff(space)
        s, e = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
        if len(s):
            up, down = powers(len(part) + 1)
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(values[part] * up[: len(part)], out=sums[1:])
            h = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
            starts.append(s + at)
            hashes.append(mix(h))
        at = to
    if not starts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


class Block:
    """Some documents: words of document i are ``hashes[first[i]:first[i + 1]]``."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.texts = texts
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        begin = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum(lengths + 1, out=begin[1:])
        starts, self.hashes = word_hashes(b" ".join(texts), lower)
        self.first = np.searchsorted(starts, begin)
        self.n_words = np.diff(self.first)
        self.starts, self.begin = starts, begin


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(batch: pa.RecordBatch, text: str = "text", limit: int = 2 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of consecutive rows with about ``limit`` bytes of text each, as (first row, texts)."""
    column = batch.column(batch.schema.get_field_index(text))
    n, step = batch.num_rows, 256
    held: list[bytes] = []
    begin = size = 0
    for at in range(0, n, step):
        for i, t in enumerate(text_bytes(column.slice(at, step)), at):
            if held and size + len(t) > limit:
                yield begin, held
                held, begin, size = [], i, 0
            held.append(t)
            size += len(t)
    if held:
        yield begin, held


def windows(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive words, also across documents: callers mask those."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    base = (_BASE * (2 * seed + 3)) & _MASK | 1
    up, down = _power_table(base, len(hashes) + 1), _power_table(pow(base, -1, 1 << 64), len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[width:] - sums[:n]) * down[:n] + np.uint64(seed))


def shingles(block: Block, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all documents in order, and the offsets of each document's run.

    A document with fewer words than ``width`` has one shingle, its whole sequence; none without words.
    """
    n = block.n_words
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    first = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(count, out=first[1:])
    out = np.zeros(int(first[-1]), dtype=np.uint64)
    full = n >= width
    w = windows(block.hashes, width, 1)
    if full.any():
        reps = count[full]
        at = np.repeat(block.first[:-1][full], reps) + _ramp(reps)
        out[np.repeat(first[:-1][full], reps) + _ramp(reps)] = w[at]
    for i in np.flatnonzero((n > 0) & ~full):
        h = block.hashes[block.first[i] : block.first[i + 1]]
        weights = _power_table(0x2545F4914F6CDD1D, len(h) + 1)[1:]
        out[first[i]] = mix(np.array([(h * weights).sum(dtype=np.uint64) ^ np.uint64(len(h))], dtype=np.uint64))[0]
    return out, first


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of counts, one after the other."""
    total = int(counts.sum())
    begin = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) - np.repeat(begin, counts)


ramp = _ramp
