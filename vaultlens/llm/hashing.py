"""Vectorised hashing of byte strings, on the executors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U64 = np.uint64
#: Odd multipliers, so that they have inverses modulo 2**64.
BASE = 0x9E3779B97F4A7C15
SECOND_BASE = 0xC2B2AE3D27D4EB4F


def byte_table(seed: int) -> np.ndarray:
    """A random odd 64-bit number for every byte."""
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    out = np.full(max(n, 1), base & (2**64 - 1), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


class Powers:
    """Powers of a base and of its inverse, grown to the longest text seen."""

    def __init__(self, base: int = BASE):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.zeros(0, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = powers(self.base, n), powers(self.inverse, n)


def prefix_hashes(values: np.ndarray, p: Powers) -> np.ndarray:
    """H with H[j] - H[i] = base**i * hash(values[i:j]); values are 64-bit."""
    p.grow(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p.up[: len(values)], out=out[1:])
    return out


def window_hashes(prefix: np.ndarray, k: int, p: Powers) -> np.ndarray:
    """The hash of every run of k values."""
    return (prefix[k:] - prefix[:-k]) * p.down[: len(prefix) - k]


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours, by running minima from both ends of blocks of w."""
    m = len(h)
    if m < w:
        return h[:0]
    padded = np.full(-(-m // w) * w, 2**64 - 1, np.uint64)
    padded[:m] = h
    rows = padded.reshape(-1, w)
    left = np.minimum.accumulate(rows, 1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: m - w + 1], left[w - 1 : m])


@dataclass
class Words:
    """The word hashes of several texts in a row; first[i]:first[i + 1] are those of text i."""

    hashes: np.ndarray
    first: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray, p: Powers, *, inside: np.ndarray, values: np.ndarray) -> Words:
    """Words, runs of the bytes marked in inside, of the texts data[offsets[i]:offsets[i + 1]]; they never cross texts."""
    within = inside[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before, after = np.r_[False, within[:-1]] if len(data) else within, np.r_[within[1:], False] if len(data) else within
    starts = np.flatnonzero(within & (~before | cut[:-1]))
    ends = np.flatnonzero(within & (~after | cut[1:])) + 1
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return Words(np.zeros(0, np.uint64), first)
    sizes = ends - starts
    chars = values[data[within]]
    begins = np.cumsum(sizes) - sizes
    at = np.arange(len(chars)) - np.repeat(begins, sizes)
    p.grow(int(sizes.max()) + 1)
    hashes = mixed(np.add.reduceat(chars * p.up[at], begins) + sizes.astype(np.uint64) * U64(SECOND_BASE))
    hashes[hashes == 0] = 1  # zero stands for what is past a text's end
    return Words(hashes, first)
