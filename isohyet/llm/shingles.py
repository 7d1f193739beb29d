"""Hashed word shingles and circulant MinHash signatures in numpy, for use inside tasks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Positions of the permuted table; each shingle is a place in it, and its K values are the K entries from there on.
TABLE_BITS = 21
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: ASCII letters in lower case, every other byte as it is; each byte as an odd 64-bit number.
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers (shift, multiply, shift, multiply, shift)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def _byte_numbers() -> np.ndarray:
    return mixed(_LOWER.astype(np.uint64), 7)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(1 << 17, 1 << n.bit_length())
        _POWERS.update(up=_powers(_BASE, size), down=_powers(_UNBASE, size))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each run of non-blank bytes, A-Z as a-z."""
    raw = np.frombuffer(text, dtype=np.uint8)
    solid = np.empty(len(raw) + 2, dtype=np.int8)
    solid[0] = solid[-1] = 0
    solid[1:-1] = ~_BLANK[raw]
    edges = np.flatnonzero(np.diff(solid))
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_byte_numbers()[raw] * up[:-1], out=total[1:])
        return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of `size` words; fewer words are one shingle, none give an empty set."""
    words = word_hashes(text.encode("utf-8", "surrogatepass")) if text else np.zeros(0, dtype=np.uint64)
    if not len(words):
        return words
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, size, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = mixed(out + words[k : len(words) - size + 1 + k], k + 1)
    return np.unique(out)


@lru_cache(maxsize=1)
def circulant(coordinates: int, seed: int, bits: int = TABLE_BITS) -> np.ndarray:
    """Row s holds the second permutation's values at s+1 ... s+coordinates, cyclically."""
    table = np.random.default_rng(seed).permutation(1 << bits).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([table, table[:coordinates]]), coordinates)


def signature(shingles: np.ndarray, coordinates: int, seed: int = 1) -> np.ndarray:
    """The first permutation places each shingle, the second, shifted step by step, gives all coordinates' minima."""
    view = circulant(coordinates, seed)
    places = (mixed(shingles, 99) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    out = np.full(coordinates, np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(places), 2048):
        np.minimum(out, view[places[at : at + 2048]].min(axis=0), out=out)
    return out


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each `rows` coordinates, different for each band."""
    block = values.reshape(-1, rows).astype(np.uint64)
    out = np.arange(len(block), dtype=np.uint64)
    for k in range(rows):
        out = mixed(out + block[:, k], k + 11)
    return out


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set alone."""
    with np.errstate(over="ignore"):
        a = mixed(shingles, 201).sum(dtype=np.uint64)
        b = np.bitwise_xor.reduce(mixed(shingles, 202)) + np.uint64(len(shingles))
    return int(a.view(np.int64)), int(b.view(np.int64))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
