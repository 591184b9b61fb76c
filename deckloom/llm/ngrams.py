"""Hashes of words and hashed n-grams of characters, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Buckets that n-grams are hashed to.
BITS = 20
#: Characters that are turned into n-grams at once.
BLOCK_CHARS = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """Two 64-bit hashes of each word, in order: the halves of XXH3-128 of its bytes, one row for each word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, text.split())), ">u8").astype(np.uint64).reshape(-1, 2)


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive hashes, put together from hashes of 1, 2, 4, ... in a row.

    What is put together is mixed each time, so no rule among the hashes of a run carries over to the result.
    """
    most = len(h) - n + 1
    if most <= 0:
        return np.zeros(0, np.uint64)
    power, size, at, out = h, 1, 0, None
    while True:
        if n & size:
            part = power[at : at + most]
            out = part if out is None else mixed(out * _MULTIPLIER + part)
            at += size
        if at == n:
            return out
        power = mixed(power[:-size] * _MULTIPLIER + power[size:])
        size *= 2


def buckets(h: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (mixed(h) >> np.uint64(64 - bits)).astype(np.int32)


def code_points(text: str) -> np.ndarray:
    """The characters of a text as numbers."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def char_buckets(chars: np.ndarray, orders: tuple[int, ...], bits: int = BITS) -> Iterator[np.ndarray]:
    """Buckets of the character n-grams of each order, smallest first, a block of a long text at a time.

    An n-gram's bucket is the top bits of a 32-bit FNV hash of its code points that is mixed with n.
    """
    for first in range(0, max(1, len(chars)), BLOCK_CHARS):
        a = chars[first : first + BLOCK_CHARS + max(orders) - 1]
        h, size = np.full(len(a), 0x811C9DC5, np.uint32), 0
        for n in sorted(orders):
            if len(a) < n:
                break
            while size < n:
                h = h[: len(a) - size] * np.uint32(0x01000193) + a[size:]
                size += 1
            g = h[:BLOCK_CHARS] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
            g = (g ^ (g >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            g = (g ^ (g >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            yield (g >> np.uint32(32 - bits)).astype(np.int32)


class Distinct:
    """Drops repeats from arrays of buckets in linear time; keeps one scratch array."""

    def __init__(self, bits: int = BITS):
        self.last = np.empty(1 << bits, np.int32)

    def __call__(self, parts: list[np.ndarray]) -> np.ndarray:
        if not parts:
            return np.zeros(0, np.int32)
        x = np.concatenate(parts)
        place = np.arange(len(x), dtype=np.int32)
        self.last[x] = place
        return x[self.last[x] == place]
