"""Hash families shared by the digests; all values are the same on every machine."""

from __future__ import annotations

import math
from functools import lru_cache
from hashlib import blake2b

import numpy as np

#: The field of the permutations, and the range of a slot.
PRIME = (1 << 61) - 1
SLOT = 1 << 32
_P, _LOW32, _LOW29 = np.uint64(PRIME), np.uint64(SLOT - 1), np.uint64((1 << 29) - 1)
#: Shingles that one step takes, so that its matrices stay in cache.
STEP = 256


def hash64(text: str) -> int:
    """BLAKE2b of eight bytes over UTF-8, as a big-endian number."""
    return int.from_bytes(blake2b(text.encode("utf-8"), digest_size=8).digest(), "big")


@lru_cache(maxsize=64)
def coefficients(seed: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (from 1) and offsets (from 0) below PRIME, one of each for a slot."""
    a = [hash64(f"{seed}:a:{i}") % (PRIME - 1) + 1 for i in range(slots)]
    b = [hash64(f"{seed}:b:{i}") % PRIME for i in range(slots)]
    return np.array(a, np.uint64), np.array(b, np.uint64)


def permute(a: np.ndarray, b: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(a * h + b) mod PRIME for numbers below PRIME, by 32-bit limbs without overflow."""
    c32, c29, c61, c3 = np.uint64(32), np.uint64(29), np.uint64(61), np.uint64(3)
    a1, a0, h1, h0 = a >> c32, a & _LOW32, h >> c32, h & _LOW32
    middle = a1 * h0 + a0 * h1  # below 2**62; 2**61 is 1 in the field, so 2**64 is 8
    low = a0 * h0
    total = ((a1 * h1) << c3) + (middle >> c29) + ((middle & _LOW29) << c32) + (low & _P) + (low >> c61) + b
    total = (total & _P) + (total >> c61)
    return np.where(total >= _P, total - _P, total)


def minhash(shingles, seed: int, slots: int) -> np.ndarray:
    """Least permuted value of each slot, reduced to 32 bits; zeros for no shingle."""
    if not shingles:
        return np.zeros(slots, np.int64)
    a, b = coefficients(seed, slots)
    h = np.array([hash64(s) % PRIME for s in shingles], np.uint64)
    best = np.full(slots, SLOT - 1, np.uint64)
    for at in range(0, len(h), STEP):
        np.minimum(best, (permute(a[:, None], b[:, None], h[None, at : at + STEP]) & _LOW32).min(1), out=best)
    return best.astype(np.int64)


def gaussian(seed: int, plane: int, axis: int) -> float:
    """A standard normal number from a hash, by the cosine branch of Box-Muller."""
    raw = blake2b(f"{seed}:{plane}:{axis}".encode(), digest_size=16).digest()
    high, low = int.from_bytes(raw[:8], "big"), int.from_bytes(raw[8:], "big")
    return math.sqrt(-2.0 * math.log((high + 1) / (2**64 + 1))) * math.cos(2.0 * math.pi * (low / 2**64))


@lru_cache(maxsize=16)
def hyperplanes(seed: int, bits: int, dim: int) -> np.ndarray:
    """Matrix of bits x dim; made once on the driver and shipped, as libm may differ by machine."""
    return np.array([[gaussian(seed, p, d) for d in range(dim)] for p in range(bits)], np.float64).reshape(bits, dim)


def sign_bits(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Whether each dot product is at least zero; NaN is not.

    Sums run over dimensions in order, as a plain loop over one vector would.
    """
    dots = np.zeros((len(vectors), len(planes)))
    for d in range(planes.shape[1]):
        dots += vectors[:, d : d + 1] * planes[None, :, d]
    return dots >= 0.0
