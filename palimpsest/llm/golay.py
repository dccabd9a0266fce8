"""The binary Golay code: the codeword nearest to a segment of a fingerprint."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: The 64 bits are cut into segments (lowest bit, bits). At most 4 errors leave two segments with at most 2 errors in each.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Generator of the binary [23, 12, 7] Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and the error of weight 3 or less that each syndrome stands for."""

    def remainder(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= GENERATOR << (bit - 11)
        return v

    low = np.array([remainder(v) for v in range(1 << 12)], np.int32)
    high = np.array([remainder(v << 12) for v in range(1 << 11)], np.int32)
    errors = np.full(1 << 11, -1, np.int32)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            errors[low[e & 4095] ^ high[e >> 12]] = e
    assert (errors >= 0).all(), "the code is perfect"
    return low, high, errors


def codeword_index(v: np.ndarray) -> np.ndarray:
    """The 12 information bits of the codeword nearest to each 23-bit vector."""
    low, high, errors = golay_tables()
    return (v ^ errors[low[v & 4095] ^ high[v >> 12]]) >> 11
