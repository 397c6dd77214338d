"""Fuzzy hashing with the perfect binary Golay code of 23 bits.

Every 23-bit word is within 3 bits of exactly one codeword. Of two words that differ in one bit, either both decode
to one codeword, or each has its own codeword 3 bits away and the other's 4 bits away. So a word's own codeword is
always among the codewords within 4 bits of the other: six at most, one where its own is within 2 bits.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

# Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low and high half words, and for each syndrome the error patterns to nearby codewords: own
    first, then those of weight 4, -1 where there is none."""

    def syndrome(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    unit = [syndrome(1 << i) for i in range(23)]
    low, high = np.zeros(1 << 12, dtype=np.int32), np.zeros(1 << 11, dtype=np.int32)
    for table, first in ((low, 0), (high, 12)):
        for i in range(len(table).bit_length() - 1):
            table[1 << i : 2 << i] = table[: 1 << i] ^ unit[first + i]
    near = np.full((1 << 11, 6), -1, dtype=np.int32)
    used = np.zeros(1 << 11, dtype=np.int32)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = 0
            for b in bits:
                s ^= unit[b]
            if weight == 4 and bin(int(near[s, 0])).count("1") != 3:
                continue
            near[s, used[s]] = sum(1 << b for b in bits)
            used[s] += 1
    return low, high, near


def nearby(words: np.ndarray) -> np.ndarray:
    """For each word, the indices (12 bits) of the codewords within 4 bits that matter, own first, then -1."""
    low, high, near = _tables()
    words = words.astype(np.int64)
    errors = near[low[words & 0xFFF] ^ high[words >> 12]]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)
