"""The binary Golay code (23, 12): fuzzy keys of 23-bit words, built from the generator polynomial.

A word's keys are the indices of all codewords within distance 4: the nearest one (the code is perfect, so it is within
3), and, for words at distance 3, the five others at distance 4. Two words at distance 2 or less always share a key:
if one is within 2 of its codeword, the other is within 4 of it; if both are at 3 of different codewords, a block of
the Steiner system S(4, 7, 23) through three error places and one differing place is a codeword within 4 of both.
``tests/llm/test_simhash.py`` goes through all error patterns.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, DIMENSION = 23, 12
POLYNOMIAL = 0b101011100011
PAD = -1


def _syndrome_of(word: int) -> int:
    for bit in range(LENGTH - 1, LENGTH - DIMENSION - 1, -1):
        if word >> bit & 1:
            word ^= POLYNOMIAL << (bit - 11)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the upper and lower halves of a word, and by syndrome up to six error patterns of weight 4 or less."""
    unit = [_syndrome_of(1 << b) for b in range(LENGTH)]
    halves = np.zeros((2, 1 << 12), np.int64)
    for h in range(2):
        for b in range(12 if h == 0 else 11):
            s = np.arange(1 << 12) >> b & 1 == 1
            halves[h, s] ^= unit[b + 12 * h]
    patterns: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for places in combinations(range(LENGTH), weight):
            s = 0
            for p in places:
                s ^= unit[p]
            patterns[s].append(sum(1 << p for p in places))
    table = np.full((1 << 11, 6), PAD, np.int64)
    for s, own in enumerate(patterns):
        table[s, : len(own)] = own
    return halves, table


def fuzzy_keys(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word, a row of up to six codeword indices (12 bits), padded with -1."""
    halves, table = _tables()
    w = words.astype(np.int64)
    errors = table[halves[0, w & 0xFFF] ^ halves[1, w >> 12]]
    return np.where(errors == PAD, PAD, (w[:, None] ^ errors) >> (LENGTH - DIMENSION))
