"""Hashed text features: word n-grams with skip-grams, and character n-grams. Pure functions of a text."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_WORD = re.compile(r"[^\W_]+")
_LETTER = re.compile(r"[^\W\d_]")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """Word to 64-bit hash; emptied when full, so that its memory stays bounded."""

    MOST = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def has_letter(text: str) -> bool:
    return _LETTER.search(text) is not None


def word_hashes(text: str, cache: WordHashes) -> np.ndarray:
    words = _WORD.findall(text.lower())
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def word_gram_buckets(text: str, bits: int, cache: WordHashes, skips: int = 2) -> np.ndarray:
    """Buckets of every word, every pair of neighbours and every pair with up to ``skips`` words between."""
    h = word_hashes(text, cache)
    parts = [_bucket(h, bits)]
    for gap in range(1, skips + 2):
        if len(h) > gap:
            salt = np.uint64(gap * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
            parts.append(_bucket((h[:-gap] * _ODD) ^ (h[gap:] + salt), bits))
    return np.concatenate(parts)


_FOLD: np.ndarray | None = None


def _fold() -> np.ndarray:
    """Code point to itself if it is a letter, else to a space."""
    global _FOLD
    if _FOLD is None:
        points = np.arange(0x110000, dtype=np.uint32)
        keep = np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)
        _FOLD = np.where(keep, points, np.uint32(32))
    return _FOLD


def char_gram_counts(text: str, bits: int, orders: tuple[int, ...], chunk: int = 1 << 20) -> np.ndarray:
    """Counts by bucket of the n-grams of a whole text, lower-cased, with non-letters as spaces; long texts in pieces."""
    counts = np.zeros(1 << bits, np.int64)
    widest = max(orders)
    low = text.lower()
    for at in range(0, max(1, len(low)), chunk):
        piece = low[at : at + chunk + widest - 1]
        own = min(chunk, len(low) - at)
        c = _fold()[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
        h = np.zeros(len(c), np.uint64)
        for n in range(1, widest + 1):
            if len(c) < n:
                break
            h = (h[: len(c) - n + 1] * _ODD + c[n - 1 :] + np.uint64(1)) if n > 1 else c + np.uint64(1)
            if n in orders:
                first = h[:own]
                counts += np.bincount(_bucket(first * _ODD + np.uint64(n), bits), minlength=1 << bits)
    return counts
