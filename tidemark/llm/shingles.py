"""Sets of hashed word shingles of whole texts."""

from __future__ import annotations

import numpy as np

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 bytes; A-Z in lower case."""
    return text.encode().lower().split() if text else []


def word_hashes(found: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, found), np.uint64, len(found))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> _HALF)) * _MIX
    return values ^ (values >> _HALF)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; a shorter text is one shingle of all its words."""
    hashes = word_hashes(words(text))
    if len(hashes) == 0:
        return hashes
    width = min(size, len(hashes))
    count = len(hashes) - width + 1
    total = np.full(count, width, np.uint64)
    for k in range(width):
        total = total * _FACTOR + hashes[k : k + count]
    return np.unique(_mixed(total))


def set_key(tokens: np.ndarray) -> int:
    """A signed 64-bit key of a whole set."""
    from xxhash import xxh3_64_intdigest

    key = xxh3_64_intdigest(tokens.tobytes())
    return key - (1 << 64) if key >> 63 else key
