"""Counts over whole texts that quality operators share."""

from __future__ import annotations

import numpy as np

from tidemark.llm.shingles import word_hashes

SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\r\x0b\x0c"
_THREE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def repeated_words(found: list[bytes]) -> np.ndarray:
    """For each word whether a 3-word window with it is found twice or more in the text."""
    covered = np.zeros(len(found), bool)
    if len(found) < 3:
        return covered
    hashes = word_hashes(found)
    windows = hashes[:-2] * _THREE[0] + hashes[1:-1] * _THREE[1] + hashes[2:] * _THREE[2]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return covered


def base_counts(text: str, found: list[bytes], covered: np.ndarray) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    lines = [line for line in text.split("\n") if line.strip(_BLANKS)]
    return (
        len(found),
        len(text) - sum(map(text.count, _BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        int(covered.sum()),
    )
