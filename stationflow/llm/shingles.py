"""Word shingles of texts as sorted sets of 64-bit hashes, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import slices

SHINGLE_WORDS = 5
SLICE_BYTES = 250_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)

# Lower case for A-Z, and which bytes belong to words: digits, a-z, and all of characters from U+0080 on.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word in order, and how many each text has."""
    raw = _LOWER[np.frombuffer(b"\x00".join(data) + b"\x00", dtype=np.uint8)]
    word = _IS_WORD[raw]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.cumsum(np.array([len(d) + 1 for d in data]))
    counts = np.diff(np.concatenate([[0], np.searchsorted(start, ends)]))
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(raw) - 1, _BASE)]))
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(raw) - 1, _INVERSE)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power)])
    return mix((sums[end] - sums[start]) * back[start]), counts


def shingle_sets(texts: list[str | None], size: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted, different hashes of its runs of ``size`` words.

    A text of fewer words, but not none, has one shingle of all its words.
    """
    data = [(t or "").encode("utf-8", "replace") for t in texts]
    with np.errstate(over="ignore"):
        for lo, hi in slices([len(d) for d in data], SLICE_BYTES):
            words, counts = _word_hashes(data[lo:hi])
            run = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
            for j in range(size):
                run = run * _STEP + words[j : j + len(run)]
            run = mix(run)
            at = 0
            for n in counts.tolist():
                if n >= size:
                    x = np.sort(run[at : at + n - size + 1])
                    yield x[np.concatenate([[True], x[1:] != x[:-1]])]
                elif n:
                    one = np.uint64(n)
                    for w in words[at : at + n]:
                        one = one * _STEP + w
                    yield mix(np.array([one], dtype=np.uint64))
                else:
                    yield np.empty(0, dtype=np.uint64)
                at += n
