"""Whole texts as bytes, piece by piece, so that the lists made on the way stay small."""

from __future__ import annotations

import re
from collections.abc import Iterator

PIECE_BYTES = 1_000_000
SPACE = b" \t\n\x0b\x0c\r"
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def pieces(data: bytes, most: int = PIECE_BYTES) -> Iterator[bytes]:
    """Consecutive parts of about ``most`` bytes, cut where a blank is; a longer word stays whole.

    ``split()`` of the parts gives the runs of bytes other than blanks (0x20 and 0x09-0x0D).
    """
    if len(data) <= most:
        yield data
        return
    start = 0
    while start < len(data):
        cut = _GAP.search(data, start + most)
        end = cut.start() if cut else len(data)
        yield data[start:end]
        start = end


def count_of(data: bytes, characters: bytes) -> int:
    """How many of the one-byte ``characters`` there are."""
    return len(data) - len(data.translate(None, characters))
