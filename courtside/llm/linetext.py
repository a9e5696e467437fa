"""Normalised lines of many texts at once: their words, an identity hash and a SimHash each.

All texts of a chunk are laid end to end as bytes, so words and lines are found and hashed by
whole-array arithmetic. A word's hash is a polynomial in its bytes, a line's identity a polynomial in
its words' hashes; both come from prefix sums modulo 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

BITS = 60
# Words shorter than this do not count in a fingerprint, unless a line has no others.
TELLING_BYTES = 4
# Texts are hashed in stretches of whole lines of about this many bytes.
STRETCH = 1 << 17
_BYTE_FACTOR, _WORD_FACTOR = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_LANES = np.uint64(0x0101010101010101)
# Words a byte-wide counter can add up.
_LANE_WORDS = 255

# Lower-case text as bytes: ASCII that is no letter or digit becomes a space, digits become 0, line ends stay.
_TABLE = bytes(
    10 if c == 10 else 48 if 48 <= c <= 57 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def normal_bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").translate(_TABLE)


def normal_form(line: str) -> str:
    """Lower-cased words of a line, digits as 0, one space between them."""
    return b" ".join(normal_bytes(line).split()).decode("utf-8", "surrogatepass")


def mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(32))


@lru_cache(maxsize=12)
def _powers(factor: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """factor^i and factor^-i modulo 2^64."""
    inverse = pow(factor, -1, 1 << 64)
    both = []
    for base in (factor, inverse):
        row = np.full(size, base, dtype=np.uint64)
        row[0] = 1
        both.append(np.cumprod(row, dtype=np.uint64))
    return both[0], both[1]


def _room(size: int) -> int:
    """Sizes are rounded up, so that the powers of few sizes are kept."""
    return max(1 << 14, 1 << (size - 1).bit_length()) if size else 1 << 14


def _span_hash(values: np.ndarray, first: np.ndarray, last: np.ndarray, factor: int) -> np.ndarray:
    """Polynomial hash of each values[first:last], whatever its place."""
    up, down = _powers(factor, _room(len(values)))
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=sums[1:])
    return (sums[last] - sums[first]) * down[first]


@dataclass
class Lines:
    """Lines with a word, of one stretch: the text's row, the line's number in it, and where it lies in ``held``."""

    held: bytes
    rows: np.ndarray
    numbers: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    forms: np.ndarray
    prints: np.ndarray | None

    def text(self, i: int) -> str:
        return b" ".join(self.held[self.starts[i] : self.ends[i]].split()).decode("utf-8", "surrogatepass")


def _prints(hashes: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SimHash of each line: a bit is set if it is in over half of the line's word hashes."""
    if not len(counts):
        return np.empty(0, dtype=np.uint64)
    parts = -(-counts // _LANE_WORDS)
    of = np.repeat(np.arange(len(counts)), parts)
    begin = np.cumsum(parts) - parts
    starts = first[of] + _LANE_WORDS * (np.arange(len(of)) - begin[of])
    ones = np.empty((len(of), 64), dtype=np.int32)
    for lane in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(lane)) & _LANES, starts)
        ones[:, lane::8] = sums.view(np.uint8).reshape(-1, 8)
    if len(of) > len(counts):
        ones = np.add.reduceat(ones, begin, axis=0)
    bits = 2 * ones > counts[:, None]
    bits[:, BITS:] = False
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def read_lines(texts: list[str | None], with_prints: bool = True) -> Iterator[Lines]:
    """The worded lines of all texts, stretch by stretch."""
    normal = [normal_bytes(text) if text else b"" for text in texts]
    counts = np.array([one.count(b"\n") + 1 for one in normal], dtype=np.int64)
    held = b"\n".join(normal) + b"\n"
    whole = np.frombuffer(held, dtype=np.uint8)
    breaks = np.flatnonzero(whole == 10)
    rows = np.repeat(np.arange(len(texts)), counts)
    numbers = np.arange(len(breaks)) - np.repeat(np.cumsum(counts) - counts, counts)
    low = 0
    while low < len(breaks):
        begin = int(breaks[low - 1]) + 1 if low else 0
        high = max(int(np.searchsorted(breaks, begin + STRETCH, side="right")), low + 1)
        end = int(breaks[high - 1]) + 1
        yield _stretch(held[begin:end], whole[begin:end], breaks[low:high] - begin, rows[low:high], numbers[low:high], with_prints)
        low = high


def _stretch(held: bytes, part: np.ndarray, breaks: np.ndarray, rows: np.ndarray, numbers: np.ndarray, with_prints: bool) -> Lines:
    gap = part <= 32
    before = np.concatenate(([True], gap[:-1]))
    starts, ends = np.flatnonzero(before & ~gap), np.flatnonzero(gap & ~before)
    line_starts = np.concatenate(([0], breaks[:-1] + 1))
    first, last = np.searchsorted(starts, line_starts), np.searchsorted(starts, breaks)
    kept = np.flatnonzero(last > first)
    first, last = first[kept], last[kept]
    hashes = mix(_span_hash(part.astype(np.uint64), starts, ends, _BYTE_FACTOR))
    forms = mix(_span_hash(hashes, first, last, _WORD_FACTOR) + (last - first).astype(np.uint64))
    prints = _prints(*_telling(hashes, ends - starts, first, last)) if with_prints else None
    return Lines(held, rows[kept], numbers[kept], line_starts[kept], breaks[kept], forms, prints)


def _telling(hashes: np.ndarray, lengths: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first, count) of the words each fingerprint is made of: the longer ones, if the line has any."""
    long = lengths >= TELLING_BYTES
    before = np.concatenate(([0], np.cumsum(long)))
    none = before[last] == before[first]
    used = long | np.repeat(none, last - first)
    before = np.concatenate(([0], np.cumsum(used)))
    return hashes[used], before[first], before[last] - before[first]
