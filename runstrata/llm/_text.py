"""Texts as UTF-8 byte arrays: words, word hashes and shingles for many documents at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK = 1 << 20  #: bytes worked on at once; a longer single document is worked on alone


def table_of(word_bytes: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(word_bytes)] = True
    return out


#: Any byte but space and \t \n \v \f \r.
NOT_BLANK = table_of(bytes(x for x in range(256) if x not in (32, 9, 10, 11, 12, 13)))
#: ASCII letters, and every byte of a character beyond ASCII.
LETTERS = table_of(bytes(x for x in range(256) if x >= 128 or chr(x).isalpha()))
#: The same with digits.
ALNUM = table_of(bytes(x for x in range(256) if x >= 128 or chr(x).isalnum()))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache(1)
def _constants():
    rng = np.random.default_rng(20240607)
    low_bytes = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)  # masks of the first k bytes
    return low_bytes, rng.integers(1, 2**63, 64, dtype=U) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each row begins; null counts as empty."""
    a = col.cast(pa.large_string()).fill_null("")
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
    data = a.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes, or of one longer row."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(buf: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and for each document the position of its first word (and the number of words)."""
    n = len(buf)
    inside = member[buf]
    at = off[:-1][off[:-1] < n]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[at] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[at[at > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: its 8-byte blocks, each mixed with its place in the word, are summed and mixed with the length.

    Every block passes a bijection of 64 bits before the sum, and no two places are treated alike, so no pattern
    of long words (repetitions, swapped parts) makes them collide more than chance does.
    """
    if not len(starts):
        return np.zeros(0, U)
    mask = _constants()[0]
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    at = np.ndarray((len(buf) + 1,), "<u8", padded.data, strides=(1,))  # the eight bytes from each place on
    lens = ends - starts
    out = mix((at[starts] & mask[np.minimum(lens, 8)]) + U(0x9E3779B97F4A7C15))
    long = np.flatnonzero(lens > 8)
    if len(long):
        count = (lens[long] - 1) // 8  # blocks after the first
        first = np.zeros(len(long), np.int64)
        np.cumsum(count[:-1], out=first[1:])
        k = np.arange(1, int(count.sum()) + 1, dtype=np.int64) - np.repeat(first, count)
        place = np.repeat(starts[long], count) + 8 * k
        block = at[place] & mask[np.minimum(np.repeat(ends[long], count) - place, 8)]
        out[long] += np.add.reduceat(mix(block + mix(k.astype(U) * U(0xD1B54A32D192ED03))), first)
    return mix(out + lens.astype(U) * U(0x8CB92BA72F3D8DD7))


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` values."""
    odd = _constants()[1]
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    out = h[:n] * odd[0]
    for j in range(1, size):
        out = mix(out) + h[j : n + j] * odd[j % 64]
    return mix(out)


def whole(h: np.ndarray) -> np.ndarray:
    """One hash of a sequence shorter than a window; it differs from that of any window."""
    return windows(h, len(h)) ^ U(0xA5A5A5A5A5A5A5A5 >> len(h))


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each document its word hashes and its distinct shingles, sorted.

    Words are runs of non-blank bytes with A-Z lowered; fewer than ``size`` words are one shingle.
    """
    for lo, hi in chunks(off):
        part, at = LOWER[buf[off[lo] : off[hi]]], off[lo : hi + 1] - off[lo]
        starts, ends, first = words(part, at, NOT_BLANK)
        h = word_hashes(part, starts, ends)
        rolled = windows(h, size)
        for d in range(hi - lo):
            a, b = first[d], first[d + 1]
            if b - a >= size:
                yield h[a:b], np.unique(rolled[a : b - size + 1])
            elif b > a:
                yield h[a:b], whole(h[a:b])
            else:
                yield h[a:b], np.zeros(0, U)
