"""Words of many texts at once in numpy: positions and 64-bit content hashes without a Python object per word.

Texts come as one buffer of UTF-8 bytes and offsets, as Arrow holds a binary column. Words are runs of bytes
other than blank and the controls 9 to 13, which are never part of a longer UTF-8 character. A word's hash adds up
a mixed 64-bit value of each (place, byte); equal words have equal hashes everywhere, and different ones differ but
for odds of about 2^-64 a pair. Runs of words are named by halves, each name a mix of the names of its halves.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Texts are taken in pieces of about so many bytes (one text at least).
PIECE = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: a bijection of 64-bit values whose output bits each depend on all input bits."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
#: Odd steps that set places, lengths and halves apart before they are mixed.
STEP, LENGTH, HALF = U(0xD1342543DE82EF95), U(0x8CB92BA72F3D8DD7), U(0xA0761D6478BD642F)
#: Values are hashed so many at a time, which bounds memory and stays in the cache.
BLOCK = 1 << 16
#: The mixed values of (place, byte) for the first places.
PLACES = 64
TABLE = mix(np.tile(BYTES, PLACES) + np.repeat(np.arange(1, PLACES + 1, dtype=U) * STEP, 256))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, bytewise: bool = False) -> np.ndarray:
    """Hash of values[start:end] for each pair, the same wherever the run stands; bytewise: values are bytes.

    The sum of a mixed value for each (place, value): places are not tied to each other by powers of a base, so no
    regular sequence cancels out.
    """
    lens = ends - starts
    out = lens.astype(U) * LENGTH
    stops = np.cumsum(lens)
    first = 0
    while first < len(lens):
        before = int(stops[first] - lens[first])
        last = max(first + 1, int(np.searchsorted(stops, before + BLOCK, "right")))
        size, begin = lens[first:last], stops[first:last] - lens[first:last] - before
        place = np.arange(int(stops[last - 1]) - before) - np.repeat(begin, size)
        value = values[place + np.repeat(starts[first:last], size)]
        if bytewise and size.max() <= PLACES:
            mixed = TABLE[place * 256 + value]
        else:
            mixed = mix((BYTES[value] if bytewise else value) + (place.astype(U) + U(1 + seed)) * STEP)
        total = np.zeros(len(place) + 1, U)
        np.cumsum(mixed, out=total[1:])
        out[first:last] += total[begin + size] - total[begin]
        first = last
    return mix(out)


def column(array) -> tuple[np.ndarray, np.ndarray]:
    """Buffer and offsets of an Arrow binary or string array; nulls are empty."""
    wide = "large" in str(array.type)
    offsets = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64) if len(array) else np.zeros(1, np.int64)
    data = array.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, offsets


def pieces(offsets: np.ndarray, size: int = PIECE):
    """Ranges of texts of about `size` bytes each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


class Words:
    """Words of texts: starts, ends (bytes from the piece's begin), hash, and counts by text."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool = False, hashes: bool = True):
        offsets = offsets.astype(np.int64)
        raw = buf[offsets[0] : offsets[-1]]
        self.offsets = offsets = offsets - offsets[0]
        raw = LOWER[raw] if lower else raw
        self.bytes = raw
        n = len(raw)
        solid = np.empty(n + 1, bool)
        np.logical_not(SPACE[raw], out=solid[:n])
        solid[n] = False
        first = np.empty(n + 1, bool)  # whether a word may begin, or the last one ends, here
        first[1:] = solid[1:] != solid[:-1]
        first[0] = solid[0]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        inner = cut[solid[cut] & solid[cut - 1]]  # a text ends and the next begins without white space
        edges = np.flatnonzero(first)
        if len(inner):
            edges = np.sort(np.concatenate([edges, np.repeat(np.unique(inner), 2)]))
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.bounds = np.searchsorted(self.starts, offsets)  # words of text i: bounds[i]:bounds[i + 1]
        self.counts = np.diff(self.bounds)
        if hashes:
            self.hash = spans_hash(raw, self.starts, self.ends, bytewise=True)

    def texts(self) -> np.ndarray:
        """Index of each word's text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def rolled(values: np.ndarray, bounds: np.ndarray, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of all windows of `width` values that lie in one text; bounds as in Words.

    Runs of 1, 2, 4, ... values get names from those of their halves; a window's name is made of the runs that its
    length in binary asks for.
    """
    n = len(values)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, U)
    counts = np.diff(bounds)
    left = np.repeat(bounds[1:], counts) - np.arange(n)  # values to the end of the text
    at = np.flatnonzero(left >= width)
    names, size, done = mix(values + U(2 * seed + 1) * HALF), 1, 0
    out = np.zeros(len(at), U)
    while size <= width:
        if width & size:
            out = mix(out * STEP + names[at + done])
            done += size
        if 2 * size <= width:
            names = mix(names[: len(names) - size] * HALF + names[size:])
        size *= 2
    return at, out
