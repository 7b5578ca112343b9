"""The first 32 bits of MD5 of short texts, in numpy: many prefixes before many keys, a block of keys at a time."""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa

#: Keys at a time: enough that the calls cost little, few enough that a step's arrays of 4 bytes a key stay in the cache.
BLOCK = 32_768
SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: One MD5 block holds this many bytes of text.
MOST = 55
MASK = 0xFFFFFFFF


def blocks(batches):
    """Tables of BLOCK rows or more, but for the last."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= BLOCK:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def starts(keys: pa.Array | pa.ChunkedArray, prefixes: list[bytes]):
    """(rows, draws) for blocks of rows whose keys, not null, have the same length; draws gives (number of the prefix, the
    digests' first 32 bits as numbers). An array of draws is used again by the next."""
    rows = np.flatnonzero(np.array(keys.is_valid()))
    texts = [t.encode() for t in keys.drop_null().to_pylist()]
    lengths = np.array([len(t) for t in texts], np.int64)
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        for i in range(0, len(at), BLOCK):
            part = at[i : i + BLOCK]
            yield rows[part], _draws([texts[j] for j in part], int(size), prefixes)


def _draws(texts: list[bytes], size: int, prefixes: list[bytes]):
    flat = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), size)
    for width, group in itertools.groupby(enumerate(prefixes), key=lambda p: len(p[1])):
        if width + size > MOST:
            for r, prefix in group:
                yield r, np.array([int.from_bytes(hashlib.md5(prefix + t).digest()[:4], "big") for t in texts], np.uint32)
            continue
        body = np.zeros((len(texts), 64), np.uint8)
        body[:, width : width + size] = flat
        body[:, width + size] = 0x80
        words = np.ascontiguousarray(body.view("<u4").T.astype(np.uint32))
        # Words that hold no byte of a key are the same for all rows.
        varied = range(width // 4, (width + size - 1) // 4 + 1) if size else range(0)
        spare = np.empty((6, len(texts)), np.uint32)
        for r, prefix in group:
            head = np.frombuffer(prefix.ljust(64, b"\0"), "<u4")
            fixed = [int(words[i, 0]) | int(head[i]) for i in range(16)]
            fixed[14] = 8 * (width + size)
            yield r, _digest({i: words[i] | np.uint32(head[i]) for i in varied}, fixed, spare)


def _digest(varied: dict[int, np.ndarray], fixed: list[int], spare: np.ndarray) -> np.ndarray:
    """The first state word after all steps, its bytes reversed; the last three steps do not touch it."""
    a, b, c, d, f, g = spare
    for state, value in zip((a, b, c, d), START):
        state.fill(value)
    for i in range(61):
        turn = i // 16
        if turn == 0:
            word = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif turn == 1:
            word = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            word = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            word = 7 * i % 16
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        if word in varied:
            np.add(f, varied[word], out=f)
            np.add(f, np.uint32(SINES[i]), out=f)
        else:
            np.add(f, np.uint32((SINES[i] + fixed[word]) & MASK), out=f)
        by = SHIFTS[turn][i % 4]
        np.left_shift(f, np.uint32(by), out=g)
        np.right_shift(f, np.uint32(32 - by), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=f)
        # The new word becomes b; what was a is free.
        a, b, c, d, f = d, f, b, c, a
    return np.add(b, np.uint32(START[0]), out=f).byteswap()
