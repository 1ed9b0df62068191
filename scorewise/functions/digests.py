"""MD5 of many numbered texts at once, by numpy."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from hashlib import md5

import numpy as np
from pyspark import cloudpickle

# task functions travel with their plan
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LOW = 4  # digits that differ inside a batch of numbers
LONGEST = 55  # bytes that fit one block of the digest

_ADDED = [int(abs(np.sin(i + 1.0)) * 2**32) for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


_KNOWN: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}  # digits of whole batches


def _digits(first: int, end: int, size: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """The last ``size`` digits of the numbers as bytes of two words, of which the first has them from byte ``shift`` on."""
    key = (first, end, size, shift)
    if key in _KNOWN:
        return _KNOWN[key]
    words = np.zeros((2, end - first), np.uint32)
    numbers = np.arange(first, end)
    for i in range(size):
        word, byte = divmod(shift + i, 4)
        words[word] |= ((numbers // 10 ** (size - 1 - i) % 10 + 48) << (8 * byte)).astype(np.uint32)
    if end == 10**size:
        _KNOWN[key] = words[0], words[1]
    return words[0], words[1]


def _heads(words: list, n: int) -> np.ndarray:
    """The first word of the digest of n blocks, whose 16 words are numbers or arrays."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    t, u = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):  # the last three steps do not reach the first word
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=t)
            t &= b
            t ^= d
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=t)
            t &= d
            t ^= c
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=t)
            t ^= d
        else:
            g = 7 * i % 16
            np.bitwise_not(d, out=t)
            t |= b
            t ^= c
        t += a
        if isinstance(words[g], int):
            t += np.uint32((words[g] + _ADDED[i]) & 0xFFFFFFFF)
        else:
            t += words[g]
            t += np.uint32(_ADDED[i])
        np.right_shift(t, np.uint32(32 - _TURNS[i]), out=u)
        t <<= np.uint32(_TURNS[i])
        t |= u
        t += b
        a, b, c, d, t = d, t, b, c, a
    return b + np.uint32(_START[0])


def md5_heads(prefix: str, n: int) -> Iterator[np.ndarray]:
    """The first four bytes of ``md5(prefix + number)``, big-endian, for the numbers 0 to n - 1 in order, some at a time."""
    start = prefix.encode()
    edges = [0, *(10**i for i in range(1, LOW)), *range(10**LOW, n, 10**LOW)]
    edges = [e for e in edges if e < n] + [n]
    for first, end in zip(edges[:-1], edges[1:]):
        high = first // 10**LOW
        size = LOW if high else len(str(end - 1))
        fixed = start + (b"%d" % high if high else b"")
        length = len(fixed) + size
        if length > LONGEST:
            yield np.frombuffer(b"".join(md5(start + b"%d" % i).digest()[:4] for i in range(first, end)), ">u4")
            continue
        block = fixed + bytes(size) + b"\x80" + bytes(LONGEST - length) + (8 * length).to_bytes(8, "little")
        words: list = np.frombuffer(block, "<u4").tolist()
        at, shift = divmod(len(fixed), 4)
        low = first % 10**LOW
        for i, some in enumerate(_digits(low, low + end - first, size, shift)):
            if shift + size > 4 * i:
                words[at + i] = some | np.uint32(words[at + i])
        yield _heads(words, end - first).byteswap()
