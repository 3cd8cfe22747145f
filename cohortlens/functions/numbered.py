"""Hash keys of runs of numbers, in whole arrays; the same keys as scalar.hash_key gives row by row."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np

STEP = 50_000  # keys in an array at most
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_WORD = [i % 16 for i in range(16)] + [(5 * i + 1) % 16 for i in range(16, 32)] + [(3 * i + 5) % 16 for i in range(32, 48)] + [7 * i % 16 for i in range(48, 64)]
_START = 0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476
_LAST = 61  # steps that the first word of the digest depends on, of 64
_LOW = 0xFFFFFFFF
LONGEST = 50  # bytes before the last digits, of the 55 that one block of md5 has room for

# arrays without dimensions, as these are quicker to add and shift by than numbers
_UP = [np.array(t, np.uint32) for t in _TURNS]
_DOWN = [np.array(32 - t, np.uint32) for t in _TURNS]


def _mixed(b: int, c: int, d: int) -> int:
    """What a step of md5, one of the first 16, makes of three words."""
    return d ^ (b & (c ^ d))


def _mix(i: int, b: np.ndarray, c: np.ndarray, d: np.ndarray, out: np.ndarray) -> None:
    """What step i of md5 makes of three words, written to out."""
    if i < 16:
        np.bitwise_xor(c, d, out)
        np.bitwise_and(out, b, out)
        np.bitwise_xor(out, d, out)
    elif i < 32:
        np.bitwise_xor(b, c, out)
        np.bitwise_and(out, d, out)
        np.bitwise_xor(out, c, out)
    elif i < 48:
        np.bitwise_xor(b, c, out)
        np.bitwise_xor(out, d, out)
    else:
        np.invert(d, out)
        np.bitwise_or(out, b, out)
        np.bitwise_xor(out, c, out)


@cache
def _digit_words(width: int, at: int) -> np.ndarray:
    """Two words with the digits of each number of that width, in a row each; the digits start at byte `at` of the first."""
    two = np.zeros((10**width, 8), np.uint8)
    two[:, at : at + width] = np.arange(10**width)[:, None] // 10 ** np.arange(width)[::-1] % 10 + ord("0")
    return np.ascontiguousarray(two.view("<u4").T)


def _block_keys(head: bytes, width: int, low: int, n: int) -> np.ndarray:
    """The first 32 bits of md5 of head and each of n numbers from low on, written
    with width digits, four or five (RFC 1321, one block, all numbers at once).

    Steps before the first word with digits are the same for all, and the last
    three make none of these bits, so both are left out of the arrays. Steps
    write into five arrays that are made once, so that these stay in the cache.
    """
    at = len(head)
    block = np.zeros(64, np.uint8)
    block[:at], block[at + width] = np.frombuffer(head, np.uint8), 0x80
    block[56:] = np.frombuffer((8 * (at + width)).to_bytes(8, "little"), np.uint8)
    own, words = at // 4, block.view("<u4").tolist()
    digits = _digit_words(width, at % 4)[:, low : low + n]
    words[own : own + 2] = [x | np.uint32(w) if w else x for x, w in zip(digits, words[own : own + 2])]
    a, b, c, d = _START
    for i in range(own):
        f = (_mixed(b, c, d) + a + words[i] + _SINES[i]) & _LOW
        a, b, c, d = d, (b + (f << _TURNS[i] | f >> 32 - _TURNS[i])) & _LOW, b, c
    a, b, c, d = (np.full(n, x, np.uint32) for x in (a, b, c, d))
    f = np.empty(n, np.uint32)
    for i in range(own, _LAST):
        w = words[_WORD[i]]
        _mix(i, b, c, d, f)
        np.add(a, f, a)
        if isinstance(w, int):
            np.add(a, np.array(_SINES[i] + w & _LOW, np.uint32), a)
        else:
            np.add(a, w, a)
            np.add(a, np.array(_SINES[i], np.uint32), a)
        np.left_shift(a, _UP[i], f)
        np.right_shift(a, _DOWN[i], a)
        np.bitwise_or(a, f, a)
        np.add(a, b, a)
        a, b, c, d = d, a, b, c
    b += np.uint32(_START[0])  # three steps on this word would be the first
    return b.byteswap(True)


def numbered_keys(prefix: str, first: int, last: int) -> Iterator[np.ndarray]:
    """hash_key of prefix and k for each k from first to last - 1, as arrays of STEP at most; prefix ends with its colon."""
    while first < last:
        width = 4 if first < 100_000 else 5
        high, low = divmod(first, 10**width)
        end = min(last, first + STEP, (high + 1) * 10**width)
        head = f"{prefix}{high}".encode()
        if high == 0 or len(head) > LONGEST:
            yield np.array([int.from_bytes(hashlib.md5(f"{prefix}{k}".encode()).digest()[:4], "big") for k in range(first, end)], np.uint32)
        else:
            yield _block_keys(head, width, low, end - first)
        first = end
