"""Sets of hashed word n-grams of many texts at once, in numpy.

A word is a longest run of letters and digits, case folded character by character. An n-gram is
n words in a row; a text of fewer words has the one n-gram of them all, a text without words none.
n-grams are 64-bit hashes.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .arrow_text import spans, utf8

BLOCK_BYTES = 1 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each character of the basic plane: whether it is in words, and the hash of its lower case."""
    chars = [chr(c) for c in range(65536)]
    word = np.array([unicodedata.category(c)[0] in "LN" for c in chars])
    low = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars], np.uint64)
    return word, mix(low + np.uint64(0x9E3779B97F4A7C15))


@functools.cache
def _powers(bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(1 << bits, 0x2545F4914F6CDD1D, np.uint64))


def _rare(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As _tables, with characters beyond the basic plane looked up one by one."""
    word_of, hash_of = _tables()
    at = np.minimum(cps, 65535)
    word, value = word_of[at], hash_of[at]
    far = np.flatnonzero(cps > 65535)
    if len(far):
        u, inv = np.unique(cps[far], return_inverse=True)
        word[far] = np.array([unicodedata.category(chr(c))[0] in "LN" for c in u])[inv]
        value[far] = mix(np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in u], np.uint64) + np.uint64(0x9E3779B97F4A7C15))[inv]
    return word, value


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and words before each text."""
    raw = data.tobytes()
    cps = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(cps) == len(data):
        at = offsets
        word_of, hash_of = _tables()
        word, value = word_of[:128][data], hash_of[:128][data]
    else:
        at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        word, value = _rare(cps)
    before = np.empty(len(word), bool)
    before[1:] = word[:-1]
    before[:1] = False
    before[at[:-1][at[:-1] < len(word)]] = False
    first = np.flatnonzero(word & ~before)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = np.flatnonzero(word)
    start = np.searchsorted(inside, first)
    length = np.diff(np.append(start, len(inside)))
    place = np.arange(len(inside)) - np.repeat(start, length)
    value = value[inside] * _powers(max(8, int(length.max()).bit_length()))[place]
    return mix(np.add.reduceat(value, start)), np.searchsorted(first, at)


def _sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    words, at = _words(data, offsets)
    q = _powers(8)[10 : 10 + n]
    grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        grams += words[k : k + len(grams)] * q[k]
    grams = mix(grams)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= n:
            g = np.sort(grams[a : b - n + 1])
            out.append(g[np.r_[True, g[1:] != g[:-1]]])
        elif b > a:
            out.append(mix((words[a:b] * q[: b - a]).sum(keepdims=True, dtype=np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def ngram_blocks(column: pa.Array, n: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(from, to, sets) of about ``BLOCK_BYTES`` of texts at a time: sorted distinct n-gram hashes of each text; none for a null."""
    data, offsets = utf8(column)
    with np.errstate(over="ignore"):
        for i, j in spans(offsets, BLOCK_BYTES):
            yield i, j, _sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
