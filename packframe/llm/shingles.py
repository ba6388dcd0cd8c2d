"""Word shingles of whole texts as sorted 64-bit hashes, computed batch-wise with numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text with A-Z lower-cased.  A set holds the
distinct shingles of ``k`` words; a text with fewer words has its whole word sequence as its only
shingle; a text without words (or a null) has the empty set.

A word is hashed as a sum over its bytes, each times a random number of its place in the word, modulo 2**64; whatever
two given words are, they collide with a probability of 2**-57 at most over the choice of the random numbers, and no
arrangement of letters does so by construction.  Two different shingles of one pair of documents share a 64-bit hash
with a probability of about (set size)**2 / 2**64.
"""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
#: Bytes of text worked on at a time, but for longer texts.
_LONG = 1 << 20

#: The value of each byte: odd distances apart up to a factor below 256, so that no difference has 8 zero bits at its end.
_BYTES = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTES_LOWER = _BYTES[_LOWER]
_SEED = 20240229
#: Random numbers of places that are kept in a worker.
_KEPT = 1 << 16


def _random(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(_SEED)).integers(0, 1 << 64, n, dtype=np.uint64)


_PLACES = _random(_KEPT)


def _places(n: int) -> np.ndarray:
    """A random number for each place of a word of n bytes; the same ones for every length."""
    return _PLACES[:n] if n <= _KEPT else _random(n)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(buffer: np.ndarray, blank: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of a byte buffer.  blank: for each byte value, whether it parts words."""
    n = len(buffer)
    if n == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.diff(np.concatenate(([True], blank[buffer], [True])).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.empty(0, np.uint64), start, end
    length = end - start
    first = np.cumsum(length) - length  # of each word among the bytes of words
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    value = _BYTES_LOWER[buffer[~blank[buffer]]]
    value *= _places(int(length.max()))[place]
    return mix64(np.add.reduceat(value, first) + length.astype(np.uint64)), start, end


def combine(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    out = np.full(len(at), (k * 0xD1342543DE82EF95) & _MASK, np.uint64)
    for j in range(k):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD) + h[at + j]
    return mix64(out)


def shingle_sets(texts: list[bytes | None], k: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (uint64) of each text."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    held = 0
    for text in texts:
        group.append(text or b"")
        held += len(group[-1])
        if held > _LONG:
            out += _sets(group, k)
            group, held = [], 0
    return out + (_sets(group, k) if group else [])


def _sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    buffer = np.frombuffer(b"\n".join(texts), np.uint8)
    h, start, _ = words(buffer)
    first_byte = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    first = np.searchsorted(start, first_byte)  # the first word of each text
    shingles = combine(h, np.arange(max(0, len(h) - k + 1)), k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            own = np.sort(shingles[a : b - k + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif b > a:
            out.append(combine(h[a:b], np.zeros(1, np.int64), b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out
