"""SHA-256 that can stop and go on elsewhere: its state is a small value that a task hands to the next.

hashlib keeps the state to itself.  Blocks are compressed by OpenSSL's SHA256_Update where the library that hashlib uses
has it (a build without deprecated functions doesn't), and otherwise in Python: the same digest, far slower.
"""

from __future__ import annotations

import ctypes
import functools
import struct
from collections.abc import Callable, Iterable
from dataclasses import dataclass

_BLOCK = 64
_MASK = 0xFFFFFFFF
Words = tuple[int, ...]


def _primes(n: int) -> list[int]:
    found: list[int] = []
    x = 2
    while len(found) < n:
        if all(x % p for p in found):
            found.append(x)
        x += 1
    return found


def _root_bits(x: int, power: int) -> int:
    """The first 32 bits behind the point of the root of x."""
    low, high = 0, x << 32
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid**power <= x << (32 * power) else (low, mid - 1)
    return low & _MASK


_START: Words = tuple(_root_bits(p, 2) for p in _primes(8))
_ROUNDS: Words = tuple(_root_bits(p, 3) for p in _primes(64))


def compress_plain(words: Words, data: bytes) -> Words:
    """The state after whole blocks, in Python."""

    def turn(x: int, n: int) -> int:
        return (x >> n | x << (32 - n)) & _MASK

    for at in range(0, len(data), _BLOCK):
        w = list(struct.unpack_from(">16I", data, at))
        for i in range(16, 64):
            x, y = w[i - 15], w[i - 2]
            w.append((w[i - 16] + (turn(x, 7) ^ turn(x, 18) ^ x >> 3) + w[i - 7] + (turn(y, 17) ^ turn(y, 19) ^ y >> 10)) & _MASK)
        a, b, c, d, e, f, g, h = words
        for k, x in zip(_ROUNDS, w, strict=True):
            p = (h + (turn(e, 6) ^ turn(e, 11) ^ turn(e, 25)) + (e & f ^ ~e & g) + k + x) & _MASK
            q = (turn(a, 2) ^ turn(a, 13) ^ turn(a, 22)) + (a & b ^ a & c ^ b & c)
            a, b, c, d, e, f, g, h = (p + q) & _MASK, a, b, c, (d + p) & _MASK, e, f, g
        words = tuple((x + y) & _MASK for x, y in zip(words, (a, b, c, d, e, f, g, h), strict=True))
    return words


class _Context(ctypes.Structure):
    """SHA256_CTX of openssl/sha.h."""

    _fields_ = [("h", ctypes.c_uint32 * 8), ("low", ctypes.c_uint32), ("high", ctypes.c_uint32), ("data", ctypes.c_uint32 * 16), ("num", ctypes.c_uint), ("length", ctypes.c_uint)]


@functools.lru_cache(1)
def compressor() -> Callable[[Words, bytes], Words]:
    try:
        import _hashlib

        library = ctypes.CDLL(_hashlib.__file__)
        init, update = library.SHA256_Init, library.SHA256_Update
    except (ImportError, AttributeError, OSError):
        return compress_plain
    init.argtypes, update.argtypes = [ctypes.c_void_p], [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]

    def compress(words: Words, data: bytes) -> Words:
        context = _Context()
        if not init(ctypes.byref(context)):
            return compress_plain(words, data)
        context.h[:] = words
        update(ctypes.byref(context), data, len(data))
        return tuple(context.h)

    probe = bytes(range(128))
    return compress if compress(_START, probe) == compress_plain(_START, probe) else compress_plain


@dataclass(frozen=True)
class State:
    words: Words = _START
    length: int = 0
    tail: bytes = b""

    def after(self, chunks: Iterable[bytes]) -> State:
        """The state after more bytes."""
        words, length, tail, compress = self.words, self.length, self.tail, compressor()
        for chunk in chunks:
            length += len(chunk)
            data = tail + chunk
            whole = len(data) - len(data) % _BLOCK
            words, tail = compress(words, data[:whole]) if whole else words, data[whole:]
        return State(words, length, tail)

    def hexdigest(self) -> str:
        pad = b"\x80" + bytes(-(len(self.tail) + 9) % _BLOCK) + struct.pack(">Q", 8 * self.length)
        return struct.pack(">8I", *compressor()(self.words, self.tail + pad)).hex()
