"""Words and their hash codes, for numpy code inside tasks."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

U = np.uint64


_IN_USE: list = []


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def in_use(cache=None) -> None:
    """Name the cache in use; the last one is emptied if it is another, so a worker that goes from one operator's tasks to another's keeps one.

    Without a cache, for tasks that keep none, what the tasks before have freed goes back to the system too."""
    if not _IN_USE or _IN_USE[0] is not cache:
        for other in _IN_USE:
            other.clear()
            pa.default_memory_pool().release_unused()
        _IN_USE[:] = [] if cache is None else [cache]
    if cache is None:
        pa.default_memory_pool().release_unused()
        if _trim:  # glibc alone has it
            _trim(0)


class Memo(dict):
    """A bounded cache of make(key); it is emptied when full, so results never depend on it."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most

    def use(self) -> Memo:
        """This cache, as the one in use."""
        in_use(self)
        return self

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


_CODES = Memo(xxh3_64_intdigest, 200_000)


def small(batches, rows: int = 1000):
    """The batches in slices of so many rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def split_words(text: bytes | None) -> list[bytes]:
    """Maximal runs outside the bytes 0x20 and 0x09-0x0D; null has none."""
    return text.split() if text else []


def codes(words: list[bytes]) -> np.ndarray:
    """A 64-bit code of each word."""
    return np.fromiter(map(_CODES.use().__getitem__, words), U, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = x ^ (x >> U(31))
    x = x * U(0x9E3779B97F4A7C15)
    x = x ^ (x >> U(29))
    x = x * U(0xD1B54A32D192ED03)
    return x ^ (x >> U(32))


def rolling(codes_: np.ndarray, size: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2**64, of every run of `size` codes: differences of prefix sums of code * base**i, brought to one power."""
    n = len(codes_)
    if n < size:
        return np.empty(0, U)
    power = np.cumprod(np.r_[U(1), np.full(n - 1, base, U)], dtype=U)
    inverse = np.cumprod(np.r_[U(1), np.full(n - size, pow(base, -1, 1 << 64), U)], dtype=U)
    sums = np.r_[U(0), np.cumsum(codes_ * power, dtype=U)]
    return (sums[size:] - sums[:-size]) * inverse
