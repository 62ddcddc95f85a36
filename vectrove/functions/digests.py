"""md5 values of many keys at once: the draws of a replicate are the digests of each key and the replicate's number."""

from __future__ import annotations

import math
from hashlib import md5

import numpy as np

U = np.uint32
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_PLACES = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
#: Keys worked on at once.
RUN = 32_768


def _rounds(words: list, n: int, steps: int) -> tuple[np.ndarray, ...]:
    """The four sums of md5 over one block, whose words are whole numbers or arrays. Sixty-one steps settle the first."""
    a, b, c, d = (np.full(n, x, U) for x in _START)
    f, g = np.empty(n, U), np.empty(n, U)
    for i in range(steps):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        word = words[_PLACES[i]]
        if isinstance(word, int):
            np.add(f, U((word + _SINES[i]) & 0xFFFFFFFF), out=f)
        else:
            np.add(f, word, out=f)
            np.add(f, U(_SINES[i]), out=f)
        np.left_shift(f, U(_TURNS[i]), out=g)
        np.right_shift(f, U(32 - _TURNS[i]), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return a, b, c, d


class Digests:
    """Digests of keys that are each followed by the same text; keys are grouped by their length once."""

    def __init__(self, keys: list[bytes]):
        self.n, self.groups = len(keys), []
        size = np.fromiter(map(len, keys), np.int64, len(keys))
        for length in np.unique(size).tolist():
            for where in np.split(at := np.flatnonzero(size == length), range(RUN, len(at), RUN)):
                mine = [keys[i] for i in where.tolist()]
                if length > 48:
                    self.groups.append((where, length, mine))
                else:
                    self._add(where, length, np.frombuffer(b"".join(mine), np.uint8).reshape(len(mine), length))

    def _add(self, where: np.ndarray, length: int, text: np.ndarray) -> None:
        wide = np.zeros((len(text), -(-length // 4) * 4), np.uint8)
        wide[:, :length] = text
        self.groups.append((where, length, list(np.ascontiguousarray(wide.view("<u4").astype(U).T)) if length else []))

    @classmethod
    def of_numbers(cls, first: int, last: int) -> Digests:
        """Of the numbers from first to last - 1, in decimal digits."""
        found = cls([])
        found.n = last - first
        at = first
        while at < last:
            digits = len(str(at))
            stop = min(last, at + RUN, 10**digits)
            numbers = np.arange(at, stop)
            text = np.stack([48 + numbers // 10 ** (digits - 1 - k) % 10 for k in range(digits)], axis=1).astype(np.uint8)
            found._add(np.arange(at - first, stop - first), digits, text)
            at = stop
        return found

    def leading(self, tail: bytes) -> np.ndarray:
        """The first 32 bits of each digest as a number."""
        return self._sums(tail, 1)[0]

    def both(self, tail: bytes) -> np.ndarray:
        """The first and the second 32 bits of each digest as numbers, in two rows."""
        return self._sums(tail, 2)

    def _sums(self, tail: bytes, many: int) -> np.ndarray:
        out = np.empty((many, self.n), U)
        for where, length, parts in self.groups:
            if length + len(tail) > 55:  # more than one block
                raw = [md5(k + tail).digest()[: 4 * many] for k in (parts if length > 48 else [w.tobytes()[:length] for w in np.stack(parts, axis=1)])]
                out[:, where] = np.frombuffer(b"".join(raw), ">u4").reshape(-1, many).T
                continue
            if length > 48:
                parts = list(np.ascontiguousarray(np.frombuffer(b"".join(k.ljust(52, b"\0") for k in parts), "<u4").reshape(-1, 13).astype(U).T))
            block = bytes(length) + tail + b"\x80"
            fixed = np.frombuffer(block.ljust(56, b"\0") + (8 * (length + len(tail))).to_bytes(8, "little"), "<u4").tolist()
            words = [(parts[k] | U(fixed[k]) if fixed[k] else parts[k]) if k < len(parts) else fixed[k] for k in range(16)]
            sums = _rounds(words, len(where), 61 if many == 1 else 64)
            for i, x in enumerate(sums[1:2] if many == 1 else sums[:2]):
                out[i, where] = (x + U(_START[i])).byteswap()
        return out
