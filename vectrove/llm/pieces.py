"""Texts cut where byte-level BPE never merges, and the ids of whole texts gathered from what is known of their pieces."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import compress, repeat

import numpy as np

from .words import in_use

#: White space of any of the libraries' patterns.
SPACE = r"\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RARE = re.compile(r"[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SAFE = re.compile(rf"(?<=[^{SPACE}]) (?=[^{SPACE}])")

#: Characters of text worked on at once; characters and pieces that a worker keeps.
SLICE, CHARACTERS, PIECES = 1_000_000, 5_000_000, 500_000


def keys(text: str) -> list[str]:
    """The pieces of a text, cut before each single space that has no white space beside it.

    In the pattern that splits texts before merges, white space stands at a match's start or fills it, and a single space
    before another character belongs to the following match: such a place always is a border between matches. A piece is
    named by what follows its space; the first, which has none, by a space and itself.
    """
    if not text:
        return []
    if "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or _RARE.search(text):
        cut = _SAFE.split(text)
    else:
        cut = text.split(" ")
    cut[0] = " " + cut[0]
    return cut


def spelled(key: str) -> str:
    """The piece that a key names."""
    return key[1:] if key[0] == " " else " " + key


def named(piece: str) -> str:
    """The key of a piece, or of a match inside one."""
    return piece[1:] if piece[0] == " " and piece[1:2] not in ("", " ") else " " + piece


def runs(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start[i] : start[i] + size[i]] of every i, one after the other."""
    ends = np.cumsum(size)
    return flat[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def lengths(texts: list[str]) -> np.ndarray:
    """The number of characters of each."""
    return np.fromiter(map(len, texts), np.int64, len(texts))


def tame(piece: str) -> bool:
    """Whether the piece may follow another in one text without a match across the border."""
    return piece[0] == " " and not piece[-1].isspace() and not piece[1].isspace()


def slices(texts: list[str | None]):
    """Runs of rows of about SLICE characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


class Known:
    """Ids of the pieces that a worker has met, within CHARACTERS and PIECES; thinned out when full, so results never depend on it.

    `encode` takes distinct matches of the pattern, or whole pieces where it splits them itself and find is None, and returns
    all their ids in one array and the number for each.
    """

    def __init__(self, find: Callable[[str], list[str]] | None, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.find, self.encode = find, encode
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.flat, self.start, self.size = np.empty(1 << 16, np.uint32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.met = np.zeros(1 << 14, np.int32)  # the slices that met a piece
        self.used = self.held = 0

    def _thin(self) -> None:
        """Forget the pieces that fewest slices have met, so that half the room is free again; those met once always go."""
        names, met, least = list(self.at), self.met[: len(self.at)], 2
        length = lengths(names)
        while True:
            stay = np.flatnonzero(met >= least)
            if 2 * len(stay) <= PIECES and 2 * length[stay].sum() <= CHARACTERS:
                break
            least *= 2
        kept, ids, sizes, met = [names[i] for i in stay.tolist()], runs(self.flat, self.start[stay], self.size[stay]), self.size[stay], met[stay] // 2
        self.clear()
        if kept:
            self._keep(kept, ids, sizes)
            self.met[: len(kept)] = met

    def _keep(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.at), len(names)
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while len(self.start) < n + m:
            self.start, self.size = np.concatenate([self.start, np.empty_like(self.start)]), np.concatenate([self.size, np.empty_like(self.size)])
            self.met = np.concatenate([self.met, np.zeros_like(self.met)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[n : n + m] = sizes
        self.start[n : n + m] = self.used + np.cumsum(sizes) - sizes
        self.at.update(zip(names, range(n, n + m)))
        self.used += len(ids)
        self.held += sum(map(len, names))

    def _learn(self, new: list[str]) -> None:
        """Encode new pieces, by their matches if they are to be found; pieces that allow it are searched for them as one text."""
        if self.find is None:
            self._keep(new, *self.encode([spelled(k) for k in new]))
            return
        joint, lone = [], []
        for k in new:
            (lone if k[0] == " " or k[-1].isspace() else joint).append(k)
        found = self.find(" " + " ".join(joint)) if joint else []
        ends, wanted = np.cumsum(lengths(found)), np.cumsum(lengths(joint) + 1)
        if not joint or not found or ends[-1] != wanted[-1]:  # a pattern that leaves something out is applied to each alone
            joint, lone, many = [], new, np.empty(0, np.int64)
        else:
            many = np.diff(np.searchsorted(ends, wanted), prepend=-1)
        begun = np.cumsum(many) - many
        split = np.flatnonzero(many != 1)
        parted = [(joint[i], list(map(named, found[b:e]))) for i, b, e in zip(split.tolist(), begun[split].tolist(), (begun + many)[split].tolist())]
        parted += [(k, list(map(named, self.find(spelled(k))))) for k in lone]
        words = dict.fromkeys(compress(joint, (many == 1).tolist()))
        words.update((w, None) for _, some in parted for w in some if w not in self.at)
        if words:
            self._keep(list(words), *self.encode([spelled(k) for k in words]))
        parted = [(k, some) for k, some in parted if k not in self.at]
        if parted:
            where = np.array([self.at[w] for _, some in parted for w in some], np.int64)
            ends = np.cumsum([len(some) for _, some in parted])
            total = np.r_[0, np.cumsum(self.size[where])]
            self._keep([k for k, _ in parted], runs(self.flat, self.start[where], self.size[where]), np.diff(total[ends], prepend=0))

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the number for each text."""
        in_use(self)
        cut = [keys(t) for t in texts]
        many, flat = np.array([len(c) for c in cut], np.int64), [k for c in cut for k in c]
        if self.held > CHARACTERS or len(self.at) > PIECES:
            self._thin()
        which = np.fromiter(map(self.at.get, flat, repeat(-1)), np.int64, len(flat))
        new = np.flatnonzero(which < 0)
        if len(new):
            unknown = [flat[i] for i in new.tolist()]
            self._learn(list(dict.fromkeys(unknown)))
            which[new] = [self.at[k] for k in unknown]
        met = np.zeros(len(self.at), bool)
        met[which] = True
        self.met[: len(met)] += met
        sizes = self.size[which]
        total = np.r_[0, np.cumsum(sizes)]
        ends = np.cumsum(many)
        return runs(self.flat, self.start[which], sizes), total[ends] - total[ends - many]
