"""Pattern packing of token sequences by non-negative least squares.

Only the histogram of piece lengths, at most `size` counts, comes to the driver. There, patterns of two and three lengths get
repeat counts by non-negative least squares, first those that fill a sequence but for FREE tokens, then, for what they leave,
those that may leave more; rounded counts are taken as far as the pieces go round, and what is left over is packed best-fit
into the gaps and into new sequences. The plan, a few rows for each
length, goes back to the tasks, where the pieces of a length take its places by their rank.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pieces import Known, runs, slices, tame
from .storage import stored
from .substring import table_type

#: Characters encoded as one text; least squares rounds; most tokens that the first patterns may leave free.
JOINT, ROUNDS, FREE = 100_000, 200, 1
#: Price of an empty sequence, in mean counts of a length, while patterns are fitted.
PRICE = 3.0


class Encoder:
    """Token ids of texts by a tokenizers file, which gets each distinct piece (`pieces.keys`) that a worker meets and splits it itself.

    Pieces that begin with a space follow each other in one text without changing each other's tokens, so they are
    encoded in joint texts of about JOINT characters and told apart by their tokens' bytes; others are encoded alone.
    The pattern, the tokenizer's own split, only names the encoder.
    """

    _made: dict = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Encoder:
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # byte-level: one character of a token's name is one byte
        self.bytes[list(vocabulary.values())] = list(map(len, vocabulary))
        self.known = Known(None, self._encode)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these words, and the number of ids of each."""
        joint = np.array([i for i, w in enumerate(words) if tame(w)], np.int64)
        size = pc.binary_length(pa.array(words, pa.large_string())).to_numpy()
        group = (np.cumsum(size[joint]) - 1) // JOINT
        edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]).tolist() if len(joint) else []
        start, many, flat, used = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64), [np.empty(0, np.uint32)], 0
        for i, j in zip(edges, edges[1:]):
            mine = joint[i:j]
            found = np.array(self.tokenizer.encode_batch_fast(["".join([words[k] for k in mine.tolist()])], add_special_tokens=False)[0].ids, np.uint32)
            ends, wanted = np.cumsum(self.bytes[found]), np.cumsum(size[mine])
            cut = np.searchsorted(ends, wanted) + 1
            if len(found) and cut[-1] == len(found) and (ends[cut - 1] == wanted).all():
                many[mine] = np.diff(cut, prepend=0)
                start[mine] = used + np.r_[0, cut[:-1]]
                flat.append(found)
                used += len(found)
        rest = np.flatnonzero(many < 0)
        alone = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([words[i] for i in rest.tolist()], add_special_tokens=False)]
        many[rest] = [len(x) for x in alone]
        start[rest] = used + np.cumsum(many[rest]) - many[rest]
        flat += alone
        return runs(np.concatenate(flat), start, many), many

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the number for each text. One that holds an added token's string is encoded as a whole."""
        whole = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        if not whole:
            return self.known.ids(texts)
        odd = set(whole)
        ids, many = self.known.ids(["" if i in odd else t for i, t in enumerate(texts)])
        parts = np.split(ids, np.cumsum(many)[:-1])
        for i, e in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)):
            parts[i] = np.array(e.ids, np.uint32)
        return np.concatenate(parts), np.array(list(map(len, parts)), np.int64)


def fit_patterns(counts: dict[int, int], size: int, most_free: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns that leave most_free tokens or fewer, with repeat counts that the pieces can serve.

    A pattern is a length, one that fits beside it, and as many of a third as fit beside both. Least squares of the histogram
    weigh what a pattern leaves free, by a price that is lifted for the last rounds.
    """
    lengths = np.array(sorted(x for x, n in counts.items() if n > 0 and x < size))
    if len(lengths) < 1:
        return []
    have = np.array([counts[int(x)] for x in lengths], float)
    found = set()
    for i in range(len(lengths) - 1, -1, -1):
        a = int(lengths[i])
        top = np.searchsorted(lengths, min(a, size - a), "right") - 1
        for j in range(top, max(-1, top - 3), -1):
            found.add((i, j, -1, 0))
        if top >= 0:
            for j in {int(x) for x in np.linspace(0, top, 12)}:
                rest = size - a - int(lengths[j])
                k = np.searchsorted(lengths, min(int(lengths[j]), rest), "right") - 1
                if k >= 0:
                    found.add((i, j, int(k), 1))
                    found.add((i, j, int(k), rest // int(lengths[k])))
    padded = np.r_[lengths, 0]
    patterns = np.array(sorted(found), np.int64).reshape(-1, 4)
    times_of = np.c_[np.ones((len(patterns), 2), np.int64), patterns[:, 3]]
    patterns = patterns[:, :3]
    free = size - (padded[patterns] * times_of).sum(axis=1)
    fits = (free >= 0) & (free <= most_free)
    patterns, times_of, free = patterns[fits], times_of[fits], free[fits]
    if not len(patterns):
        return []
    target = np.r_[have, 0.0]
    times = np.full(len(patterns), have.sum() / (2.5 * len(patterns)))
    toward = (target[patterns] * times_of).sum(axis=1)
    for turn in range(ROUNDS):  # multiplicative updates keep counts positive and never raise the squared error
        used = np.zeros(len(padded))
        for c in range(3):
            np.add.at(used, patterns[:, c], times * times_of[:, c])
        used[-1] = 0
        price = PRICE * have.mean() * free / size if turn < ROUNDS * 3 // 4 else 0.0
        times *= toward / np.maximum((used[patterns] * times_of).sum(axis=1) + price, 1e-9)
    left, out = have.astype(np.int64), []
    for p in np.lexsort((-times, free)):
        need: Counter = Counter()
        for x, m in zip(patterns[p].tolist(), times_of[p].tolist()):
            if x >= 0 and m:
                need[x] += m
        n = min(int(round(times[p])), *(int(left[x]) // m for x, m in need.items()))
        if n > 0:
            for x, m in need.items():
                left[x] -= n * m
            out.append((tuple(int(padded[x]) for x, m in sorted(need.items(), reverse=True) for _ in range(m)), n))
    return out


def best_fit(counts: dict[int, int], size: int, open_: list[tuple[tuple[int, ...], int]]) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing on counts, first into the gaps of open_. A pattern is a tuple of (length, times) runs."""
    bins: dict[int, list] = defaultdict(list)
    for pattern, n in open_:
        bins[size - sum(pattern)].append((tuple((x, 1) for x in pattern), n))
    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        n = counts[length]
        while n:
            gap = next((g for g in range(length, size) if bins.get(g)), size)
            fits = gap // length
            pattern, many = bins[gap].pop() if gap < size else ((), n // fits + 1)
            if n >= fits and many:
                whole, each = min(many, n // fits), fits
            else:
                whole, each = 1, n
            if gap < size and many > whole:
                bins[gap].append((pattern, many - whole))
            bins[gap - each * length].append(((*pattern, (length, each)), whole))
            n -= whole * each
    return [x for held in bins.values() for x in held]


def fill(counts: dict[int, int], size: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns that fill their sequences, then patterns of what these leave over, which may have free tokens, and the rest best-fit
    into all gaps and new sequences. Where best fit alone takes fewer sequences for what the first patterns leave, it packs that."""
    rest, fitted, found = Counter(counts), [], []
    for most_free in (FREE, size):
        for pattern, n in (new := fit_patterns(rest, size, most_free)):
            for x in pattern:
                rest[x] -= n
        fitted = fitted + new
        found.append(best_fit(rest, size, fitted))
    return min(reversed(found), key=lambda plan: sum(n for _, n in plan))


def make_plan(counts: dict[int, int], size: int) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, first sequence, offset, times), by rank."""
    plan, rank, sequence = defaultdict(list), Counter(), 0
    for pattern, n in fill(counts, size):
        offset = 0
        for length, times in pattern:
            plan[length].append((rank[length], sequence, offset, times))
            rank[length] += n * times
            offset += length * times
        sequence += n
    return {length: np.array(rows, np.int64) for length, rows in plan.items()}


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into as few sequences of `size` tokens as the patterns give. `pattern` is the tokenizer's own split.

    A document is its ids, then end_id; null and empty texts are end_id alone. Only longer documents are cut, from the
    back, so that just the first piece may be shorter than `size`. Returns a row per piece: the id, piece, start, length,
    ids_crc32, sequence_id, offset. Rows that repeat, also an id with other texts, and null ids are packed each; pieces of
    equal length are taken in no stated order; other columns are ignored, also if they bear the result's names; no rows
    in, no rows out.
    """
    schema = pa.schema([("part", pa.int32()), ("rank", pa.int64()), ("id", table_type(docs, id_col)), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = int(end_id).to_bytes(4, "little")

    def tokens(batches):
        encode, part, ranks = Encoder.of(tokenizer_path, pattern), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in slices(texts):
                ids, many = encode([t or "" for t in texts[i:j]])
                edge, rows = np.r_[0, np.cumsum(many)].tolist(), []
                raw = memoryview(ids.astype("<u4").tobytes())
                for name, at, stop in zip(names[i:j], edge, edge[1:]):
                    total = stop - at + 1  # with the end id, which has no place among the ids
                    first = total if total <= size else total % size or size
                    for k, start in enumerate([0, *range(first, total, size)]):
                        length = first if k == 0 else size
                        crc = zlib.crc32(raw[4 * (at + start) : 4 * min(at + start + length, stop)])
                        rows.append((part, ranks[length], name, k, start, length, zlib.crc32(end, crc) if start + length == total else crc))
                        ranks[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    kind = docs.schema[id_col].dataType.simpleString()
    found = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tokens, f"part int, rank long, id {kind}, piece int, start long, length long, ids_crc32 long"), "pieces")
    by_part = found.groupBy("part", "length").count()
    plan = make_plan({r.length: r.n for r in by_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}, size)
    earlier = by_part.select("part", "length", (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("earlier"))

    out = pa.schema([("id", schema.field("id").type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length):
                mine = length == x
                rows = plan[int(x)]
                row = rows[np.searchsorted(rows[:, 0], rank[mine], "right") - 1]
                into = rank[mine] - row[:, 0]
                sequence[mine], offset[mine] = row[:, 1] + into // row[:, 3], row[:, 2] + into % row[:, 3] * x
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")] + [pa.array(sequence), pa.array(offset)], schema=out)

    ranked = found.join(earlier, ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("earlier")).alias("rank"))
    return ranked.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)
