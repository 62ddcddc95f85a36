"""Toxicity: a convolutional text classifier in numpy, with thresholds calibrated by language.

A word's embedding is the mean of those of its hashed form and of its hashed runs of four characters. Filters over one, two
and three words are max-pooled over the whole text; a logistic unit sums them. The language is guessed from the text.

All labelled rows are learned from. They are dealt to blocks; in a pass each block trains on from the nets of the pass before,
and what the blocks change is averaged.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import single_rows, stored
from .substring import table_type
from .words import in_use, small

#: Hash buckets, embedding size, filters of each width, widths, documents of a step, passes, cached words.
BUCKETS, SIZE, FILTERS, WIDTHS, STEP, PASSES, KEPT = 1 << 16, 8, 8, (1, 2, 3), 64, 5, 160_000
POOLED = FILTERS * len(WIDTHS)
#: Rows and characters of a block on average, parts of a sum that travel apart, first-level sums, steps of a logit when thresholds are set.
ROWS, CHARS, PARTS, SUMS, FINE = 4096, 24_000_000, 16, 32, 1024
#: The nets: one for each half of the rows, which learns from the other half, and one that learns from all.
NETS, ALL = 3, 2
MARKS = ".,;:!?|\"'()[]{}<>#$%&*@^~_=+-/\\`¡¿«»…"
#: Frequent function words by which a language is guessed.
COMMON = {
    "en": "the of and to in that is it for as with was be by on are this from",
    "fr": "le les des et en un une du que qui est dans pour par sur au avec",
    "de": "der die das und den von zu mit sich auf für ist im dem nicht ein eine",
    "es": "el los que y en un una por con para del se las es su al como",
}
LANGUAGES = ["", *COMMON]
_LANGUAGE = {w: i + 1 for i, words in enumerate(COMMON.values()) for w in words.split()}


def _crc_tables(n: int) -> tuple[int, np.ndarray]:
    """The CRC of n zero bytes, and what each value at each place changes in it: CRC-32 is linear in its bytes."""
    zero = zlib.crc32(bytes(n))
    return zero % BUCKETS, np.array([[(zlib.crc32(bytes(n - 1 - j) + bytes([v]) + bytes(j)) ^ zero) % BUCKETS for v in range(256)] for j in range(n - 1, -1, -1)], np.uint16)


_ZERO4, _CRC4 = _crc_tables(4)
_ONE = np.array([zlib.crc32(bytes([60, v, 62])) % BUCKETS for v in range(256)], np.uint16)


def buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of each word and of its runs of four characters, word after word, and their number for each word."""
    raw = [w.encode() for w in words]
    length = np.fromiter(map(len, raw), np.int64, len(raw))
    text = np.frombuffer(b"".join([b"<%b>" % r for r in raw]) + bytes(3), np.uint8)
    runs = np.maximum(1, length - 1)
    begin = np.cumsum(length + 2) - (length + 2)
    crc = _CRC4[0][text[:-3]] ^ _CRC4[1][text[1:-2]] ^ _CRC4[2][text[2:-1]] ^ _CRC4[3][text[3:]] ^ np.uint16(_ZERO4)
    short = begin[length == 1]
    crc[short] = _ONE[text[short + 1]]
    sizes = runs + 1
    first = np.cumsum(sizes) - sizes
    ids = np.empty(int(sizes.sum()), np.uint16)
    is_run = np.ones(len(ids), bool)
    is_run[first] = False
    ids[first] = np.fromiter(map(zlib.crc32, raw), np.int64, len(raw)) % BUCKETS
    ids[is_run] = crc[spread(begin, runs)]
    return ids, sizes


def spread(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each run, run after run."""
    return np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


class Net:
    """Embeddings, filters and output weights."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.emb = rng.normal(0, 0.02, (BUCKETS, SIZE)).astype(np.float32)
        self.filters = [rng.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[0, 0] = np.abs(f[0, 0]) + 0.3
        self.shift = np.zeros(POOLED, np.float32)
        self.out = np.abs(rng.normal(0, 0.3, POOLED)).astype(np.float32)
        self.bias = np.full(1, -2, np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.emb, *self.filters, self.shift, self.out, self.bias]

    def bytes(self) -> bytes:
        return b"".join(p.astype(np.float32).tobytes() for p in self.parts())

    @classmethod
    def of(cls, raw: bytes) -> Net:
        net, at = cls(), 0
        for p in net.parts():
            p[...] = np.frombuffer(raw, np.float32, p.size, at).reshape(p.shape)
            at += p.nbytes
        return net

    def embedded(self, ids: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.emb[ids], first, axis=0) / sizes[:, None].astype(np.float32)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.out + self.bias[0]


def evidence(met: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Start of the embeddings' first column: how surely a bucket is met in more texts of label 1; 0 where chance explains it.

    met has the texts of each label that have a bucket, n all texts of each label."""
    if not n.all():
        return np.zeros(BUCKETS, np.float32)
    p = met.sum(axis=0) / n.sum()
    z = (met[1] / n[1] - met[0] / n[0]) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n).sum())
    return np.where(z > 3.5, np.minimum(z / 5, 3), 0).astype(np.float32)


class Block:
    """Labelled rows as numbers: texts as codes of words, words as buckets."""

    FIELDS = {"lengths": np.int32, "codes": np.int32, "sizes": np.int32, "flat": np.uint16, "y": np.int8, "half": np.int8, "language": np.int8}

    def __init__(self, **arrays: np.ndarray):
        self.__dict__ |= arrays
        self.start = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        self.begin = np.cumsum(self.sizes, dtype=np.int64) - self.sizes

    @classmethod
    def of(cls, batch: pa.RecordBatch, row: int) -> Block:
        return cls(**{name: np.frombuffer(batch.column(name)[row].as_buffer(), kind) for name, kind in cls.FIELDS.items()})

    @classmethod
    def coded(cls, texts: list[str | None], y: np.ndarray, half: np.ndarray) -> Block:
        known: dict[str, int] = {}
        docs = [np.fromiter([known.setdefault(w, len(known)) for w in words_of(t)], np.int32) for t in texts]
        bare = [w.strip(MARKS) or w for w in known]
        flat, sizes = buckets(bare)
        spoken = np.fromiter([_LANGUAGE.get(w, 0) for w in bare], np.int8, len(bare))
        language = np.array([np.bincount(spoken[d][spoken[d] > 0], minlength=len(LANGUAGES)).argmax() for d in docs], np.int8)
        return cls(lengths=np.array([len(d) for d in docs], np.int32), codes=np.concatenate(docs), sizes=sizes.astype(np.int32), flat=flat, y=y, half=half, language=language)

    def raw(self) -> dict[str, bytes]:
        return {name: np.ascontiguousarray(getattr(self, name), kind).tobytes() for name, kind in self.FIELDS.items()}

    def met(self) -> np.ndarray:
        """For each half and label, the texts that have a bucket."""
        out = np.zeros((2, 2, BUCKETS), np.int32)
        for at, n, half, label in zip(self.start, self.lengths, self.half, self.y):
            words = self.codes[at : at + n]
            seen = np.zeros(BUCKETS, bool)
            seen[self.flat[spread(self.begin[words], self.sizes[words])]] = True
            out[half, label] += seen
        return out

    def looked_up(self, net: Net, docs: np.ndarray):
        """Of some texts: word lengths and starts, used words, place of each word among these, their buckets, embeddings."""
        lengths = self.lengths[docs].astype(np.int64)
        codes = self.codes[spread(self.start[docs], lengths)]
        mark = np.zeros(len(self.sizes), bool)
        mark[codes] = True
        used = np.flatnonzero(mark)
        place = np.empty(len(mark), np.int32)
        place[used] = np.arange(len(used))
        n_ids = self.sizes[used].astype(np.int64)
        ids = self.flat[spread(self.begin[used], n_ids)]
        first = np.cumsum(n_ids) - n_ids
        return lengths, np.cumsum(lengths) - lengths, place[codes], ids, first, n_ids, net.embedded(ids, first, n_ids)


def pool(net: Net, x: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled filters of each text, and the word where each has its largest value (-1: none above 0)."""
    pooled, best = np.zeros((len(lengths), POOLED), np.float32), np.full((len(lengths), POOLED), -1)
    for k, w in enumerate(WIDTHS):
        if len(x) < w:
            continue
        run = sum(x[j : len(x) - w + 1 + j] @ net.filters[k][j] for j in range(w)) + net.shift[k * FILTERS : (k + 1) * FILTERS]
        for d in np.flatnonzero(lengths >= w):
            here = run[start[d] : start[d] + lengths[d] - w + 1]
            top = here.argmax(axis=0)
            value = here[top, np.arange(FILTERS)]
            pooled[d, k * FILTERS : (k + 1) * FILTERS] = np.maximum(value, 0)
            best[d, k * FILTERS : (k + 1) * FILTERS] = np.where(value > 0, start[d] + top, -1)
    return pooled, best


def memory_of(net: Net) -> list[np.ndarray]:
    """AdaGrad's sums of squares at the start: one a bucket, one a number elsewhere."""
    return [np.full(p.shape if p is not net.emb else (BUCKETS, 1), 1e-6, np.float32) for p in net.parts()]


def train(net: Net, memory: list[np.ndarray], block: Block, docs: np.ndarray, weight: np.ndarray, turn: int, seed: tuple[int, ...]) -> None:
    """One pass of AdaGrad over some whole texts of a block, in place; the same input gives the same net."""
    rate = 0.05 * (1 - turn / PASSES)
    order = np.random.default_rng(seed).permutation(docs[block.lengths[docs] > 0])
    for at in range(0, len(order), STEP):
        docs = order[at : at + STEP]
        lengths, start, where, ids, first, n_ids, table = block.looked_up(net, docs)
        x = table[where]
        pooled, best = pool(net, x, start, lengths)
        p = 1 / (1 + np.exp(-np.clip(net.logits(pooled), -30, 30)))
        error = ((p - block.y[docs]) * weight[block.y[docs]] / len(docs)).astype(np.float32)
        d_pooled = error[:, None] * net.out
        grads = [None, *(np.zeros_like(f) for f in net.filters), np.zeros_like(net.shift), pooled.T @ error, np.array([error.sum()])]
        d_table = np.zeros_like(table)
        for k, w in enumerate(WIDTHS):
            doc, f = np.nonzero(best[:, k * FILTERS : (k + 1) * FILTERS] >= 0)
            place, g = best[doc, k * FILTERS + f], d_pooled[doc, k * FILTERS + f]
            np.add.at(grads[1 + len(WIDTHS)], k * FILTERS + f, g)
            for j in range(w):
                np.add.at(grads[1 + k], (j, slice(None), f), g[:, None] * x[place + j])
                np.add.at(d_table, where[place + j], g[:, None] * net.filters[k][j][:, f].T)
        moved = np.flatnonzero(np.abs(d_table).sum(axis=1))
        if len(moved):
            rows, place = np.unique(ids[spread(first[moved], n_ids[moved])], return_inverse=True)
            slope = np.zeros((len(rows), SIZE), np.float32)
            np.add.at(slope, place, np.repeat(d_table[moved] / n_ids[moved][:, None].astype(np.float32), n_ids[moved], axis=0))
            memory[0][rows] += (slope**2).mean(axis=1, keepdims=True)
            net.emb[rows] -= rate * slope / np.sqrt(memory[0][rows])
        for part, m, g in zip(net.parts()[1:], memory[1:], grads[1:]):
            m += g * g
            part -= 0.3 * rate * g / np.sqrt(m)


class Scorer:
    """Logits and languages of whole texts, with the filters' parts of each word cached."""

    def __init__(self, net: Net):
        in_use()
        self.net = net
        self.known: dict[str, int] = {}
        self.parts = np.zeros((KEPT, sum(WIDTHS) * FILTERS), np.float32)
        self.language = np.zeros(KEPT, np.int8)
        self.weights = np.concatenate([f[j] for f in net.filters for j in range(len(f))], axis=1)

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 50_000):
            some = [w.strip(MARKS) or w for w in words[at : at + 50_000]]
            ids, sizes = buckets(some)
            rows = slice(len(self.known), len(self.known) + len(some))
            self.parts[rows] = self.net.embedded(ids, np.cumsum(sizes) - sizes, sizes) @ self.weights
            self.language[rows] = [_LANGUAGE.get(w, 0) for w in some]
            self.known.update(zip(words[at : at + 50_000], range(rows.start, rows.stop)))

    def _codes(self, words: list[str]) -> np.ndarray:
        codes = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(codes < 0)
        if not len(new):
            return codes
        missing = list({words[i] for i in new})
        if len(self.known) + len(missing) > KEPT:
            self.known.clear()
            missing, new = list(set(words)), np.arange(len(words))
        self._learn(missing)
        codes[new] = [self.known[words[i]] for i in new]
        return codes

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text; a text of many words goes in overlapping runs, so that memory stays bounded."""
        pooled, votes = np.zeros((len(texts), POOLED), np.float32), np.zeros((len(texts), len(LANGUAGES)), np.int64)
        held, owner, size = [], [], 0
        reach = max(WIDTHS) - 1

        def flush() -> None:
            nonlocal held, owner, size
            if held:
                self._pool(held, np.array(owner), pooled, votes)
            held, owner, size = [], [], 0

        for i, text in enumerate(texts):
            words = words_of(text)
            for at in range(0, len(words), KEPT // 4):
                run = words[max(0, at - reach) : at + KEPT // 4]
                if size + len(run) > KEPT // 2:
                    flush()
                held.append(run)
                owner.append(i)
                size += len(run)
        flush()
        return self.net.logits(pooled), votes.argmax(axis=1)

    def _pool(self, runs: list[list[str]], owner: np.ndarray, pooled: np.ndarray, votes: np.ndarray) -> None:
        codes = self._codes([w for r in runs for w in r])
        lengths = np.array([len(r) for r in runs])
        start = np.cumsum(lengths) - lengths
        of = np.repeat(np.arange(len(runs)), lengths)
        spoken = self.language[codes]
        votes += np.bincount(owner[of[spoken > 0]] * len(LANGUAGES) + spoken[spoken > 0], minlength=votes.size).reshape(votes.shape)
        x, column = self.parts[codes], 0
        left = np.repeat(start + lengths, lengths) - np.arange(len(codes))
        for k, w in enumerate(WIDTHS):
            n = len(x) - w + 1
            if n > 0:
                value = sum(x[j : n + j, column + j * FILTERS : column + (j + 1) * FILTERS] for j in range(w)) + self.net.shift[k * FILTERS : (k + 1) * FILTERS]
                value[left[:n] < w] = 0
                value = np.vstack([value, np.zeros((w - 1, FILTERS), np.float32)])
                np.maximum.at(pooled, (owner, slice(k * FILTERS, (k + 1) * FILTERS)), np.maximum(np.maximum.reduceat(value, start, axis=0), 0))
            column += w * FILTERS


def thresholds(language: np.ndarray, logit: np.ndarray, y: np.ndarray, weight: np.ndarray, least: int = 10) -> np.ndarray:
    """For each language the logit that gives the best F1, midway to the next lower, drawn to that of all languages as if
    the language's positives were joined by `least` others."""

    def best(mine: np.ndarray) -> float:
        order = np.argsort(-logit[mine], kind="stable")
        z, t, w = logit[mine][order], y[mine][order], weight[mine][order]
        hit, said = np.cumsum(t * w), np.cumsum(w)
        f1 = 2 * hit / (said + (t * w).sum())
        f1[:-1][z[:-1] == z[1:]] = -1
        i = int(f1.argmax())
        return float(z[i] + z[i + 1]) / 2 if i + 1 < len(z) else float(z[i]) - 0.5

    general = best(np.ones(len(y), bool)) if 0 < (y * weight).sum() < weight.sum() else 0.0
    out = np.full(len(LANGUAGES), general)
    for k in range(len(LANGUAGES)):
        mine = language == k
        n = (y * weight)[mine].sum()
        if 0 < n < weight[mine].sum():
            out[k] += (best(mine) - general) * n / (n + least)
    return out


LEARN = "crc32(cast(cast(id as string) as binary)) % 3 <> 1"


SUMMED = "net int, part int, salt int, sums binary"


def summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sums of the vectors that tasks made of each net (cut_up), added in two levels if there are more than SUMS tasks."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in table["sums"])
        return pa.table([*(table[c][:1].combine_chunks() for c in ("net", "part", "salt")), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["net", "part", "salt", "sums"])

    if parts.sparkSession.sparkContext.defaultParallelism > SUMS:
        parts = parts.groupBy("net", "part", "salt").applyInArrow(add, SUMMED)
    rows = parts.groupBy("net", "part").applyInArrow(add, SUMMED).collect()
    return {k: np.concatenate([np.frombuffer(r.sums, np.float32) for r in sorted((r for r in rows if r.net == k), key=lambda r: r.part)]) for k in {r.net for r in rows}}


def cut_up(sums: dict[int, np.ndarray]):
    """A batch of a task's sums as `summed` takes them."""
    salt = TaskContext.get().partitionId() % SUMS
    rows = [(k, p, salt, part.astype(np.float32).tobytes()) for k, total in sums.items() for p, part in enumerate(np.array_split(total, PARTS))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["net", "part", "salt", "sums"])


def likely(rows: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """Rows whose id is in known, and a few others (one in 16, more beyond some 8 million ids): texts of others need not travel.

    What is broadcast is a bitmap of the ids' hashes of at most 16 MB."""
    bits = 1 << min(27, max(15, (16 * n).bit_length()))
    bit = F.expr(f"pmod(xxhash64(id, 'bit'), {bits})")
    maps = known.select(bit.alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits"))
    probed = rows.withColumn("bit", bit).withColumn("bucket", F.expr("bitmap_bucket_number(bit)")).withColumn("at", F.expr("cast(bitmap_bit_position(bit) as int)"))
    is_set = F.expr("shiftright(cast(conv(hex(substring(bits, at div 8 + 1, 1)), 16, 10) as int), at % 8) & 1 = 1")
    return probed.join(F.broadcast(maps), "bucket").where(is_set).select(*rows.columns)


def blocks_of(rows: DataFrame, known: DataFrame, n_blocks: int) -> DataFrame:
    """Rows (id, text) with labels (id, y, half) dealt to blocks, a row a block, stored; read by a task a core, as each task sends
    sums as large as nets."""
    names = ["block", "met", *Block.FIELDS]

    def code(table: pa.Table, labels: pa.Table) -> pa.Table:
        in_use()
        y, half = (dict(zip(labels["id"].to_pylist(), labels[c].to_pylist())) for c in ("y", "half"))
        found = [(i, y[i], t) for i, t in zip(table["id"].to_pylist(), table["text"].to_pylist()) if i in y]
        if not found:
            return pa.table([pa.array([], pa.int32()), *(pa.array([], pa.binary()) for _ in names[1:])], names=names)
        found.sort(key=lambda r: f"{r[0]} {r[1]} {hashlib.md5((r[2] or '').encode()).hexdigest()}")
        block = Block.coded([t for _, _, t in found], np.array([v for _, v, _ in found], np.int8), np.array([half[i] for i, _, _ in found], np.int8))
        return pa.table([table["block"][:1].combine_chunks(), *(pa.array([x], pa.binary()) for x in (block.met().tobytes(), *block.raw().values()))], names=names)

    dealt, given = (t.withColumn("block", F.expr(f"cast(pmod(xxhash64(id, 'block'), {n_blocks}) as int)")).groupBy("block") for t in (rows, known))
    coded = dealt.cogroup(given).applyInArrow(code, ", ".join(["block int", *(f"{c} binary" for c in names[1:])]))
    return stored(coded, "blocks").coalesce(rows.sparkSession.sparkContext.defaultParallelism)


def learned(blocks: DataFrame, n: np.ndarray) -> list[Net]:
    """The nets, from all blocks; n has the rows of each half and label.

    Each of PASSES passes is a map over the blocks: a block trains on from the nets of the pass before. A number moves by the
    mean of what the blocks change, a bucket's numbers by the mean over the blocks that have changed them.
    """

    def count(batches):
        total = np.zeros(4 * BUCKETS)
        for batch in batches:
            for raw in batch.column(0):
                total += np.frombuffer(raw.as_buffer(), np.int32)
        yield cut_up({0: total})

    met = summed(blocks.select("met").mapInArrow(count, SUMMED))[0].astype(float).reshape(2, 2, BUCKETS)
    state = []
    weight = np.zeros((NETS, 2), np.float32)
    for k in range(NETS):
        halves = [h for h in (0, 1) if h != k]
        net = Net()
        net.emb[:, 0] = evidence(met[halves].sum(axis=0), n[halves].sum(axis=0).astype(float))
        state.append(flat_of(net, memory_of(net)))
        weight[k] = n[halves].sum() / (2 * np.maximum(1, n[halves].sum(axis=0)))
    dense = slice(BUCKETS * SIZE, len(state[0]) - BUCKETS)
    for turn in range(PASSES):

        def go(batches, turn=turn, state=state):
            in_use()
            sums = {}
            for batch in batches:
                for i in range(batch.num_rows):
                    block, name = Block.of(batch, i), batch.column("block")[i].as_py()
                    for k in range(NETS):
                        docs = np.flatnonzero(block.half != k)
                        if not block.lengths[docs].any():
                            continue
                        net, memory = shaped(state[k])
                        train(net, memory, block, docs, weight[k], turn, (turn, name))
                        change = flat_of(net, memory).astype(np.float64) - state[k]
                        if k not in sums:
                            sums[k] = np.zeros(len(change) + BUCKETS + 1)
                        sums[k] += np.concatenate([change, change[-BUCKETS:] != 0, [1]])
            if sums:
                yield cut_up(sums)

        found = summed(blocks.drop("met").mapInArrow(go, SUMMED))
        state = list(state)
        for k, total in found.items():
            moved = np.maximum(1, total[-BUCKETS - 1 : -1])
            share = np.full(len(state[k]), total[-1])
            share[: dense.start], share[dense.stop :] = np.repeat(moved, SIZE), moved
            state[k] = (state[k] + total[: len(share)] / share).astype(np.float32)
    return [shaped(s)[0] for s in state]


def flat_of(net: Net, memory: list[np.ndarray]) -> np.ndarray:
    """All numbers of a net and its memory in a row: embeddings first, the embeddings' memory last."""
    return np.concatenate([p.ravel() for p in (*net.parts(), *memory[1:], memory[0])])


def shaped(flat: np.ndarray) -> tuple[Net, list[np.ndarray]]:
    net = Net.of(flat.tobytes())
    memory, at = memory_of(net), sum(p.size for p in net.parts())
    for m in (*memory[1:], memory[0]):
        m[...] = flat[at : at + m.size].reshape(m.shape)
        at += m.size
    return net, memory


def set_thresholds(blocks: DataFrame, nets: list[Net]) -> np.ndarray:
    """Thresholds from the logits that all rows get from the net of their half, counted in steps of 1 / FINE."""

    def tally(batches):
        in_use()
        keys, y = [], []
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block.of(batch, i)
                for k in (0, 1):
                    mine = np.flatnonzero(block.half == k)
                    for at in range(0, len(mine), STEP):
                        docs = mine[at : at + STEP]
                        lengths, start, where, *_, table = block.looked_up(nets[k], docs)
                        logit = nets[k].logits(pool(nets[k], table[where], start, lengths)[0])
                        keys.append(block.language[docs].astype(np.int64) << 32 | np.rint((np.clip(logit, -40, 40) + 64) * FINE).astype(np.int64))
                        y.append(block.y[docs])
        if keys:
            key, place = np.unique(np.concatenate(keys), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(place)), pa.array(np.bincount(place, np.concatenate(y)).astype(np.int64))], names=["key", "n", "up"])

    found = blocks.drop("met").mapInArrow(tally, "key long, n long, up long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("up").alias("up")).orderBy("key").collect()
    key, n, up = (np.array(c, np.int64) for c in zip(*found))
    language, logit = np.tile(key >> 32, 2), np.tile((key & 0xFFFFFFFF) / FINE - 64, 2)
    y, weight = np.repeat([1, 0], len(key)), np.concatenate([up, n - up])
    return thresholds(language[weight > 0], logit[weight > 0], y[weight > 0], weight[weight > 0])


def toxicity_model(docs: DataFrame, labels: DataFrame, learn: str, cut: float, id_col: str, text_col: str, label_col: str):
    """A function that makes a scorer: from texts to (scores, languages). It travels to tasks, where it is called once."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(learn)
    sizes = rows.select("id", F.length("text").alias("chars"))
    known = labels.select(F.col(id_col).cast(docs.schema[id_col].dataType).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)").where(learn).groupBy("id").agg(F.max("y").alias("y"))
    known = known.withColumn("half", F.expr("cast(pmod(xxhash64(id, 'half'), 2) as int)"))
    n, chars = np.zeros((2, 2), np.int64), 0
    for r in sizes.join(known, "id").groupBy("half", "y").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).collect():
        n[r.half, r.y], chars = r.n, chars + (r.chars or 0)
    share = n[:, 1].sum() / n.sum() if n.any() else 0.5
    if not n.sum(axis=0).all():
        return lambda: lambda texts: (np.full(len(texts), share), np.zeros(len(texts), int))
    blocks = blocks_of(likely(rows, known, int(n.sum())), known, math.ceil(max(n.sum() / ROWS, chars / CHARS)))
    with single_rows(docs.sparkSession):  # else all blocks of a task would stand in memory at once
        nets = learned(blocks, n)
        limits = set_thresholds(blocks, nets)
    base, raw = float(np.log(cut / (1 - cut))), nets[ALL].bytes()

    def make():
        scorer = Scorer(Net.of(raw))

        def rate(texts):
            logit, language = scorer(texts)
            z = logit - limits[language] + base
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            return np.where(z >= base, np.maximum(score, cut), np.minimum(score, np.nextafter(cut, 0))), language

        return rate

    return make


def toxicity_scores(docs: DataFrame, labels: DataFrame, learn: str = LEARN, cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Score every whole text for toxicity.

    Returns the id, held_out (not among the rows that `learn` allows for learning), score (0 to 1, higher: label 1
    likelier), predicted (1 if score >= cut) and language (guessed from the text, or empty). The score is the logistic of the
    net's logit, moved so that the threshold of the text's language falls on cut. Labels are learned from all allowed
    rows; nothing but the text enters a score. Null and empty texts get the score of a text without words; unless rows
    here have labels of both kinds, every score is the share of label 1 among them, or 0.5; an id with both labels counts as
    label 1, and all its rows are learned from; labels other than 0 and 1 are left out; a null id is held out; repeated
    rows get equal scores; other columns are ignored; no rows in, no rows out.

    Three nets are trained at once, in blocks whose changes are averaged after each pass: two on halves, whose logits of
    the other half set the thresholds, and one on all. Rows of one id share a block. Scoring is a map.
    """
    make = toxicity_model(docs, labels, learn, cut, id_col, text_col, label_col)
    schema = pa.schema([("id", table_type(docs, id_col)), ("score", pa.float64()), ("language", pa.string())])

    def rate(batches):
        score = make()
        for batch in small(batches):
            found, language = score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), pa.array([LANGUAGES[k] for k in language], pa.string())], schema=schema)

    rated = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(rate, f"id {docs.schema[id_col].dataType.simpleString()}, score double, language string")
    return rated.select(F.col("id").alias(id_col), F.expr(f"not coalesce({learn}, false)").alias("held_out"), "score", F.expr(f"cast(score >= {cut}D as int)").alias("predicted"), "language")


def toxicity_filter(docs: DataFrame, labels: DataFrame, learn: str = LEARN, cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of docs, all columns, whose text scores below cut; edge cases as in toxicity_scores. Texts are not shuffled."""
    make = toxicity_model(docs, labels, learn, cut, id_col, text_col, label_col)

    def keep(batches):
        score = make()
        for batch in small(batches):
            found, _ = score(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
            yield batch.filter(pa.array(found < cut, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
