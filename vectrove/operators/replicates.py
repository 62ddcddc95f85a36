"""Resampling without copies of rows: weights drawn where the rows are, labels dealt out over blocks.

Bootstrap. A row's weight in a replicate is a Poisson number of mean 1, read from the md5 of key, replicate and seed, so any
engine draws the same and no draw has to meet a row by its number. The size of a replicate varies around the number of rows;
statistics that are ratios (means, areas, rates) have the intervals of drawing with replacement up to terms of order 1 / n.

Areas and thresholds need rows in order of their scores. Scores are cut at approximate percentiles. A first pass adds the
weights of each slot - one for each score that is a cut, one for each open range between two - in the tasks that read the
rows. A second pass sends the open ranges' rows, once each, to the task of their range, which goes through them from the top,
starting from the sums of the slots above. A score that many rows share is a cut, so its rows are only added, never sent.

Draws with replacement. Draw i of a replicate takes the row of number floor(U(i, replicate, seed) N), so a replicate is a
count for each row. Tasks compute a replicate's draws some at a time and send the counts of each block of row numbers, a byte
a row; a block's rows get theirs as one column, whose bytes then serve as weights. Means need no such column: the counts meet
a block's values, and the block sends a sum a replicate.

Permutations by md5. The label-1 places are the k rows of least digest. A block of rows sends, for each permutation, sums of
what lies safely below the k-th digest, and the digests near it one by one.

Permutations by blocks. Rows lie in blocks. The number of label-1 places that fall into a block is hypergeometric, halved down a tree
of blocks; inside a block the places are a random choice, row by row for all permutations at once. Each block sends one sum for each permutation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digests import Digests
from ..shared import stored
from .ranks import numbered

#: Smallest md5 digits (of 2**32) that give a weight of at least 1, 2, ...: 2**32 times Poisson's distribution function of mean 1, rounded.
STEPS = np.rint(2.0**32 * np.exp(-1.0) * np.cumsum(1 / np.cumprod(np.r_[1.0, np.arange(1, 13)]))).astype(np.int64)
STEPS = STEPS[STEPS < 2**32]
#: Cuts of the scores; replicates a row of sums; numbers of a matrix of weights.
CUTS, BLOCK, CELLS = 64, 128, 2_000_000
#: Blocks of a permutation test at most, and rows of a block where there are fewer blocks.
BLOCKS, ROWS = 1024, 256
#: Draws of a replicate worked on at once; bytes of counts of a block of rows; rows of a block in a permutation by md5; its permutations worked on at once.
DRAWS, COUNTS, KEYS, SOME = 1 << 22, 1 << 25, 32_768, 500


def weights(keys: list[str], n: int, seed: int) -> np.ndarray:
    """The weight of each key (rows) in each of n replicates (columns); four replicates share an md5."""
    tails = [f"|{i}|{seed}".encode() for i in range((n + 3) // 4)]
    draws = b"".join(md5(k + t).digest() for k in (k.encode() for k in keys) for t in tails)
    numbers = np.frombuffer(draws, ">u4").reshape(len(keys), 4 * len(tails))[:, :n].astype(np.int64)
    return np.searchsorted(STEPS, numbers, side="right")


def _rows(df: DataFrame, key: str, *columns) -> DataFrame:
    """Keys as text and the columns, dealt out evenly: a row costs n draws, far more than its shuffle."""
    return df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), *columns).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _parts(batch: pa.RecordBatch, n: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose weights have about CELLS numbers."""
    step = max(1, CELLS // max(1, n))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def _given(part: pa.RecordBatch, n: int) -> np.ndarray:
    """The weights that rows carry in _w, a byte for each of n replicates."""
    return np.frombuffer(b"".join(part["_w"].to_pylist()), np.uint8).reshape(part.num_rows, n)


def drawn(df: DataFrame, key: str, n: int, seed: int, strata: str | None = None) -> DataFrame:
    """Adds _w: how often each of n replicates draws the row, with replacement, as many rows as there are, within strata if named.

    Draw i of a replicate takes the row of number floor(U(i, replicate, seed) N) in the order of the key, U being the first
    eight md5 digits of "i|replicate|seed" over 2**32 - 1. Rows of a null stratum are left out. A row drawn more than 255 times
    in one replicate is an error.
    """
    pairs, block = _counted(df, key, n, seed, strata)
    if pairs is None:
        return df.limit(0).withColumn("_w", F.lit(None).cast("binary"))
    columns, fields = df.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def give(mine: pa.Table, found: pa.Table) -> pa.Table:
        at, w = mine["_at"].to_numpy(), np.zeros((0, n), np.uint8)
        if len(at):
            w = np.zeros((n, block), np.uint8)
            for r, raw in zip(found["_r"].to_pylist(), found["_counts"]):
                c = np.frombuffer(raw.as_buffer(), np.uint8)
                w[r, : len(c)] += c
                if (w[r, : len(c)] < c).any():
                    raise ValueError("a row was drawn more than 255 times")
            w = np.ascontiguousarray(w.T)[at]
        bytes_ = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.arange(len(at) + 1, dtype=np.int32) * np.int32(n)), pa.py_buffer(w)])
        return mine.select(columns).append_column("_w", bytes_)

    return pairs.applyInArrow(give, f"{fields}, _w binary")


def _counted(df: DataFrame, key: str, n: int, seed: int, strata: str | None = None):
    """The draws of `drawn`: blocks of rows, with their places _at, beside the blocks' counts (_r, _counts), and the rows of a block; None without rows."""
    spark, by = df.sparkSession, [strata] if strata else []
    rows = stored(df.where(F.col(strata).isNotNull()) if by else df, "rows")
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    told = [(i, *r) for i, r in enumerate(sizes.collect()) if r["_n"]]  # a row a stratum
    many = {r[0]: r[-1] for r in told}
    parts = [(h, i, min(size, i + DRAWS)) for h, size in many.items() for i in range(0, size, DRAWS)]
    block = max(1, COUNTS // max(1, n) // max(1, max((-(-x // DRAWS) for x in many.values()), default=1)))
    counted = pa.schema([("_h", pa.int32()), ("_block", pa.int64()), ("_r", pa.int32()), ("_counts", pa.binary())])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, digests = -1, []
        for batch in batches:
            for at in batch["id"].to_pylist():
                (h, low, high), r = parts[at // n], at % n
                if at // n != part:  # the numbers are laid out once for a task's replicates
                    part, digests = at // n, [Digests.of_numbers(i, min(high, i + (1 << 18))) for i in range(low, high, 1 << 18)]
                size, tail, picks = many[h], f"|{r}|{seed}".encode(), []
                for some in digests:
                    u = some.leading(tail) / 4294967295.0
                    picks.append(np.minimum(np.floor(u * size), size - 1).astype(np.int64))
                picks = np.sort(np.concatenate(picks))
                edges = np.searchsorted(picks, np.arange(0, size + block, block))
                counts = [np.bincount(picks[a:b] - k * block, minlength=min(block, size - k * block)) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
                if max(c.max() for c in counts) > 255:
                    raise ValueError("a row was drawn more than 255 times")
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([h] * len(counts), range(len(counts)), [r] * len(counts), [c.astype(np.uint8).tobytes() for c in counts]), counted)], schema=counted)

    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = n * len(parts)
    counts = spark.range(0, tasks, 1, max(1, min(tasks, shuffles))).mapInArrow(draw, "_h int, _block long, _r int, _counts binary")
    numbers = numbered(rows, key, "_i", tuple(by))
    if by:
        levels = spark.createDataFrame([(i, v) for i, v, _ in told], f"_h int, _level {rows.schema[strata].dataType.simpleString()}")
        numbers = numbers.join(F.broadcast(levels), F.col(strata) == F.col("_level")).drop("_level")  # a row a stratum
    else:
        numbers = numbers.withColumn("_h", F.lit(0))
    numbers = numbers.withColumns({"_block": F.floor(F.col("_i") / block).cast("long"), "_at": (F.col("_i") % block).cast("int")}).drop("_i")
    return (numbers.groupBy("_h", "_block").cogroup(counts.groupBy("_h", "_block")) if told else None), block


def drawn_means(df: DataFrame, value: str, key: str, n: int, seed: int) -> DataFrame:
    """(replicate, value) of n means of rows drawn with replacement. Nulls are left out, a NaN makes its replicates NaN; a replicate without a value has a null."""

    schema = pa.schema([("replicate", pa.int32()), ("_s", pa.float64()), ("_w", pa.float64())])

    def add(mine: pa.Table, found: pa.Table) -> pa.Table:
        has = mine.filter(mine["_v"].is_valid())
        at, v, total = has["_at"].to_numpy(), has["_v"].to_numpy(), np.zeros((2, n))
        good = np.isfinite(v)
        both = np.stack([np.where(good, v, 0.0), np.ones(len(v))], axis=1)
        for r, raw in zip(found["_r"].to_pylist(), found["_counts"]):
            c = np.frombuffer(raw.as_buffer(), np.uint8)[at]
            total[:, r] += c @ both
            total[0, r] += v[~good & (c > 0)].sum()
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip((np.arange(n, dtype=np.int32), *total), schema)], schema=schema)

    pairs, _ = _counted(df.select(key, F.col(value).cast("double").alias("_v")), key, n, seed)
    if pairs is None:
        sums = df.sparkSession.createDataFrame([], "replicate int, _s double, _w double")
    else:
        sums = pairs.applyInArrow(add, "replicate int, _s double, _w double")
    return sums.groupBy("replicate").agg(F.sum("_s").alias("_s"), F.sum("_w").alias("_w")).select("replicate", F.try_divide("_s", "_w").alias(value))


def weighted_means(df: DataFrame, value: str, key: str, n: int, seed: int) -> DataFrame:
    """(replicate, value) of n weighted means, from one scan that sends n rows a task. Null and NaN values are left out; a replicate without weight has no row."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, n))
        for batch in batches:
            for part in _parts(batch, n):
                w = weights(part["_key"].to_pylist(), n, seed)
                total += np.stack([part["_v"].to_numpy() @ w, w.sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(total[0]), pa.array(total[1])], ["replicate", "_s", "_w"])

    v = F.col(value).cast("double")
    sums = _rows(df.where(v.isNotNull() & ~F.isnan(v)), key, v.alias("_v")).mapInArrow(add, "replicate int, _s double, _w double")
    return sums.groupBy("replicate").agg(F.sum("_s").alias("_s"), F.sum("_w").alias("_w")).where("_w > 0").select("replicate", (F.col("_s") / F.col("_w")).alias(value))


def _slots(scores: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Even: the open range below that cut; odd: the cut itself."""
    at = np.searchsorted(cuts, scores)
    hit = np.zeros(len(scores), bool)
    inside = at < len(cuts)
    hit[inside] = cuts[at[inside]] == scores[inside]
    return 2 * at + hit


_SUMS = "_slot int, _block int, _pos array<long>, _neg array<long>"


def _table(rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    slot, block, pos, neg = zip(*rows)
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(block, pa.int32()), pa.array(list(pos), longs), pa.array(list(neg), longs)], ["_slot", "_block", "_pos", "_neg"])


def weighted_curves(df: DataFrame, score: str, key: str, n: int, seed: int, label: str = "label") -> DataFrame:
    """(replicate, roc_auc, pr_auc, threshold, youden, sensitivity, specificity) of n weighted replicates.

    Rows without a label (0 or 1) or a score, or with a NaN score, are left out. Areas are those of `both_areas`; the threshold
    has the largest sensitivity + specificity - 1 among the scores of positive weight, the highest of equal ones. Replicates
    in which a class has no weight have no row. The rows are written once and read three times.
    """
    s = F.col(score).cast("double")
    rows = _rows(df.where(s.isNotNull() & ~F.isnan(s) & F.col(label).isin(0, 1)), key, (s + F.lit(0.0)).alias("_s"), F.col(label).cast("int").alias("_y"))
    return _curves(rows, n, "_key", lambda part: weights(part["_key"].to_pylist(), n, seed))


def drawn_curves(df: DataFrame, score: str, key: str, n: int, seed: int, label: str = "label", strata: str | None = None) -> DataFrame:
    """As weighted_curves, of n replicates drawn with replacement from all rows, those without a score or label included."""
    rows = drawn(df.select(*dict.fromkeys([key, label, score, *[strata] * bool(strata)])), key, n, seed, strata)
    s = F.col(score).cast("double")
    rows = rows.where(s.isNotNull() & ~F.isnan(s) & F.col(label).isin(0, 1)).select("_w", (s + F.lit(0.0)).alias("_s"), F.col(label).cast("int").alias("_y"))
    return _curves(rows, n, "_w", lambda part: _given(part, n))


def _curves(rows: DataFrame, n: int, source: str, weigh: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The curves of rows (_s, _y and the source of their weights)."""
    rows, kind = stored(rows, "scores"), rows.schema[source].dataType
    found = rows.agg(F.percentile_approx("_s", [i / CUTS for i in range(1, CUTS)], 1000)).first()[0]  # 63 numbers
    cuts = np.unique(np.array(found or [], np.float64))
    blocks = [(b, slice(b * BLOCK, min(n, (b + 1) * BLOCK))) for b in range(-(-n // BLOCK))]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in _parts(batch, n):
                w, y, at = weigh(part), part["_y"].to_numpy(), _slots(part["_s"].to_numpy(), cuts)
                for slot in np.unique(at).tolist():
                    mine = at == slot
                    sums.setdefault(slot, np.zeros((2, n), np.int64))
                    sums[slot] += np.stack([w[mine & (y == 1)].sum(0, dtype=np.int64), w[mine & (y == 0)].sum(0, dtype=np.int64)])
        for slot, (pos, neg) in sums.items():
            yield _table([(slot, b, pos[r], neg[r]) for b, r in blocks])

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block: the sums of each slot, then, under its number, what stands above it, and all (slot -1)."""
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for slot, block, pos, neg in zip(*(batch[c].to_pylist() for c in ("_slot", "_block", "_pos", "_neg"))):
                sums[block, slot] = sums.get((block, slot), 0) + np.array([pos, neg], np.int64)
        for block in sorted({b for b, _ in sums}):
            run = 0
            for slot in sorted((t for b, t in sums if b == block), reverse=True):
                own = sums[block, slot]
                yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([block], pa.int32()), *(pa.array([list(x)], pa.list_(pa.int64())) for x in (*own, *(run + 0 * own)))], ["_slot", "_block", "_pos", "_neg", "_tp", "_fp"])
                run = run + own

    sums = stored(rows.mapInArrow(add, _SUMS).repartition(len(blocks), "_block").mapInArrow(above, _SUMS + ", _tp array<long>, _fp array<long>"), "sums")
    # the lowest slot's own sums and those above it are all there is
    whole = sums.groupBy("_block").agg(F.min_by(F.struct("_pos", "_neg", "_tp", "_fp"), "_slot").alias("_a"))
    whole = whole.select("_block", F.zip_with("_a._pos", "_a._tp", lambda a, b: a + b).alias("_p"), F.zip_with("_a._neg", "_a._fp", lambda a, b: a + b).alias("_q"))
    heads = sums.join(F.broadcast(whole), "_block")  # a row for BLOCK replicates
    empty = {c: F.lit(None).cast("array<long>") for c in ("_pos", "_neg", "_tp", "_fp", "_p", "_q")}
    at = F.size(F.filter(F.lit(cuts.tolist()).cast("array<double>"), lambda c: c < F.col("_s")))
    is_cut = F.array_contains(F.lit(cuts.tolist()).cast("array<double>"), F.col("_s"))
    body = rows.where(~is_cut).withColumn("_slot", (2 * at).cast("int")).withColumns({**empty, "_block": F.lit(None).cast("int")})
    heads = heads.withColumns({source: F.lit(None).cast(kind), "_s": F.lit(None).cast("double"), "_y": F.lit(None).cast("int")})
    mixed = body.unionByName(heads).repartition(len(cuts) + 1, "_slot").sortWithinPartitions("_slot", F.col("_s").desc_nulls_first())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            slots = batch["_slot"].to_numpy()
            for piece in np.split(np.arange(len(slots)), np.flatnonzero(np.diff(slots)) + 1):
                if not len(piece):
                    continue
                part = batch.slice(int(piece[0]), len(piece))
                slot = int(slots[piece[0]])
                if state is None or state.slot != slot:
                    if state is not None:
                        yield state.result()
                    state = _Walk(slot, n, cuts)
                heads = int(part["_s"].null_count)
                for i in range(heads):
                    state.head(int(part["_block"][i].as_py()), {c: part[c][i].values.to_numpy() for c in ("_pos", "_neg", "_tp", "_fp", "_p", "_q")})
                for some in _parts(part.slice(heads), n):
                    state.rows(some["_s"].to_numpy(), some["_y"].to_numpy(), weigh(some))
        if state is not None:
            yield state.result()

    each = mixed.mapInArrow(walk, "replicate int, _won double, _ap double, _pq double, threshold double, youden double, _tpr double, _fpr double")
    best = F.max(F.struct("youden", "threshold", "_tpr", "_fpr"))
    out = each.groupBy("replicate").agg(F.sum("_won").alias("_won"), F.sum("_ap").alias("pr_auc"), F.max("_pq").alias("_pq"), best.alias("_b")).where("_pq > 0")
    return out.select("replicate", (F.col("_won") / F.col("_pq")).alias("roc_auc"), "pr_auc", F.col("_b.threshold").alias("threshold"), F.col("_b.youden").alias("youden"), F.col("_b._tpr").alias("sensitivity"), (1 - F.col("_b._fpr")).alias("specificity"))


class _Walk:
    """A slot gone through from its highest score, for all replicates at once; between batches it holds a few vectors."""

    def __init__(self, slot: int, n: int, cuts: np.ndarray):
        self.slot, self.n, self.cut = slot, n, float(cuts[slot // 2]) if slot % 2 else None
        self.own = np.zeros((2, n), np.int64)
        self.tp, self.fp, self.p, self.q = (np.zeros(n) for _ in range(4))
        self.won, self.ap = np.zeros(n), np.zeros(n)
        self.youden, self.threshold, self.tpr, self.fpr = np.full(n, -np.inf), np.zeros(n), np.zeros(n), np.zeros(n)
        self.last, self.tie = None, np.zeros((2, n))

    def head(self, block: int, found: dict[str, np.ndarray]) -> None:
        r = slice(block * BLOCK, min(self.n, (block + 1) * BLOCK))
        self.own[:, r] = found["_pos"], found["_neg"]
        self.tp[r], self.fp[r], self.p[r], self.q[r] = found["_tp"], found["_fp"], found["_p"], found["_q"]

    def rows(self, scores: np.ndarray, labels: np.ndarray, w: np.ndarray) -> None:
        edges = np.flatnonzero(np.r_[True, scores[1:] != scores[:-1], True]) if len(scores) else []
        for i, j in zip(edges[:-1], edges[1:]):
            if self.last is not None and scores[i] != self.last:
                self._close()
            self.last = float(scores[i])
            ones = labels[i:j] == 1
            self.tie += np.stack([w[i:j][ones].sum(0, dtype=np.int64), w[i:j][~ones].sum(0, dtype=np.int64)])

    def _close(self) -> None:
        """Account for the tie at hand."""
        pos, neg = self.tie
        self.tp, self.fp = self.tp + pos, self.fp + neg
        self.won += pos * (self.q - self.fp + neg / 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.ap += np.where(pos > 0, pos / self.p * self.tp / (self.tp + self.fp), 0.0)
            tpr, fpr = self.tp / self.p, self.fp / self.q
        better = (pos + neg > 0) & (self.p * self.q > 0) & (tpr - fpr > self.youden)
        for name, x in (("youden", tpr - fpr), ("threshold", self.last), ("tpr", tpr), ("fpr", fpr)):
            setattr(self, name, np.where(better, x, getattr(self, name)))
        self.tie = np.zeros((2, self.n))

    def result(self) -> pa.RecordBatch:
        if self.cut is not None:
            self.last, self.tie = self.cut, self.own.astype(float)
        if self.last is not None:
            self._close()
        columns = [np.arange(self.n, dtype=np.int32), self.won, self.ap, self.p * self.q, self.threshold, self.youden, self.tpr, self.fpr]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["replicate", "_won", "_ap", "_pq", "threshold", "youden", "_tpr", "_fpr"])


def ordered_permutations(df: DataFrame, value: str, key: str, n: int, seed: int, ones: int, count: int) -> DataFrame:
    """(replicate, _s, _c): for n permutations, sum and number of the values among the `ones` rows of least md5 of "key|replicate|seed".

    `count` is the number of rows. Digests are compared by their first 64 bits, which in one permutation of a million rows are
    equal by chance with a probability below 1e-7. A cut is looked for near its expected place, then, where it is not there, further off.
    """
    spark = df.sparkSession
    text = F.concat_ws("|", F.col(key).cast("string"), F.lit(""))  # a null key has no bar either
    tasks = max(1, -(-count // KEYS))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, KEYS):
                held.append(batch.slice(i, KEYS))
                size += held[-1].num_rows
                if size >= KEYS:
                    yield pack(held)
                    held, size = [], 0
        if size:
            yield pack(held)

    def pack(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(some).combine_chunks()
        return pa.RecordBatch.from_arrays([pa.array([whole["_k"].to_pylist()], pa.list_(pa.string())), pa.array([whole["_x"].to_pylist()], pa.list_(pa.float64()))], ["_k", "_x"])

    blocks = stored(df.select(text.alias("_k"), F.col(value).cast("double").alias("_x")).repartition(tasks).mapInArrow(packed, "_k array<string>, _x array<double>"), "blocks")
    spread = (ones / count * (1 - ones / count) / count) ** 0.5
    schema = pa.schema([("_g", pa.int32()), ("replicate", pa.int32()), ("_n", pa.int64()), ("_s", pa.float64()), ("_c", pa.int64()), ("_near", pa.binary()), ("_values", pa.binary()), ("_has", pa.binary())])
    found, todo, reach = None, np.arange(n, dtype=np.int32), 7.0
    while len(todo):
        low, high = (max(0.0, min(1.0, ones / count + s * reach * (spread + 1 / count))) * 2.0**32 for s in (-1, 1))
        low, high = int(low), int(high) if high < 2.0**32 else 1 << 32
        groups = [todo[i : i + SOME].tolist() for i in range(0, len(todo), SOME)]

        def halve(batches: Iterator[pa.RecordBatch], groups=groups, low=low, high=high) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    keys, x = Digests([k.encode() for k in batch["_k"][i].as_py()]), batch["_x"][i].values
                    has = x.is_valid().to_numpy(zero_copy_only=False)
                    x = x.fill_null(0.0).to_numpy()
                    whole, mine, rows = bool(np.isfinite(x).all()), groups[batch["_g"][i].as_py()], []
                    both = np.stack([x, has, np.ones(len(x))], axis=1)
                    for r in mine:
                        tail = f"{r}|{seed}".encode()
                        head, rest = keys.both(tail)
                        below, near = head < low, np.flatnonzero((head >= low) & (head < high))
                        s, c, m = below.astype(np.float64) @ both if whole else (x[below].sum(), has[below].sum(), below.sum())
                        rows.append((r // 25, r, int(m), float(s), int(c), (head[near].astype(np.uint64) << np.uint64(32) | rest[near]).tobytes(), x[near].tobytes(), has[near].tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        def cut(table: pa.Table) -> pa.Table:
            by, out = table["replicate"].to_numpy(), []
            for r in np.unique(by).tolist():
                mine = table.filter(pa.array(by == r))
                below, s, c = (sum(mine[k].to_pylist()) for k in ("_n", "_s", "_c"))
                near, x, has = (np.frombuffer(b"".join(mine[k].to_pylist()), t) for k, t in (("_near", np.uint64), ("_values", np.float64), ("_has", bool)))
                need = ones - below
                if 0 <= need <= len(near):
                    first = np.argsort(near, kind="stable")[:need]
                    out.append((r, s + float(x[first].sum()), c + int(has[first].sum()), True))
                else:
                    out.append((r, 0.0, 0, False))
            return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.float64(), pa.int64(), pa.bool_()))], names=["replicate", "_s", "_c", "_found"])

        cells = blocks.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(len(groups) - 1)))).repartition(min(1024, tasks * len(groups)))
        each = stored(cells.mapInArrow(halve, "_g int, replicate int, _n long, _s double, _c long, _near binary, _values binary, _has binary").groupBy("_g").applyInArrow(cut, "replicate int, _s double, _c long, _found boolean"), "permutations")
        good = each.where("_found").drop("_found")
        found = good if found is None else found.unionByName(good)
        todo, reach = np.array([r.replicate for r in each.where("not _found").collect()], np.int32), reach * 8  # none, but for a chance of 1e-12
    return found if found is not None else spark.createDataFrame([], "replicate int, _s double, _c long")


def dealt(sizes: np.ndarray, block: int, ones: int, n: int, seed: int) -> np.ndarray:
    """How many of `ones` label-1 places fall into a block, for n permutations: hypergeometric at each node of the tree that halves the blocks."""
    ends = np.r_[0, np.cumsum(sizes)]
    low, high, k = 0, len(sizes), np.full(n, ones, np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        draw = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, low, high])))
        left = draw.hypergeometric(int(ends[mid] - ends[low]), int(ends[high] - ends[mid]), k)
        low, high, k = (low, mid, left) if block < mid else (mid, high, k - left)
    return k


def permutation_split(df: DataFrame, value: str, n: int, seed: int, label: str = "label", least: int = 3) -> DataFrame:
    """(difference, p) of class means under n permutations of the labels: (times as far + 1) / (n + 1).

    Null and NaN values keep their place in the permutation and count in no mean. With fewer than `least` values in a class p
    is NaN. Rows without a label (0 or 1) are left out. Rows are written once, into at most BLOCKS blocks; a block's values
    are one array in a task, and it sends a sum and a count for each permutation. Blocks are random, so the draws, not their
    distribution, change with the partitioning. numpy's hypergeometric draws limit the rows to 1e9 on either half.
    """
    v = F.col(value).cast("double")
    known = F.when(~F.isnan(v), v)
    rows = stored(df.where(F.col(label).isin(0, 1)).select(known.alias("_x"), F.col(label).cast("int").alias("_y"), F.floor(F.rand(seed) * BLOCKS).cast("int").alias("_fine")), "rows")
    one = lambda k, f: f(F.when(F.col("_y") == k, F.col("_x")))
    whole = rows.agg(F.sum("_y").alias("_k"), (one(1, F.avg) - one(0, F.avg)).alias("difference"), F.sum("_x").alias("_all"), F.count("_x").alias("_m"), one(0, F.count).alias("_n0"), one(1, F.count).alias("_n1"), F.count("*").alias("_rows"))
    told = whole.first()
    count = max(1, min(BLOCKS, told["_rows"] // ROWS))
    rows = rows.withColumn("_block", F.floor(F.col("_fine") * count / BLOCKS).cast("int"))
    sizes = np.zeros(count, np.int64)
    for r in rows.groupBy("_block").count().collect():  # at most BLOCKS rows
        sizes[r["_block"]] = r["count"]
    ones = int(told["_k"] or 0)

    def choose(block: pd.DataFrame) -> pd.DataFrame:
        b, x = int(block["_block"].iloc[0]), np.sort(block["_x"].to_numpy(np.float64))
        k = dealt(sizes, b, ones, n, seed)
        draw = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, b])))
        sums, counts, left = np.zeros(n), np.zeros(n, np.int64), k.astype(np.float64)
        for i, v in enumerate(x.tolist()):  # each place in turn, with the chance that is left to it in each permutation
            taken = draw.random(n) < left / (len(x) - i)
            left -= taken
            if v == v:
                counts += taken
                sums += np.where(taken, v, 0.0)
        return pd.DataFrame({"_r": np.arange(n), "_s": sums, "_c": counts})

    each = rows.select("_block", "_x").groupBy("_block").applyInPandas(choose, "_r long, _s double, _c long").groupBy("_r").agg(F.sum("_s").alias("_s"), F.sum("_c").alias("_c"))
    d = F.try_divide("_s", "_c") - F.try_divide(F.lit(told["_all"]).cast("double") - F.col("_s"), F.lit(told["_m"]) - F.col("_c"))
    true = F.lit(told["difference"]).cast("double")
    p = (F.coalesce(F.sum((F.abs(d) >= F.abs(true) - 1e-12).cast("int")), F.lit(0)) + 1) / F.lit(n + 1.0)
    if min(told["_n0"], told["_n1"]) < least:
        p = F.lit(float("nan"))
    return each.agg(F.lit(told["difference"]).cast("double").alias("difference"), p.alias("p"))
