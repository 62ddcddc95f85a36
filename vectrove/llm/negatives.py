"""Hard negatives by exact integer scores from products in a residue number system.

Components are whole numbers. A block of anchors and a batch of rows are multiplied modulo several small primes, where the
sums of products of balanced residues stay below 2**24, so float32 matrix products are exact; mixed-radix Chinese
remaindering gives the signed scores. Groups of anchors meet groups of all rows: rows stream through a task in the order of
their ids, the task keeps each anchor's best few, and windows over these few choose the final ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import parallelism, stored

#: Largest modulus; components multiplied between reductions, so that WIDTH * (LARGEST // 2)**2 < 2**24; bound of scores.
LARGEST, WIDTH, MOST = 1021, 64, 2**51
#: Anchors and rows of a group; rows of a group while groups are fewer than the session's shuffle partitions; anchors multiplied at once.
ANCHORS, ROWS, FEW, STEP = 8192, 1_000_000, 1024, 128
NOTHING = -(2**62)


def moduli(bound: float) -> list[int]:
    """Primes from LARGEST down whose product is over twice the bound, so that signed scores up to it differ in residues."""
    found, product = [], 1
    for p in range(LARGEST, 2, -1):
        if product > 2 * bound + 1:
            break
        if all(p % q for q in range(2, int(p**0.5) + 1)):
            found.append(p)
            product *= p
    return found


def residues(x: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """Balanced residues of whole doubles, one float32 matrix for each prime."""
    out = []
    for p in primes:
        r = np.mod(x, p)
        out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
    return out


def products(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """All inner products of two matrices' rows, exact and signed, from their residues."""
    value, product = np.zeros((len(a[0]), len(b[0])), np.int64), 1
    for x, y, p in zip(a, b, primes):
        left = np.zeros(value.shape, np.int64)
        for k in range(0, x.shape[1], WIDTH):
            left = (left + (x[:, k : k + WIDTH] @ y[:, k : k + WIDTH].T).astype(np.int64)) % p
        value += (left - value) % p * pow(product, -1, p) % p * product  # the next digit in mixed radix
        product *= p
    return np.where(value > product // 2, value - product, value)


class Best:
    """Of a group's anchors, for each of their windows of scores, the best `keep` rows met so far; rows come in order of their ids."""

    def __init__(self, primes: list[int], same: bool, keep: int):
        self.primes, self.same, self.keep, self.parts, self.met = primes, same, keep, [], 0

    def anchors(self, batch: pa.RecordBatch) -> None:
        self.parts.append(batch)

    def _begin(self) -> None:
        t = pa.Table.from_batches(self.parts).combine_chunks()
        self.parts = []
        self.row, self.label = t["row"].to_numpy(), t["label"].to_numpy()
        self.x = residues(_matrix(t["q"].combine_chunks()), self.primes)
        least, most = t["least"].to_pylist(), t["most"].to_pylist()
        n, w = len(self.row), max(map(len, least))
        self.least, self.most = np.full((n, w), -NOTHING), np.full((n, w), NOTHING)  # a missing window takes nothing
        for i, (a, b) in enumerate(zip(least, most)):
            self.least[i, : len(a)], self.most[i, : len(b)] = a, b
        shape = (n, w, self.keep)
        self.score, self.order, self.id, self.known = np.full(shape, NOTHING), np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, bool)

    def meet(self, batch: pa.RecordBatch) -> None:
        if self.parts:
            self._begin()
        row, label = batch.column("row").to_numpy(), batch.column("label").to_numpy()
        ids = batch.column("id")
        known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        y = residues(_matrix(batch.column("q")), self.primes)
        for at in range(0, len(self.row), STEP):
            some = slice(at, at + STEP)
            score = products([x[some] for x in self.x], y, self.primes)
            fits = (self.label[some, None] == label) == self.same
            if self.same:
                fits &= self.row[some, None] != row
            for w in range(self.least.shape[1]):
                worst = self.score[some, w, -1]
                # rows come in the order of their ids, so one that ties with the last place is behind it
                mask = fits & (score >= np.maximum(self.least[some, w], worst + 1)[:, None]) & (score <= self.most[some, w][:, None])
                if mask.sum() > 16 * len(mask):
                    mask = _first(score, mask, self.keep)
                a, c = np.nonzero(mask)
                if len(a):
                    self._merge(at + a, w, score[a, c], self.met + c, ids[c], known[c])
        self.met += len(row)

    def _merge(self, a, w, score, order, ids, known) -> None:
        """Put candidates of window w among their anchors' best."""
        mine = np.unique(a)
        k = self.keep
        a = np.r_[np.repeat(mine, k), a]
        old = [x[mine, w].ravel() for x in (self.score, self.order, self.id, self.known)]
        score, order, ids, known = (np.r_[o, n] for o, n in zip(old, (score, order, ids, known)))
        by = np.lexsort((order, -score, a))
        begun = np.searchsorted(a[by], mine)
        take = by[begun[:, None] + np.arange(k)]
        for held, new in ((self.score, score), (self.order, order), (self.id, ids), (self.known, known)):
            held[mine, w] = new[take]

    def result(self):
        if self.parts:
            self._begin()
        a, w, k = np.nonzero(self.score > NOTHING)
        ids = pa.array(self.id[a, w, k], mask=~self.known[a, w, k])
        return pa.RecordBatch.from_arrays([pa.array(self.row[a]), pa.array(w.astype(np.int32)), ids, pa.array(self.score[a, w, k])], names=["anchor", "window", "id", "score"])


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column.flatten()) else np.zeros((len(column), 0))


def _first(score: np.ndarray, mask: np.ndarray, keep: int) -> np.ndarray:
    """Of the masked scores of each line the highest `keep`, the first ones of equal ones."""
    shown = np.where(mask, score, NOTHING)
    if shown.shape[1] <= keep:
        return mask
    last = np.partition(shown, -keep, axis=1)[:, -keep][:, None]
    over, equal = mask & (shown > last), mask & (shown == last)
    return over | equal & (np.cumsum(equal, axis=1) <= keep - over.sum(axis=1, keepdims=True))


def _best(anchors: DataFrame, rows: DataFrame, primes: list[int], same: bool, keep: int, group: int, anchor_group: int) -> DataFrame:
    """(anchor, window, id, score): for each anchor and window the best `keep` rows of the same label, or of others.

    anchors: row, label, size, q, least and most (a window's scores); rows: row, id, label, size, q.
    """
    spread = parallelism(rows.sparkSession)
    n = rows.groupBy("size").count().select("size", F.expr(f"greatest(ceil(count / {group}), least({spread}, ceil(count / {FEW})))").alias("js"))
    m = anchors.groupBy("size").count().select("size", F.expr(f"ceil(count / {anchor_group})").alias("is"))
    grid = n.join(m, "size")  # a row for each length of vectors
    left = anchors.join(grid, "size").select("size", F.expr("pmod(xxhash64(row, 1), `is`)").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("js") - 1)).alias("j"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("id"), "row", "label", "q", "least", "most")
    none = F.lit(None).cast("array<long>")
    right = rows.join(grid, "size").select("size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("is") - 1)).alias("i"), F.expr("pmod(xxhash64(row, 2), js)").alias("j"), F.lit(1).alias("side"), "id", "row", "label", "q", none.alias("least"), none.alias("most"))

    def run(batches):
        key, best = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            named = np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in ("size", "i", "j", "side")])
            edges = np.r_[0, np.flatnonzero((named[1:] != named[:-1]).any(axis=1)) + 1, len(named)]
            for a, b in zip(edges, edges[1:]):
                part = batch.slice(a, b - a)
                if tuple(named[a, :3]) != key:
                    if best is not None:
                        yield best.result()
                    key, best = tuple(named[a, :3]), Best(primes, same, keep)
                if named[a, 3] == 0:
                    best.anchors(part)
                elif best.parts or best.met or hasattr(best, "row"):
                    best.meet(part)
        if best is not None and (best.parts or hasattr(best, "row")):
            yield best.result()

    dealt = left.unionByName(right).repartition(spread, "size", "i", "j").sortWithinPartitions("size", "i", "j", "side", F.col("id").asc_nulls_last(), "row")
    return dealt.mapInArrow(run, "anchor long, window int, id long, score long")


def hard_negatives(rows: DataFrame, anchors: str = "vec_id % 100 = 0", positives: int = 5, negatives: int = 5, low: int = 80, scale: float = 256.0, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", group: int = ROWS, anchor_group: int = ANCHORS) -> DataFrame:
    """For each anchor and positive, the best rows of other labels that score between low per cent of the positive's score and all of it.

    Components become floor(scale * x); a row's score is its integer inner product with the anchor. Higher scores come
    first, then smaller ids, null ids last. An anchor's positives are its first `positives` other rows of its label.
    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score; scores are exact.

    Rows with a null label or vector, or a null or non-finite component, take no part. Rows are told apart even if they are
    equal: one that repeats an anchor is another row, and a repeated anchor gives its rows again. Null ids are never anchors
    by an expression on the id, but serve as positives and negatives. Vectors meet those of their own length. Of a positive
    with a negative score nothing is returned, as no score lies in its window. Scores that may pass MOST raise an error. Other
    columns are ignored; no rows in, no rows out.
    """
    finite = f"coalesce(`{vector_col}` is not null and forall(`{vector_col}`, x -> x is not null and not isnan(x) and abs(x) < double('infinity')), false)"
    good = rows.where(F.col(label_col).isNotNull() & F.expr(finite)).select(F.expr(f"coalesce({anchors}, false)").alias("anchor"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    largest = good.select(F.expr(f"aggregate(v, 0D, (a, x) -> a + pow(abs({float(scale)}D * x) + 1, 2))").alias("n")).agg(F.max("n")).first()[0]
    if largest is not None and largest > MOST:
        raise ValueError("scores may pass 2**51")
    base = stored(good.select("anchor", F.monotonically_increasing_id().alias("row"), "id", "label", F.size("v").alias("size"), F.expr(f"transform(v, x -> cast(floor({float(scale)}D * x) as double))").alias("q")), "vectors")
    primes = moduli(largest or 0.0)
    start = base.where("anchor").drop("anchor")
    every = base.drop("anchor")
    one = start.select("row", "label", "size", "q", F.array(F.lit(NOTHING + 1)).alias("least"), F.array(F.lit(-NOTHING - 1)).alias("most"))
    found = stored(_best(one, every, primes, True, positives, group, anchor_group), "positives")
    by = Window.partitionBy("anchor").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    first = found.select("anchor", (F.row_number().over(by) - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).where(f"window < {positives}")
    first = stored(first, "first")
    bounds = first.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("window", "positive_score"))).alias("p"))  # at most `positives` each
    edge = f"cast(ceil({int(low)} * cast(x.positive_score as decimal(38,0)) / 100) as long)"
    two = start.join(bounds, F.col("row") == F.col("anchor")).select("row", "label", "size", "q", F.expr(f"transform(p, x -> {edge})").alias("least"), F.expr("transform(p, x -> x.positive_score)").alias("most"))
    others = _best(two, every, primes, False, negatives, group, anchor_group)
    by = Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = others.withColumn("rank", F.row_number().over(by)).where(f"rank <= {negatives}").join(first, ["anchor", "window"])
    named = start.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return ranked.join(named, "anchor").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
