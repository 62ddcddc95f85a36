"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored
from .substring import table_type
from .words import in_use, small

#: Random features, folds of the labelled rows, bins of ridge scores, parts of a sum matrix that travel apart, first-level sums.
FEATURES, FOLDS, BINS, PARTS, SUMS = 256, 5, 2000, 16, 32
#: Statistics of a text; see statistics().
WIDTH = 21
_CLASSES = np.zeros((256, 10), np.int64)
for _i, _chars in enumerate([range(65, 91), range(97, 123), range(48, 58), b" \t\n\r\x0b\x0c", b".", b",;:", b"!?", b"|", b"#$%&*@^~_=+<>\\/`", range(128, 256)]):
    _CLASSES[list(_chars), _i] = 1


def statistics(text: bytes | None) -> list[float]:
    """Sizes, shares of character classes, and how words and lines repeat; of a null or empty text, zeros."""
    if not text:
        return [0.0] * WIDTH
    words, lines, n = text.split(), text.split(b"\n"), len(text)
    share = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES / n
    w = len(words)
    distinct = len(set(words))
    again = sum(map(operator.eq, words, words[1:]))
    full = [x for x in lines if x.strip()]
    return [
        np.log1p(n), np.log1p(w), np.log1p(len(full)), n / max(w, 1) / 10, distinct / max(w, 1), np.log1p(distinct) / max(np.log1p(w), 1e-9), again / max(w - 1, 1),
        len(set(full)) / max(len(full), 1), np.log1p(w / max(len(full), 1)), len(set(map(bytes.lower, set(words)))) / max(distinct, 1), *np.sqrt(share), float(share[8] + share[6] + share[7]),
    ]


def fourier(x: np.ndarray, middle: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features whose products approximate a Gaussian kernel of the standardised statistics; the last one is constant."""
    rng = np.random.default_rng(20240517)
    w, b = rng.normal(size=(WIDTH, FEATURES)) / np.sqrt(WIDTH / 2), rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((x - middle) / scale, -5, 5)
    return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones(len(x))])


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the nearest non-decreasing values."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight):
        blocks.append([v * w, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w2, n = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w2
            blocks[-1][2] += n
    return np.concatenate([np.full(int(n), s / w) for s, w, n in blocks])


def statistics_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x) with the statistics of every whole text, stored."""
    schema = pa.schema([("id", table_type(docs, id_col)), ("x", pa.list_(pa.float64()))])

    def measure(batches):
        in_use()
        for batch in small(batches):
            x = np.array([statistics(t) for t in batch.column(1).to_pylist()], np.float64).reshape(-1, WIDTH)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * WIDTH, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], schema=schema)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return stored(rows.mapInArrow(measure, f"id {docs.schema[id_col].dataType.simpleString()}, x array<double>"), "statistics")


def matrix_of(batch, name: str = "x") -> np.ndarray:
    return batch.column(name).flatten().to_numpy().reshape(-1, WIDTH)


def train(sample: DataFrame, middle: np.ndarray, scale: np.ndarray, ridge: float) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Weights (one per left-out fold, then of all), bin edges and calibrated values from (x, y, fold) rows."""
    size = FEATURES + 1

    def sums(batches):
        """Per fold: sums of z z' and of z y over the partition, cut into PARTS rows."""
        total = np.zeros((FOLDS, size, size + 1))
        for batch in batches:
            z, y, fold = fourier(matrix_of(batch), middle, scale), batch.column("y").to_numpy().astype(float), batch.column("fold").to_numpy()
            for k in range(FOLDS):
                mine = z[fold == k]
                total[k] += mine.T @ np.column_stack([mine, y[fold == k]])
        salt = TaskContext.get().partitionId() % SUMS
        rows = [(k, p, salt, part.tobytes()) for k in range(FOLDS) for p, part in enumerate(np.array_split(total[k], PARTS))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["fold", "part", "salt", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in table["sums"].to_pylist())
        return pa.table([table["fold"][:1].combine_chunks(), table["part"][:1].combine_chunks(), table["salt"][:1].combine_chunks(), pa.array([total.tobytes()], pa.binary())], names=["fold", "part", "salt", "sums"])

    ddl = "fold int, part int, salt int, sums binary"
    parts = sample.mapInArrow(sums, ddl).groupBy("fold", "part", "salt").applyInArrow(add, ddl).groupBy("fold", "part").applyInArrow(add, ddl).collect()
    folds = [np.concatenate([np.frombuffer(r.sums, np.float64) for r in sorted((r for r in parts if r.fold == k), key=lambda r: r.part)] or [np.zeros(size * (size + 1))]).reshape(size, size + 1) for k in range(FOLDS)]
    whole = sum(folds)
    solve = lambda m: np.linalg.solve(m[:, :size] + ridge * np.eye(size), m[:, size])
    weights = [solve(whole - f) for f in folds] + [solve(whole)]
    edges = np.linspace(-0.5, 1.5, BINS + 1)

    def tally(batches):
        """Rows and positives for each bin of the score that the other folds give."""
        n, up = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
        for batch in batches:
            z, y, fold = fourier(matrix_of(batch), middle, scale), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            score = np.einsum("ij,ij->i", z, np.array(weights)[fold])
            place = np.clip(np.searchsorted(edges, score, "right") - 1, 0, BINS - 1)
            n += np.bincount(place, minlength=BINS)
            up += np.bincount(place, y, BINS).astype(np.int64)
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(n[full]), pa.array(up[full])], names=["bin", "n", "up"])

    found = sorted(sample.mapInArrow(tally, "bin int, n long, up long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("up").alias("up")).collect())
    at, n, up = (np.array(c, float) for c in zip(*found))
    return weights, (edges[:-1] + edges[1:])[at.astype(int)] / 2, isotonic(up / n, n)


LEARN = "crc32(cast(cast(id as string) as binary)) % 5 <> 0"


def quality_model(base: DataFrame, labels: DataFrame, learn: str, most_labelled: int, ridge: float, id_col: str, label_col: str):
    """A function from statistics (rows of a matrix) to scores, learned from the labels of rows that `learn` allows."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)").where(learn).groupBy("id").agg(F.max("y").alias("y"))
    n, up = known.agg(F.count("*"), F.sum("y")).first()
    share = up / n if n else 0.5
    constant = lambda x: np.full(len(x), share)
    if not n or not 0 < up < n:
        return constant
    limit = f"pmod(xxhash64(id, 'sample'), 1000000) < {min(1_000_000, int(1_000_000 * most_labelled / n))}"
    sample = stored(base.join(known.where(limit), "id").select("x", "y", F.expr(f"cast(pmod(xxhash64(id), {FOLDS}) as int)").alias("fold")), "labelled")
    if sample.isEmpty():
        return constant
    middle, scale = np.zeros(WIDTH), np.ones(WIDTH)
    for r in base.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect():
        middle[r.k], scale[r.k] = r.m, r.s if r.s and r.s > 1e-9 else 1.0
    weights, points, values = train(sample, middle, scale, ridge)
    return lambda x: np.interp(fourier(x, middle, scale) @ weights[-1], points, values)


def quality_scores(docs: DataFrame, labels: DataFrame, learn: str = LEARN, most_labelled: int = 50_000, ridge: float = 1.0, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Score every whole text for quality.

    Returns the id, held_out (not among the rows that `learn` allows for learning), score (0 to 1, higher: label 1
    likelier) and predicted (1 if score >= cut). Labels are learned from at most about most_labelled allowed rows, chosen by
    a hash of the id; nothing but the text enters a score. Null and empty texts get a score like others; without labels
    of both kinds every score is the share of label 1, or 0.5; an id with both labels counts as label 1, and all its rows
    are learned from; labels other than 0 and 1 are left out; a null id is held out; repeated rows get equal scores; other
    columns are ignored; no rows in, no rows out.

    Statistics are taken in one pass and stored. Normal equations are sums over partitions, one for each fold, added in two
    levels; isotonic regression runs on bins of scores that the other folds give.
    """
    base = statistics_table(docs, id_col, text_col)
    score = quality_model(base, labels, learn, most_labelled, ridge, id_col, label_col)
    schema = pa.schema([("id", table_type(docs, id_col)), ("score", pa.float64())])

    def rate(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score(matrix_of(batch)), pa.float64())], schema=schema)

    rated = base.mapInArrow(rate, f"id {docs.schema[id_col].dataType.simpleString()}, score double")
    return rated.select(F.col("id").alias(id_col), F.expr(f"not coalesce({learn}, false)").alias("held_out"), "score", F.expr(f"cast(score >= {cut}D as int)").alias("predicted"))


def quality_filter(docs: DataFrame, labels: DataFrame, learn: str = LEARN, most_labelled: int = 50_000, ridge: float = 1.0, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of docs, all columns, whose text scores cut or more; edge cases as in quality_scores. Texts are not shuffled."""
    score = quality_model(statistics_table(docs, id_col, text_col), labels, learn, most_labelled, ridge, id_col, label_col)

    def keep(batches):
        in_use()
        for batch in small(batches):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            x = np.array([statistics(t.encode() if t else None) for t in texts], np.float64).reshape(-1, WIDTH)
            yield batch.filter(pa.array(score(x) >= cut))

    return docs.mapInArrow(keep, docs.schema)
