"""Substring dedup: word windows that start at two places or more are removed."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .storage import parallelism
from .words import U, codes, mixed, rolling, split_words

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Odd bases of the two window hashes and of the anchors' hash.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Words of an anchor.
ANCHOR = 12


def text_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, carry: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(id, text as bytes, carried columns as a struct if any, block), each block about block_bytes of text, and the number of blocks. One shuffle of the texts."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), *([F.struct(*carry).alias("carried")] if carry else []))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    parts = min(blocks, max(parallelism(docs.sparkSession), 20_000))
    return rows.withColumn("block", F.expr(f"cast(pmod(xxhash64(id, text), {blocks}) as int)")).repartition(parts, "block"), blocks


class Windows:
    """The words of a block's documents as one array of codes, and its windows."""

    def __init__(self, texts: list[bytes | None], size: int):
        each = [codes(split_words(t)) for t in texts]
        self.size, self.lengths = size, np.array([len(x) for x in each], np.int64)
        self.codes = np.concatenate([*each, np.empty(0, U)])
        ends = np.repeat(np.cumsum(self.lengths), self.lengths)
        self.starts = np.flatnonzero(ends - np.arange(len(ends)) >= size)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(anchor of each window, anchors at the places where they stand).

        An anchor is the least hash among the runs of ANCHOR words in a window: equal windows have equal anchors, and
        few places of a text are anchors. Places of equal least runs in one window all count, which only adds candidates.
        """
        k = min(ANCHOR, self.size)
        if not len(self.starts):
            return np.empty(0, U), np.empty(0, U)
        runs = mixed(rolling(self.codes, k, BASES[2]))
        span = self.size - k + 1
        least = np.zeros(len(runs), U)
        low = extreme(runs, span, np.minimum)
        least[self.starts] = low[self.starts]
        high = extreme(np.r_[np.zeros(span - 1, U), least], span, np.maximum)
        return low[self.starts], runs[high == runs]

    def keys(self, which: np.ndarray) -> np.ndarray:
        """128-bit Rabin-Karp hashes of the windows at the starts `which`."""
        if not len(which):
            return np.empty((0, 2), U)
        first = mixed(rolling(self.codes, self.size, BASES[0])[which])
        second = rolling(mixed(self.codes), self.size, BASES[1])[which]
        return np.column_stack([first, second])

    def repeated_anchors(self, bits: np.ndarray) -> np.ndarray:
        """Starts of the windows whose anchor stands at two places or more."""
        each, standing = self.anchors()
        if not len(each):
            return self.starts[:0]
        found, _ = exchange.distinct(standing[:, None])
        return self.starts[bits[np.searchsorted(found[:, 0], each)]]

    def covered(self, starts: np.ndarray) -> list[np.ndarray]:
        """For each document, which words lie in a window that starts at one of `starts`."""
        change = np.zeros(len(self.codes) + 1, np.int64)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + self.size, -1)
        return np.split(np.cumsum(change)[:-1] > 0, np.cumsum(self.lengths)[:-1])


def extreme(x: np.ndarray, span: int, pick) -> np.ndarray:
    """pick over every `span` consecutive values, by doubling."""
    done = 1
    out = x
    while done < span:
        step = min(done, span - done)
        out = pick(out[:-step], out[step:])
        done += step
    return out


def cut(text: bytes, gone: np.ndarray) -> tuple[bytes, list[dict]]:
    """The text without the words marked in gone, other white space kept; and the maximal removed intervals of words."""
    spans = [m.span() for m in WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
    parts, at, intervals = [], 0, []
    for i, j in edges.reshape(-1, 2):
        parts.append(text[at : spans[i][0]])
        at = spans[j][0] if j < len(spans) else len(text)
        intervals.append({"start": int(i), "end": int(j)})
    return b"".join([*parts, text[at:]]), intervals


def substring_dedup(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, block_bytes: int = 8 << 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove every word covered by a window of `window` consecutive words whose sequence also starts elsewhere.

    Returns the id (as `id_col`), n_words, n_removed, kept_sha256 (of the kept words joined by a space) and, if
    with_text, `text` (the rest, white space as it was) and `removed` (maximal intervals of word positions). `carried` is a
    struct of the columns named in carry.
    Null and empty texts, and texts shorter than a window, keep all words; rows that repeat, also with one id or none,
    are documents of their own, and so remove each other's windows; other columns are ignored. No rows in, no rows out.

    Two counting rounds over compact key rows (see exchange): anchors first, each about a tenth of the windows, then
    128-bit Rabin-Karp hashes of just those windows whose anchor stands at two places. The texts are shuffled once.
    """
    blocks, buckets = text_blocks(docs, id_col, text_col, block_bytes, carry)

    def first(table: pa.Table) -> pa.Table:
        found, many = exchange.distinct(Windows(table["text"].to_pylist(), window).anchors()[1][:, None])
        return exchange.sent(table["block"][0].as_py(), found, many, buckets)

    def second(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return exchange.SENT.empty_table()
        w = Windows(table["text"].to_pylist(), window)
        found, many = exchange.distinct(w.keys(w.repeated_anchors(exchange.answered(replies, 1))))
        return exchange.sent(table["block"][0].as_py(), found, many, buckets)

    fields = [("id", table_type(docs, id_col)), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    if with_text:
        fields += [("text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
    if carry:
        fields.append(("carried", table_type(blocks, "carried")))
    schema = pa.schema(fields)

    def last(table: pa.Table, replies: pa.Table) -> pa.Table:
        texts = table["text"].to_pylist()
        w = Windows(texts, window)
        starts = w.repeated_anchors(exchange.answered(replies, 1))
        keys = w.keys(starts)
        found, _ = exchange.distinct(keys)
        bits = exchange.answered(replies, 2)
        gone = w.covered(starts[bits[exchange.places(found, keys)]] if len(keys) else starts)
        rows = []
        for id_, text, out in zip(table["id"].to_pylist(), texts, gone):
            words, n = split_words(text), int(out.sum())
            kept = words if not n else [x for x, o in zip(words, out) if not o]
            row = {"id": id_, "n_words": len(words), "n_removed": n, "kept_sha256": hashlib.sha256(b" ".join(kept)).hexdigest()}
            if with_text:
                rest, row["removed"] = cut(text, out) if n else (text, [])
                row["text"] = None if rest is None else rest.decode()
            rows.append(row)
        if not carry:
            return pa.Table.from_pylist(rows, schema)
        plain = pa.schema(fields[:-1])
        return pa.Table.from_pylist(rows, plain).append_column("carried", table["carried"])

    one = exchange.answers(blocks.groupBy("block").applyInArrow(first, exchange.SENT_DDL), 1, 1)
    together = lambda replies, f, ddl: blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(f, ddl)
    two = exchange.answers(together(one, second, exchange.SENT_DDL), 2, 2)
    id_type = docs.schema[id_col].dataType.simpleString()
    ddl = f"id {id_type}, n_words long, n_removed long, kept_sha256 string" + ", text string, removed array<struct<start:int,end:int>>" * with_text + (f", carried {blocks.schema['carried'].dataType.simpleString()}" if carry else "")
    return together(one.unionByName(two), last, ddl).withColumnRenamed("id", id_col)


def table_type(df: DataFrame, column: str) -> pa.DataType:
    """Arrow's type of a column of df."""
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)
