"""Byte-level BPE by DuckDB's recursive queries, and decoding by its ordered aggregation."""

from __future__ import annotations

import base64
import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import Known, slices
from .substring import table_type

#: Bytes of words of one recursive query; ids of one decoded run; a DuckDB connection's memory, beyond which it spills.
QUERY, RUN, MEMORY = 400_000, 1 << 20, "300MB"

#: A row is a token: its spot is its word's number and its first byte's place. Rows carry the token that follows and the
#: rank of the merge with it. A round contracts, in every word that can still merge, the pair of least rank; a word that
#: cannot gives its rows once more as done. {chosen} names the pairs.
ENCODE = """
WITH RECURSIVE state AS (
  SELECT s.spot, s.token, 1 AS size, s.following, m.token AS rank, false AS done FROM start s LEFT JOIN merges m ON m.a = s.token AND m.b = s.following
  UNION ALL
  (WITH best AS (SELECT spot >> 32 AS word, min(rank) AS rank FROM state WHERE NOT done GROUP BY word),
        found AS (SELECT s.spot, s.size, s.rank, s.token = s.following AS twin FROM state s JOIN best b ON b.word = s.spot >> 32 AND b.rank = s.rank),
        {chosen},
        merged AS (SELECT c.spot, c.rank AS token, c.size + g.size AS size, g.following, g.spot AS gone FROM chosen c JOIN state g ON g.spot = c.spot + c.size),
        kept AS (SELECT s.spot, coalesce(m.token, s.token) AS token, coalesce(m.size, s.size) AS size, CASE WHEN m.spot IS NULL THEN s.following ELSE m.following END AS following, s.rank, m.spot IS NOT NULL AS fresh, b.rank IS NULL AS done
                 FROM state s JOIN best b ON b.word = s.spot >> 32 LEFT JOIN merged m ON m.spot = s.spot WHERE NOT s.done AND NOT EXISTS (FROM merged x WHERE x.gone = s.spot)),
        beside AS (SELECT k.spot, k.token, k.size, coalesce(n.token, k.following) AS following, k.rank, k.fresh OR n.spot IS NOT NULL AS fresh, k.done FROM kept k LEFT JOIN merged n ON n.spot = k.spot + k.size)
   SELECT w.spot, w.token, w.size, w.following, CASE WHEN w.fresh THEN m.token ELSE w.rank END, w.done
   FROM beside w LEFT JOIN merges m ON m.a = CASE WHEN w.fresh THEN w.token END AND m.b = w.following)
)
SELECT spot >> 32 AS word, token FROM state WHERE done ORDER BY spot
"""
LEFTMOST = "chosen AS (SELECT min(spot) AS spot, any_value(size) AS size, any_value(rank) AS rank FROM found GROUP BY spot >> 32)"
#: All of a word's pairs of least rank, from the left without overlap: in a run of equal tokens every other one.
EVERY = """run AS (SELECT *, spot - size * row_number() OVER (PARTITION BY spot >> 32 ORDER BY spot) AS run FROM found WHERE twin),
        chosen AS (SELECT spot, size, rank FROM found WHERE NOT twin UNION ALL SELECT spot, size, rank FROM run QUALIFY (spot - min(spot) OVER (PARTITION BY run)) // size % 2 = 0)"""
DECODE = "SELECT row, string_agg(v.hex, '' ORDER BY place) AS bytes FROM ids JOIN vocabulary v USING (token) GROUP BY row ORDER BY row"


class Codec:
    """Encodes matches of the pattern, many at once, and decodes ids. One for each Python worker and rank file."""

    _made: dict = {}

    @classmethod
    def of(cls, ranks_path: str, pattern: str) -> Codec:
        key = (ranks_path, pattern)
        if key not in cls._made:
            cls._made[key] = cls(*key)
        return cls._made[key]

    def __init__(self, ranks_path: str, pattern: str):
        import duckdb
        import regex

        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        merges = [(a, b, r) for t, r in self.ranks.items() for i in range(1, len(t)) if (a := self.ranks.get(t[:i])) is not None and (b := self.ranks.get(t[i:])) is not None]
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": tempfile.mkdtemp(prefix="spark-")})
        a, b, r = (list(x) for x in zip(*merges)) if merges else ([], [], [])
        self._table("merges", a=pa.array(a, pa.int32()), b=pa.array(b, pa.int32()), token=pa.array(r, pa.int32()))
        self._table("vocabulary", token=pa.array(list(self.ranks.values()), pa.int32()), hex=pa.array([t.hex() for t in self.ranks]))
        self.chosen = EVERY
        late = list(dict.fromkeys(r for a, b, r in merges if max(a, b) > r))
        if not self._whole(late):
            self.chosen = LEFTMOST
        self.known = Known(regex.compile(pattern).findall, self._encode_words)

    def _whole(self, tokens: list[int]) -> bool:
        """Whether each of these tokens is what its own bytes encode to.

        They are the tokens that a part of higher rank could still form. If none of them does so, ranks of a word's merges
        never fall: just before a merge of rank r no pair of lower rank is left, and a token of lower rank that the merge
        could then form would have been formed from its bytes before. So the pairs of least rank of a word can be
        contracted in one round, as one by one from the left.
        """
        spelled = {r: t for t, r in self.ranks.items()}
        ids, sizes = self._encode_bytes([spelled[r] for r in tokens])
        return bool((sizes == 1).all())

    def _table(self, table: str, **columns: pa.Array) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {table} AS SELECT * FROM given")
        self.db.unregister("given")

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._encode_bytes([w.encode() for w in words])

    def _encode_bytes(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these words, and the number of ids of each; a query takes words of about QUERY bytes."""
        sizes = np.array([len(b) for b in raw], np.int64)
        group = (np.cumsum(sizes) - 1) // QUERY
        ids, many = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for i, j in zip(*(lambda e: (e[:-1], e[1:]))(np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if len(raw) else [0])):
            size = sizes[i:j]
            joined = np.frombuffer(b"".join(raw[i:j]), np.uint8)
            ends = np.cumsum(size)
            word = np.repeat(np.arange(j - i), size)
            token = self.single[joined]
            following = np.r_[token[1:], np.int32(-1)]
            following[ends - 1] = -1
            self._table("start", spot=pa.array((word << 32) + np.arange(len(joined)) - np.repeat(ends - size, size)), token=pa.array(token), following=pa.array(following))
            found = self.db.sql(ENCODE.format(chosen=self.chosen)).to_arrow_table()
            ids.append(found["token"].to_numpy().astype(np.uint32))
            many.append(np.bincount(found["word"].to_numpy(), minlength=j - i))
        return np.concatenate(ids), np.concatenate(many)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the number for each text."""
        return self.known.ids(texts)

    def decode(self, ids: np.ndarray, many: np.ndarray) -> list[list[bytes]]:
        """For each row of ids (many[i] of them) its bytes, in parts of RUN ids; an id outside the vocabulary adds none."""
        parts = np.maximum(1, -(-many // RUN))
        row = np.repeat(np.arange(len(many)), many)
        place = np.arange(len(ids)) - np.repeat(np.cumsum(many) - many, many)
        part = (np.cumsum(parts) - parts)[row] + place // RUN
        out = [b""] * int(parts.sum())
        edges = np.searchsorted(part, np.arange(len(out) + 1))
        begun = 0
        while begun < len(out):  # some parts a query, so that its rows are bounded
            end = max(begun + 1, int(np.searchsorted(edges, edges[begun] + 2 * RUN, "right")) - 1)
            i, j = edges[begun], edges[end]
            self._table("ids", row=pa.array(part[i:j]), place=pa.array(place[i:j]), token=pa.array(ids[i:j], pa.int64()))
            for p, text in zip(*(c.to_pylist() for c in self.db.sql(DECODE).to_arrow_table().columns)):
                out[p] = bytes.fromhex(text)
            begun = end
        edges = np.cumsum(parts)
        return [out[e - n : e] for n, e in zip(parts.tolist(), edges.tolist())]


def sha256(parts: list[bytes]) -> str:
    digest = hashlib.sha256()
    for p in parts:
        digest.update(p)
    return digest.hexdigest()


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode whole texts by the ranks of a file that every executor can read, then decode the ids.

    Returns the id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256 (the decoded bytes) and, if
    with_ids, `ids` (array of int). Null and empty texts have no ids; the strings of special tokens are ordinary text.
    A text of any length, and a word of any length, takes the same way; a query's rows are bounded by QUERY bytes or one
    word, and DuckDB spills what exceeds MEMORY into the worker's own temporary folder. Rows that repeat, also an id with
    other texts, and null ids give a row each; other columns are ignored, also if they bear the result's names; no rows
    in, no rows out. Map only: nothing is shuffled, and what is kept between texts is bounded.
    """
    fields = [("id", table_type(docs, id_col)), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def encode(batches):
        codec = Codec.of(ranks_path, pattern)
        for batch in batches:
            names, texts = batch.column(0), batch.column(1).to_pylist()
            for i, j in slices(texts):
                ids, many = codec.encode([t or "" for t in texts[i:j]])
                offsets = pa.array(np.r_[0, np.cumsum(many)])
                decimal = pc.binary_join(pa.LargeListArray.from_arrays(offsets, pa.array(ids).cast(pa.large_string())), pa.scalar(" ", pa.large_string()))
                columns = [names.slice(i, j - i), pa.array(many, pa.int64()), pa.array([sha256([x.as_buffer()]) for x in decimal]), pa.array([sha256(parts) for parts in codec.decode(ids, many)])]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(offsets.cast(pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ddl = f"id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(encode, ddl).withColumnRenamed("id", id_col)


def bpe_decode(rows: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes) of arrays of ids; null and empty arrays give no bytes, an id outside the vocabulary adds none.

    Rows that repeat and null ids give a row each; other columns are ignored; no rows in, no rows out.
    """
    kind = table_type(rows, id_col)

    def decode(batches):
        codec = Codec.of(ranks_path, pattern)
        for batch in batches:
            names, ids = batch.column(0), batch.column(1).to_pylist()
            for i in range(0, len(names), 256):
                some = [[x for x in r or () if x is not None] for r in ids[i : i + 256]]
                many = np.array([len(r) for r in some], np.int64)
                flat = np.array([x for r in some for x in r], np.int64)
                yield pa.RecordBatch.from_arrays([names.slice(i, 256).cast(kind), pa.array([b"".join(p) for p in codec.decode(flat, many)], pa.binary())], names=["id", "bytes"])

    ddl = f"id {rows.schema[id_col].dataType.simpleString()}, bytes binary"
    return rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(decode, ddl).withColumnRenamed("id", id_col)
