"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

The global order of n-grams is that of their 64-bit hash codes; a fragment is a range of it. Fragments serve twice.

Candidates: two sets that link differ in at most D n-grams. Cut by more than D fragments, some fragment holds the same,
non-empty part of both. Each distinct set sends one key for each of its non-empty fragments; a set stays a candidate only
if as many of its keys occur elsewhere as a link implies. Of these it keeps the rarest: where a link implies t shared keys,
all but its t - 1 most frequent ones, in one order for all sets; a linked pair still shares one that both keep.

Counting: sets that share a kept key form groups, wide of the links. A group is a component of such sharing; large components,
which chance grows with the input, are cut into overlapping groups where that sends less: for each set, those that share a
key of which it is the least holder. In a group, blocks of sets meet pairwise, once for each coarse fragment; each such task
gives a matrix of partial overlaps of its fragment alone. The partial counts are summed per pair and compared with the
threshold. Links are kept as spanning edges, not as all pairs.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from . import exchange
from .components import components, roots
from .storage import parallelism, stored
from .words import U, codes, mixed, rolling, split_words

BASE = 0xA0761D6478BD642F
#: Documents of a block, and fragments, in the counting of overlaps.
SIDE, FRAGMENTS = 512, 4
#: Bytes of shingles, on average, of the groups of one block that a task counts together.
UNIT_BYTES = 8 << 20


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """Sorted hash codes of the distinct n-word runs of the text, A-Z in lower case; all its words as one if fewer."""
    c = codes(split_words((text or b"").lower()))
    if not len(c):
        return c
    k = min(n, len(c))
    return np.unique(mixed(rolling(c, k, BASE) + U(k * 0x632BE59BD9B4E019 & (1 << 64) - 1)))


class Sizes:
    """Classes of set sizes so that linked sets are of one class or of neighbours, with bounds on their difference."""

    def __init__(self, percent: int):
        self.percent, self.low = percent, [1]

    def of(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(100 * self.low[-1] // self.percent + 1)
        return bisect_right(self.low, n) - 1

    def differ(self, k: int) -> int:
        """Most n-grams in just one of two linked sets, the larger of class k."""
        self.of(self.low[min(k, len(self.low) - 1)])
        while len(self.low) <= k + 1:
            self.low.append(100 * self.low[-1] // self.percent + 1)
        return (100 - self.percent) * 2 * (self.low[k + 1] - 1) // (100 + self.percent)


def part_keys(s: np.ndarray, sizes: Sizes) -> list[tuple[np.ndarray, int]]:
    """For each level: keys of the set's non-empty fragments, and how many of them a link implies elsewhere.

    A set has levels for its own size class and the next larger. Where its non-empty fragments are not more than the
    possible differences, it has a further level with twice the fragments, until they are: a linked pair then agrees in a
    non-empty fragment on the first level that suffices for one of the two, and the other has that level as well.
    """
    out = []
    if not len(s):
        return out
    spread, own = mixed(s + U(0x8EBC6AF09C88C6E3)), sizes.of(len(s))
    for k in (own, own + 1):
        most = sizes.differ(k)
        fragments, level = (6 * (most + 1) + 4) // 5, 0
        while True:
            part = ((s >> U(32)) * U(fragments)) >> U(32)
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            key = np.add.reduceat(spread, first) + mixed(part[first] + U(((k * 64 + level) << 40) + 1))
            enough = len(first) - most
            out.append((mixed(key), max(1, enough)))
            if enough > 0:
                break
            fragments, level = 2 * fragments, level + 1
    return out


class Block:
    """The distinct sets of a block's texts, and their keys."""

    def __init__(self, table: pa.Table, n: int, percent: int):
        sizes, self.rows, self.sets = Sizes(percent), [], {}
        for text_id, text in zip(table["id"].to_pylist(), table["text"].to_pylist()):
            s = shingles(text, n)
            name = xxh3_128_digest(s.tobytes()) if len(s) else None
            self.rows.append((text_id, name, len(s)))
            if name is not None:
                self.sets.setdefault(name, s)
        self.levels = [(name, key, need) for name, s in self.sets.items() for key, need in part_keys(s, sizes)]
        self.keys = np.concatenate([*(key for _, key, _ in self.levels), np.empty(0, U)])

    def candidates(self, counts: np.ndarray) -> dict[bytes, list[np.ndarray]]:
        """Names of the sets that can have a link, with the keys that they keep: all that occur elsewhere but the most frequent ones, one fewer than a link implies."""
        found, _ = exchange.distinct(self.keys[:, None])
        hit, at, out = counts[np.searchsorted(found[:, 0], self.keys)] if len(found) else np.empty(0, np.uint8), 0, {}
        for name, key, need in self.levels:
            here = hit[at : at + len(key)]
            at += len(key)
            elsewhere = int((here > 1).sum())
            if elsewhere >= need:
                rarest = np.lexsort((key, here))[len(key) - elsewhere :]
                out.setdefault(name, []).append(key[rarest[: elsewhere - need + 1]])
        return out


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted sets, each of left with each of right."""
    out = np.zeros((len(left), len(right)), np.float32)
    a, b = np.concatenate([*left, np.empty(0, U)]), np.concatenate([*right, np.empty(0, U)])
    rows_a, rows_b = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    shared = np.intersect1d(a, b)
    in_a, in_b = np.isin(a, shared), np.isin(b, shared)
    a, b, rows_a, rows_b = np.searchsorted(shared, a[in_a]), np.searchsorted(shared, b[in_b]), rows_a[in_a], rows_b[in_b]
    for low in range(0, len(shared), 4096):
        width = min(4096, len(shared) - low)
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        pick = (a >= low) & (a < low + width)
        x[rows_a[pick], a[pick] - low] = 1
        pick = (b >= low) & (b < low + width)
        y[rows_b[pick], b[pick] - low] = 1
        out += x @ y.T
    return out


def meetings(rows: DataFrame) -> DataFrame:
    """(node, grp, blocks) for sets (node, n, keys): any two that share a key are in a common group, which is cut into so many blocks."""
    held = rows.select("node", F.explode("keys").alias("key"))
    low = held.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("many")).where("many > 1").drop("many")
    near = stored(held.join(low, "key").where("node <> low").select("low", "node").distinct(), "near")
    wide = stored(components(near).join(rows.select("node", "n"), "node"), "wide")
    large = wide.groupBy("component").count().where(f"count > {SIDE}").select("component")
    stars = near.unionByName(near.select("low", F.col("low").alias("node")).distinct()).join(wide.join(large, "component"), "node")
    every = wide.select("component", F.lit(False).alias("star"), F.col("component").alias("grp"), "node", "n").unionByName(stars.select("component", F.lit(True).alias("star"), F.expr("-1 - low").alias("grp"), "node", "n"))
    groups = every.groupBy("component", "star", "grp").agg(F.expr(f"cast(ceil(count(*) / {SIDE}) as int)").alias("blocks"), F.sum("n").alias("size"))
    cheaper = groups.groupBy("component", "star").agg(F.sum(F.expr("cast(blocks * size as double)")).alias("sent")).groupBy("component").agg(F.min_by("star", F.struct("sent", "star")).alias("star"))
    return stored(every.join(groups.join(cheaper, ["component", "star"]).select("grp", "blocks"), "grp").select("node", "grp", "blocks"), "meetings")


def linked_sets(sets: DataFrame, percent: int) -> DataFrame:
    """(name, component) of the candidate sets (hash, name, n, shingles, keys) that link with a different set."""
    spark = sets.sparkSession
    rows = sets.select("name", "hash", "n", "keys").dropDuplicates(["name"])
    rows = stored(rows.select(F.monotonically_increasing_id().alias("node"), "name", "hash", "n", "keys"), "candidates")  # stored, so that the numbers stay
    met = meetings(rows)
    size = 8 * (met.join(rows, "node").agg(F.sum("n")).first()[0] or 0)
    placed = sets.select("hash", "shingles").join(rows.select("hash", "node", "n"), "hash").join(met, "node").withColumn("mine", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    pairs = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "node", "n", "shingles", "grp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.expr("mine <= other").alias("in_left"), F.expr("mine >= other").alias("in_right"), F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("fragment")
    )

    def cut(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            parts = [_part(x, f) for x, f in zip(table["shingles"].to_pylist(), table["fragment"].to_pylist())]
            yield from table.set_column(table.schema.get_field_index("shingles"), "shingles", pa.array(parts, pa.binary())).to_batches()

    groups = max(parallelism(spark) * 16, -(-size // UNIT_BYTES))
    units = pairs.mapInArrow(cut, pairs.schema).withColumn("unit", F.expr(f"if(i + j = 0, pmod(xxhash64(grp, fragment), {groups}), xxhash64(grp, i, j, fragment) | {1 << 62})"))

    out = "grp long, i int, j int, left_nodes binary, left_n binary, right_nodes binary, right_n binary, counts binary"

    def count(table: pa.Table) -> pa.Table:
        """Partial overlaps within the fragment, one matrix for each group and pair of blocks in the unit."""
        found: dict = {}
        for node, n, s, grp, i, j, in_left, in_right, fragment in zip(*(table[c].to_pylist() for c in ("node", "n", "shingles", "grp", "i", "j", "in_left", "in_right", "fragment"))):
            left, right = found.setdefault((grp, i, j, fragment), ([], []))
            row = (node, n, np.frombuffer(s, U))
            if in_left:
                left.append(row)
            if in_right:
                right.append(row)
        rows = []
        for (grp, i, j, _), (left, right) in found.items():
            left.sort(key=lambda r: r[0])
            right.sort(key=lambda r: r[0])
            counts = overlaps([r[2] for r in left], [r[2] for r in right]).astype(np.int32)
            names = {f"{side}_{what}": np.array([r[k] for r in side_rows], np.int64).tobytes() for side, side_rows in (("left", left), ("right", right)) for k, what in ((0, "nodes"), (1, "n"))}
            rows.append({"grp": grp, "i": i, "j": j, **names, "counts": counts.tobytes()})
        return pa.Table.from_pylist(rows, pa.schema([("grp", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), *((c, pa.binary()) for c in ("left_nodes", "left_n", "right_nodes", "right_n", "counts"))]))

    partial = units.groupBy("unit").applyInArrow(count, out)

    def total(table: pa.Table) -> pa.Table:
        """Sum the partial overlaps of each pair, and keep spanning edges of the links."""
        found: dict = {}
        for row in table.to_pylist():
            key = (row["grp"], row["i"], row["j"])
            sums = np.frombuffer(row["counts"], np.int32)
            found[key] = (row, found[key][1] + sums if key in found else sums)
        edges = []
        for row, sums in found.values():
            a, na, b, nb = (np.frombuffer(row[c], np.int64) for c in ("left_nodes", "left_n", "right_nodes", "right_n"))
            both = sums.reshape(len(a), len(b)).astype(np.int64)
            x, y = np.nonzero((100 + percent) * both >= percent * (na[:, None] + nb[None, :]))
            names, at = np.unique(np.r_[a, b], return_inverse=True)
            root = roots(len(names), at[x], at[len(a) + y])
            moved = np.flatnonzero(root != np.arange(len(names)))
            edges += zip(names[moved].tolist(), names[root[moved]].tolist())
        return pa.table({"u": pa.array([e[0] for e in edges], pa.int64()), "v": pa.array([e[1] for e in edges], pa.int64())})

    edges = partial.withColumn("unit", F.expr(f"if(i + j = 0, pmod(xxhash64(grp), {groups}), xxhash64(grp, i, j) | {1 << 62})")).groupBy("unit").applyInArrow(total, "u long, v long")
    return components(edges).join(rows.select("node", "name"), "node").select("name", "component")


def _part(shingles_: bytes, fragment: int) -> bytes:
    """The fragment's range of a sorted set."""
    s = np.frombuffer(shingles_, U)
    edges = np.searchsorted(s >> U(32), np.array([fragment, fragment + 1], U) * U((1 << 32) // FRAGMENTS))
    return s[edges[0] : edges[1] if fragment < FRAGMENTS - 1 else len(s)].tobytes()


def ngram_jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """Components of documents whose sets of n-word shingles have a Jaccard similarity of percent / 100 or more.

    Returns a row per document: the id (as `id_col`), n_shingles (size of its set), component_id (least id that links
    reach, its own included). Sets are equal for texts that differ in white space or A-Z case only. Null, empty and blank
    texts have empty sets and link with nothing; texts of fewer than n words have one shingle, all their words. Rows that
    repeat are documents of one set, and link. A null id never is the least unless all of a component's are null. Other
    columns are ignored. No rows in, no rows out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("hash", F.unhex(F.md5("text")))

    def once(batches):
        """The text of each distinct text, the first time that this task meets it."""
        seen: set = set()
        for batch in batches:
            keep = []
            for i, h in enumerate(batch.column(0).to_pylist()):
                if h not in seen:
                    if len(seen) >= 1_000_000:
                        seen.clear()
                    seen.add(h)
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int32()))

    texts = rows.select("hash", F.col("text").cast("binary").alias("text")).mapInArrow(once, "hash binary, text binary")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // block_bytes))
    blocks = texts.select(F.col("hash").alias("id"), "text", F.expr(f"cast(pmod(xxhash64(hash), {count}) as int)").alias("block")).repartition(min(count, max(parallelism(docs.sparkSession), 20_000)), "block")

    def first(table: pa.Table) -> pa.Table:
        found, many = exchange.distinct(Block(table, n, percent).keys[:, None])
        return exchange.sent(table["block"][0].as_py(), found, many, count)

    result = pa.schema([("hash", pa.binary()), ("name", pa.binary()), ("n", pa.int64()), ("shingles", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def second(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return result.empty_table()
        block = Block(table, n, percent)
        found, out, done, texts_seen = block.candidates(exchange.answered(replies, 1, counts=True)), [], set(), set()
        for text_hash, name, size in block.rows:
            if text_hash in texts_seen:
                continue
            texts_seen.add(text_hash)
            row = {"hash": text_hash, "name": name, "n": size, "shingles": None, "keys": None}
            if name in found and name not in done:
                done.add(name)
                row |= {"shingles": block.sets[name].tobytes(), "keys": np.concatenate(found[name]).view(np.int64)}
            out.append(row)
        return pa.Table.from_pylist(out, result)

    replies = exchange.answers(blocks.groupBy("block").applyInArrow(first, exchange.SENT_DDL), 1, 1, counts=True)
    sets = stored(blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(second, "hash binary, name binary, n long, shingles binary, keys array<long>"), "sets")
    found = linked_sets(sets.where("keys is not null"), percent)

    least = rows.groupBy("hash").agg(F.min("id").alias("least_id"))
    key = F.coalesce(F.col("component").cast("string"), F.hex("name")).alias("group_key")  # a number has fewer digits than a name
    group = sets.select("hash", "n", "name").join(least, "hash").join(found, "name", "left").select("hash", "n", "name", "least_id", key)
    group = stored(group, "groups")  # read twice
    lowest = group.where("name is not null").groupBy("group_key").agg(F.min("least_id").alias("component_id"))
    final = group.join(lowest, "group_key", "left").select("hash", F.col("n").alias("n_shingles"), "component_id")
    return rows.select("id", "hash").join(final, "hash").select(F.col("id").alias(id_col), "n_shingles", F.expr("if(n_shingles = 0, id, component_id)").alias("component_id"))
