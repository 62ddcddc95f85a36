"""Quotation linking: messages that quote each other become reply-ordered conversations without quotes."""

from __future__ import annotations

import hashlib
import re
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored
from .substring import table_type

MARK = re.compile(r"(?:>[ \t]?)+")


def runs(text: str | None) -> list[tuple[int, list[str]]]:
    """(level, lines without marks) of consecutive lines of a level; level 0 is unquoted."""
    found = []
    for line in (text or "").split("\n"):
        m = MARK.match(line)
        level = m[0].count(">") if m else 0
        if not found or found[-1][0] != level:
            found.append((level, []))
        found[-1][1].append(line[m.end() :] if m else line)
    return found


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The text without quotes, and the quoted passages: (level, passage), a passage being consecutive lines of a level."""
    found = runs(text)
    return "\n".join(line for level, lines in found if not level for line in lines), [(level, "\n".join(lines)) for level, lines in found if level]


def passage_hash(text: str) -> str | None:
    """Hash of a passage with case and white space evened out; none for a blank one."""
    even = " ".join(text.lower().split())
    return hashlib.md5(even.encode()).hexdigest() if even else None


def pieces(text: str | None) -> list[str]:
    """Distinct hashes of what a reply may quote: the whole unquoted text, each run between quotes, each paragraph and each line."""
    own = [lines for level, lines in runs(text) if not level]
    parts = ["\n".join(line for lines in own for line in lines)]
    for lines in own:
        parts += ["\n".join(lines), *lines]
        parts += ["\n".join(p) for blank, p in groupby(lines, lambda line: not line.strip()) if not blank]
    return sorted({h for h in map(passage_hash, parts) if h})


def _latest(held: DataFrame, quoted: DataFrame) -> DataFrame:
    """Adds found to quoted (c, t, hash, ...): the latest earlier turn of held (c, t, hash) with the same hash, or null."""
    more = [F.lit(None).cast(f.dataType).alias(f.name) for f in quoted.schema if f.name not in ("c", "t", "hash")]
    both = held.select("c", "t", "hash", *more, F.lit(1).alias("last")).unionByName(quoted.withColumn("last", F.lit(0)))
    run = Window.partitionBy("c", "hash").orderBy("t", "last").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("found", F.last(F.expr("if(last = 1, t, null)"), ignorenulls=True).over(run)).where("last = 0").drop("last")


def _holding_all_lines(held: DataFrame, passages: DataFrame) -> DataFrame:
    """(c, t, hash) of the messages of held that have every line of a passage (c, hash, lines).

    Only messages with the passage's rarest line in the conversation are looked at.
    """
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    lines = passages.select("c", F.col("hash").alias("passage"), F.size("lines").alias("n"), F.explode("lines").alias("line"))
    need = lines.select(F.col("c").alias("nc"), "line").distinct()
    having = stored(held.join(need, same("c", "nc") & (F.col("hash") == F.col("line")), "left_semi").select(F.col("c").alias("hc"), F.col("t").alias("ht"), F.col("hash").alias("held")), "lines")
    often = having.groupBy("hc", "held").agg(F.count("*").alias("often"))
    rare = lines.join(often, same("c", "hc") & (F.col("line") == F.col("held"))).groupBy("c", "passage", "n").agg(F.count("*").alias("there"), F.min_by("line", F.struct("often", "line")).alias("rare")).where("there = n")
    near = rare.join(having, same("c", "hc") & (F.col("rare") == F.col("held"))).select(F.col("c").alias("rc"), F.col("passage").alias("rp"), "ht")
    each = near.join(lines, same("rc", "c") & (F.col("rp") == F.col("passage"))).select("c", "passage", "n", "line", F.col("ht").alias("t"))
    held_too = each.join(having, same("c", "hc") & (F.col("t") == F.col("ht")) & (F.col("line") == F.col("held")))
    return held_too.groupBy("c", "passage", "n", "t").agg(F.count("*").alias("there")).where("there = n").select("c", "t", F.col("passage").alias("hash"))


def link_quotes(messages: DataFrame, group_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Link each message to the one that it replies to, and order conversations by replies.

    A line that starts with ">" is a quote of as many levels as it has marks. The normalised hash of each quoted passage is
    looked up among the pieces of earlier messages of the same conversation (the whole unquoted text, runs between quotes,
    paragraphs, lines); the latest with an equal one counts. A passage of several lines without an equal piece is a quote of
    the latest earlier message that has each of its nonblank lines as a piece. Parts of a line are not found. The
    message replies to the find of its shallowest level that has one, the latest among several. Returns conv_id, turn, role,
    reply_to (a turn or null), thread (turn of the first message of its reply chain), position (from 1, by thread, turn),
    n_quotes (passages), text (without quotes) and formatted (role and text). Null and empty texts quote nothing and are
    not quoted; repeated messages of one turn get equal links; a null conversation is one of its own. Other columns are
    ignored; no rows in, no rows out.

    Hashes are matched by a running window over distinct pieces and quotes of one conversation and hash, so no pairs arise;
    passages without an equal piece meet only the messages that have their rarest line.
    """
    kind, order = table_type(messages, group_col), messages.schema[order_col].dataType.simpleString()
    schema = pa.schema([("c", kind), ("t", table_type(messages, order_col)), ("r", pa.string()), ("text", pa.string()), ("own", pa.list_(pa.string())), ("quotes", pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.string()), ("lines", pa.list_(pa.string()))])))])

    def read(batches):
        for batch in batches:
            texts = batch.column(3).to_pylist()
            parsed = [parse(t) for t in texts]
            quotes = [[{"level": level, "hash": passage_hash(p), "lines": sorted({h for h in map(passage_hash, p.split("\n")) if h})} for level, p in found] for _, found in parsed]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([o for o, _ in parsed], pa.string()), pa.array([pieces(t) for t in texts], schema.field("own").type), pa.array(quotes, schema.field("quotes").type)], schema=schema)

    rows = messages.select(F.col(group_col).alias("c"), F.col(order_col).alias("t"), F.col(role_col).cast("string").alias("r"), F.col(text_col).alias("x"))
    ddl = f"c {messages.schema[group_col].dataType.simpleString()}, t {order}, r string, text string, own array<string>, quotes array<struct<level:int,hash:string,lines:array<string>>>"
    parsed = stored(rows.mapInArrow(read, ddl), "messages")
    held = parsed.select("c", "t", F.explode("own").alias("hash")).distinct()
    quoted = parsed.select("c", "t", F.explode("quotes").alias("q")).where("q.hash is not null").select("c", "t", "q.hash", "q.level", "q.lines").distinct()
    first = stored(_latest(held, quoted), "quotes")
    found = first.select("c", "t", "level", "found")
    missed = first.where("found is null and (size(lines) > 1 or lines[0] <> hash)").drop("found").withColumn("hash", F.md5(F.array_join("lines", "")))
    if not missed.isEmpty():
        found = found.unionByName(_latest(_holding_all_lines(held, missed.select("c", "hash", "lines").distinct()), missed).select("c", "t", "level", "found"))
    found = found.where("found is not null")
    best = found.groupBy("c", "t").agg(F.max_by("found", F.struct(-F.col("level"), F.col("found"))).alias("parent"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))

    # Pointer jumping: each round doubles how far up a message sees. Those that see their chain's first message are done, so
    # that only long chains go on.
    links = stored(parsed.select("c", "t").distinct().join(best.select(F.col("c").alias("bc"), F.col("t").alias("bt"), "parent"), same("c", "bc") & same("t", "bt"), "left").select("c", "t", "parent", F.coalesce("parent", "t").alias("up")), "replies")
    done, active = links.where("parent is null"), links.where("parent is not null")
    while not active.isEmpty():
        seen = done.unionByName(active).select(F.col("c").alias("pc"), F.col("t").alias("pt"), F.col("up").alias("further"))
        step = stored(active.join(seen, same("c", "pc") & same("up", "pt")).select("c", "t", "parent", F.col("further").alias("up"), same("further", "up").alias("settled")), "replies")
        done, active = done.unionByName(step.where("settled").drop("settled")), step.where("not settled").drop("settled")
    links = done.select(F.col("c").alias("lc"), F.col("t").alias("lt"), F.col("parent").alias("reply_to"), F.col("up").alias("thread"))
    out = parsed.join(links, same("c", "lc") & same("t", "lt"))
    place = Window.partitionBy("c").orderBy("thread", "t", "r", "text")
    return out.select(
        F.col("c").alias(group_col), F.col("t").alias(order_col), F.col("r").alias(role_col), "reply_to", "thread", F.row_number().over(place).cast("long").alias("position"), F.size("quotes").cast("long").alias("n_quotes"), "text",
        F.concat(F.lit("<|"), F.coalesce("r", F.lit("unknown")), F.lit("|>\n"), "text", F.lit("\n")).alias("formatted"),
    )


def with_quotes(conversations: DataFrame) -> DataFrame:
    """Plain conversations (conv_id, turn, role, text) as messages that quote, in four ways by the turn's number: the turn before
    at level 1 and the one before that at level 2, as mail programs do; the same with only the last line of the turn
    before, or with all its lines but the first; or the turn before in two parts, its first line above the text and the
    others below. Turns of one line are quoted whole, null and empty ones not at all."""
    turn = Window.partitionBy("conv_id").orderBy("turn")
    before = F.lag("text").over(turn)
    mark = lambda text, marks: F.when(text != "", F.concat(F.lit(marks), F.regexp_replace(text, "\n", "\n" + marks)))
    first, last = F.substring_index("_before", "\n", 1), F.substring_index("_before", "\n", -1)
    rest = F.expr("if(locate('\n', _before) > 0, substring(_before, locate('\n', _before) + 1), _before)")
    solid = lambda text: F.regexp_replace(text, r"\s+", "") != ""
    kind = F.col("turn") % 4
    # A part that is blank could not be found again, and a turn without two before it has no second quote to give up.
    split = (kind == 3) & (F.col("_two") != "") & (F.locate("\n", F.col("_before")) > 0) & solid(first) & solid(rest)
    part = F.when((kind == 1) & solid(last), last).when((kind == 2) & solid(rest), rest).otherwise(F.col("_before"))
    own = F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", "turn", "role", "text", before.alias("_before"), F.lag("text", 2).over(turn).alias("_two"))
    plain, parted = F.concat_ws("\n", mark(F.col("_two"), "> > "), mark(part, "> "), own), F.concat_ws("\n", mark(first, "> "), own, mark(rest, "> "))
    return rows.select("conv_id", "turn", "role", F.when(split, parted).otherwise(plain).alias("text"))
