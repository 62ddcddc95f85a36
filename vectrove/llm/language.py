"""Language identification by interpolated Kneser-Ney models of characters, one a language, in sorted hash arrays.

A text is its words: runs of letters with their marks, in lower case. A model predicts each letter of a word, and the word's
end, from the letters before it in the word, at most ORDER - 1 of them, the start being one. Grams are counted over all rows
that may be learned from; counts of the longest grams, and of those at a word's start, are of occurrences, those of others
are of the different letters before them. Logarithms of probabilities and of the contexts' back-off weights lie in arrays
sorted by hash. The language of the lowest cross-entropy per letter wins; how sure that is comes from rows that are kept out of
the counts, by isotonic regression on the lead over the next language.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import isotonic
from .storage import stored
from .substring import table_type
from .words import in_use, mixed, small

#: Letters of the longest gram; letters of texts that a task holds at least before it passes its counts on; most languages.
ORDER, HELD, LANGUAGES = 5, 8_000_000, 1000
#: Pieces of texts and their letters that a worker keeps; parts of the learnable rows, one of which is for calibration; bins of leads.
KEPT, LETTERS, FOLDS, BINS = 400_000, 8_000_000, 10, 400
START, END = "\x02", "\x03"
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)

LEARN = "crc32(cast(cast(id as string) as binary)) % 4 <> 2"


def letters(text: str | None) -> list[str]:
    """The words of a text in lower case; lower-casing may turn a letter into a letter and a mark."""
    return _WORD.findall(text.lower()) if text else []


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash codes of all characters of some strings one after the other, and the lengths of the strings."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return mixed(points.astype(U) + U(1)), np.fromiter(map(len, words), np.int64, len(words))


def _hashes(codes: np.ndarray) -> list[np.ndarray]:
    """For 1 to ORDER characters, the hash of the gram that ends at each place, without regard to where words begin."""
    out, total = [], np.zeros(len(codes), U)
    for k in range(1, ORDER + 1):
        total[k - 1 :] += codes[: max(0, len(codes) - k + 1)] * _BASE ** U(k - 1)
        out.append(mixed(total + U(k)))
    return out


def _grams(words: dict[str, int]) -> tuple[list[str], np.ndarray]:
    """The grams of these words, and how often each occurs: of every prediction, with as many letters before it as there are, at most ORDER in all."""
    padded = [START + w + END for w in words]
    codes, size = _points(padded)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
    at = np.flatnonzero(place > 0)
    long = np.minimum(place[at] + 1, ORDER)
    which, names = pd.factorize(np.stack(_hashes(codes))[long - 1, at])
    first = np.empty(len(names), np.int64)
    first[which[::-1]] = at[::-1]
    times = np.bincount(which, np.repeat(np.fromiter(words.values(), np.float64, len(words)), size)[at], len(names))
    text, long = "".join(padded), np.minimum(place[first] + 1, ORDER)
    return [text[i + 1 - k : i + 1] for i, k in zip(first.tolist(), long.tolist())], times.astype(np.int64)


def counted(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) of (lang, text). A task counts pieces between white space, and takes their words apart now and then."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])

    def told(by):
        for lang, pieces in by.items():
            words: Counter = Counter()
            for piece, n in pieces.items():
                for w in _WORD.findall(piece):
                    words[w] += n
            if words:
                grams, n = _grams(words)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(n)], schema=schema)

    def count(batches):
        by: dict = {}
        size = 0
        for batch in small(batches, 500):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pieces = text.lower().split()
                size += len(text)
                by.setdefault(lang, Counter()).update(pieces)
            if size >= HELD and sum(map(len, by.values())) >= KEPT // 2 or size >= 10 * HELD:
                yield from told(by)
                by, size = {}, 0
        yield from told(by)

    return rows.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def probabilities(grams: DataFrame) -> DataFrame:
    """(lang, gram, times, p, weight) of every gram and back-off context of all orders.

    p is the interpolated Kneser-Ney probability of the gram's last letter after the others, null for contexts that are no
    grams; weight is what a context leaves to its back-off. A gram at a word's start has no letter before it, so it keeps its
    count. Discounts are n1 / (n1 + 2 n2) per language and order.
    """
    events = grams.withColumn("k", F.char_length("gram"))
    orders = {ORDER: events.where(f"k = {ORDER}").select("lang", "gram", "n")}
    for k in range(ORDER - 1, 0, -1):
        after = stored(orders[k + 1], "grams")
        orders[k + 1] = after
        others = after.groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"))
        orders[k] = others.unionByName(events.where(f"k = {k}").select("lang", "gram", "n"))
    orders[1] = stored(orders[1], "grams")
    out, below = [], None
    for k in range(1, ORDER + 1):
        rows = orders[k].withColumn("context", F.expr(f"substring(gram, 1, {k - 1})"))
        few = rows.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).select("lang", F.expr("if(n1 > 0, n1 / (n1 + 2 * n2), 0.5D)").alias("d"))
        each = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).join(F.broadcast(few), "lang")  # at most LANGUAGES rows
        each = each.select("lang", "context", "total", "d", (F.col("d") * F.col("kinds") / F.col("total")).alias("weight"), "kinds")
        rows = rows.join(each, ["lang", "context"])
        if k == 1:  # the rest goes to all letters alike, and one unknown
            rows = rows.withColumn("p", F.expr("(n - d) / total + weight / (kinds + 1)"))
            out.append(each.select("lang", F.col("context").alias("gram"), F.col("total").alias("times"), F.expr("weight / (kinds + 1)").alias("p"), F.lit(0.0).alias("weight")))
        else:
            shorter = below.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q"))
            rows = rows.withColumn("suffix", F.expr("substring(gram, 2)")).join(shorter, ["lang", "suffix"]).withColumn("p", F.expr("(n - d) / total + weight * q"))
            out.append(each.select("lang", F.col("context").alias("gram"), F.col("total").alias("times"), F.lit(None).cast("double").alias("p"), "weight"))
        below = stored(rows.select("lang", "gram", "n", "p"), "probabilities")
        out.append(below.select("lang", "gram", F.col("n").alias("times"), "p", F.lit(None).cast("double").alias("weight")))
    return reduce(DataFrame.unionByName, out)


def keys(grams: list[str]) -> np.ndarray:
    """The hash of each gram of at most ORDER characters."""
    codes, size = _points(grams)
    ends, total = np.cumsum(size), np.zeros(len(grams), U)
    for k in range(1, ORDER + 1):
        has = size >= k
        total[has] += codes[ends[has] - k] * _BASE ** U(k - 1)
    return mixed(total + size.astype(U))


class Model:
    """Sorted hash arrays of each language: its grams with log2 of their probabilities, its contexts with log2 of their weights."""

    def __init__(self, langs: list[str], rows: pa.Table):
        lang, key = rows["lang"].to_numpy(), rows["key"].to_numpy().view(U)
        p, weight = rows["p"].to_numpy(), rows["weight"].to_numpy()
        self.langs, self.tables = langs, []
        empty = keys([""])[0]
        for i in range(len(langs)):
            pair = []
            for value in (p, weight):
                at = np.flatnonzero((lang == i) & ~np.isnan(value) & (value > 0))
                at = at[np.argsort(key[at], kind="stable")]
                pair += [key[at], np.log2(value[at]).astype(np.float32)]
            unknown = pair[1][np.searchsorted(pair[0], empty)]
            self.tables.append((*pair, float(unknown)))
        self.clear()

    def __getstate__(self):
        return self.langs, self.tables

    def __setstate__(self, state):
        self.langs, self.tables = state
        self.clear()

    def clear(self) -> None:
        """Forget the words met; results never depend on them."""
        self.at: dict[str, int] = {}
        self.bits, self.size = np.empty((1 << 12, len(self.langs)), np.float32), np.empty(1 << 12)
        self.used = self.length = 0

    @staticmethod
    def _found(keys_: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys_):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.float32)
        at = np.minimum(np.searchsorted(keys_, wanted), len(keys_) - 1)
        return keys_[at] == wanted, values[at]

    def cost(self, words: list[str]) -> np.ndarray:
        """Bits that each language takes for each word. A gram that occurs many times in the words is looked up once."""
        if not words:
            return np.empty((0, len(self.langs)))
        codes, size = _points([START + w + END for w in words])
        begun = np.cumsum(size) - size
        place = np.arange(len(codes)) - np.repeat(begun, size)
        predicted = place > 0
        asked = []  # per length: places, the gram that ends at each, and the different grams in order
        for k, hashes in enumerate(_hashes(codes), 1):
            at = np.flatnonzero(place >= k - 1)
            which, names = pd.factorize(hashes[at])
            order = np.argsort(names)
            back = np.empty_like(order)
            back[order] = np.arange(len(order))
            asked.append((at, back[which], names[order]))
        out = np.empty((len(words), len(self.langs)))
        for i, (key, logp, context, weight, unknown) in enumerate(self.tables):
            bits, left = np.full(len(codes), np.float32(unknown)), None
            for k, (at, which, names) in enumerate(asked, 1):
                if k > 1:  # what the context of one letter less leaves to the shorter gram
                    bits[at] += left[at - 1]
                hit, value = self._found(key, logp, names)
                hit, value = hit[which], value[which]
                bits[at[hit]] = value[hit]
                known, value = self._found(context, weight, names)
                left = np.zeros(len(codes), np.float32)
                left[at] = np.where(known, value, np.float32(0))[which]
            out[:, i] = -np.add.reduceat(np.where(predicted, bits, 0).astype(np.float64), begun)
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per letter of each text in each language, and the number of letters with words' ends; texts without words have zeros."""
        in_use(self)
        found = [t.lower().split() if t else [] for t in texts]  # pieces between white space, which hold the words
        of = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        met = pa.array([w for f in found for w in f], pa.large_string()).dictionary_encode()
        names = met.dictionary.to_pylist()
        new = [w for w in names if w not in self.at]
        if self.used + len(new) > KEPT or self.length + sum(map(len, new)) > LETTERS:
            self.clear()
            new = names
        self._learn(new)
        where = np.fromiter(map(self.at.__getitem__, names), np.int64, len(names))
        which = where[met.indices.to_numpy()]
        many = np.bincount(of, self.size[which], len(texts))
        bits = np.stack([np.bincount(of, self.bits[which, i], len(texts)) for i in range(len(self.langs))], axis=1)
        return bits / np.maximum(many, 1)[:, None], many

    def _learn(self, pieces: list[str]) -> None:
        """Keep the bits of new pieces: those of their words."""
        for i in range(0, len(pieces), 50_000):
            some = pieces[i : i + 50_000]
            words = list(map(_WORD.findall, some))
            names = list(dict.fromkeys(w for f in words for w in f))
            place = dict(zip(names, range(len(names))))
            which = np.fromiter((place[w] for f in words for w in f), np.int64)
            of = np.repeat(np.arange(len(some)), [len(f) for f in words])
            cost = self.cost(names)[which]
            while self.used + len(some) > len(self.bits):
                self.bits, self.size = np.concatenate([self.bits, np.empty_like(self.bits)]), np.concatenate([self.size, np.empty_like(self.size)])
            mine = slice(self.used, self.used + len(some))
            for k in range(len(self.langs)):
                self.bits[mine, k] = np.bincount(of, cost[:, k], len(some))
            self.size[mine] = np.bincount(of, np.fromiter(map(len, names), np.int64, len(names))[which] + 1, len(some))
            self.at.update(zip(some, range(self.used, self.used + len(some))))
            self.used += len(some)
            self.length += sum(map(len, some))


class Judge:
    """A model with the score of each lead, and the least score that is not rejected."""

    def __init__(self, model: Model | None, points: np.ndarray, values: np.ndarray, least: float):
        self.model, self.points, self.values, self.least = model, points, values, least

    def lead(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: the language of the lowest cross-entropy, its lead in [0, 1], and whether there is a letter."""
        entropy, many = self.model.entropies(texts)
        best = entropy.argmin(axis=1)
        if entropy.shape[1] == 1:
            return best, np.ones(len(best)), many > 0
        low = np.partition(entropy, 1, axis=1)
        z = (low[:, 1] - low[:, 0]) * np.sqrt(many)
        return best, z / (1 + z), many > 0

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected, of each text."""
        if self.model is None:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        best, lead, has = self.lead(texts)
        score = np.where(has, np.interp(lead, self.points, self.values) if len(self.points) else lead, 0.0)
        return [self.model.langs[b] if h else "und" for b, h in zip(best.tolist(), has.tolist())], score, ~has | (score < self.least)


def train(learnable: DataFrame, most_grams: int | None = None) -> Model | None:
    """The model of (lang, text) rows. Counts are of all rows, and the arrays hold all grams and contexts, unless most_grams is given: then at most
    about so many in all, per language those of the highest counts, by powers of two; the others' letters cost what their back-off gives."""
    rows = stored(probabilities(stored(counted(learnable), "counted")), "model")
    level = F.expr("if(gram = '', 99, cast(floor(log2(times)) as int))")
    sizes = rows.groupBy("lang", level.alias("level")).count().collect()  # at most 100 rows a language
    langs = sorted({r.lang for r in sizes})
    if not langs:
        return None
    if len(langs) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    least = {}
    for lang in langs:
        held, least[lang] = 0, 99
        for r in sorted((r for r in sizes if r.lang == lang), key=lambda r: -r.level):
            held += r["count"]
            if most_grams is not None and held > most_grams / len(langs) and r.level < 99:
                break
            least[lang] = r.level
    bounds = rows.sparkSession.createDataFrame([(x, i, least[x]) for i, x in enumerate(langs)], "lang string, number int, least int")
    kept = rows.withColumn("level", level).join(F.broadcast(bounds), "lang").where("level >= least").select("number", "gram", "p", "weight")

    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys(batch.column(1).to_pylist()).view(np.int64)), batch.column(2), batch.column(3)], names=["lang", "key", "p", "weight"])

    return Model(langs, kept.mapInArrow(hashed, "lang int, key long, p double, weight double").toArrow())


def calibrated(model: Model, rows: DataFrame, error: float) -> Judge:
    """A judge whose scores are shares of right predictions on (lang, text) rows, and that rejects so that of the rest at most `error` are wrong."""
    judge = rows.sparkSession.sparkContext.broadcast(Judge(model, np.empty(0), np.empty(0), 0.0))

    def tally(batches):
        n, right = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
        for batch in small(batches, 500):
            best, lead, has = judge.value.lead(batch.column(1).to_pylist())
            true = np.array([model_langs[b] == x for b, x in zip(best.tolist(), batch.column(0).to_pylist())], bool)
            place = np.minimum((lead * BINS).astype(int), BINS - 1)
            n += np.bincount(place[has], minlength=BINS)
            right += np.bincount(place[has & true], minlength=BINS)
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(n[full]), pa.array(right[full])], names=["bin", "n", "up"])

    model_langs = model.langs
    found = sorted(rows.mapInArrow(tally, "bin int, n long, up long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("up").alias("up")).collect())
    judge.unpersist()
    if not found:
        return Judge(model, np.empty(0), np.empty(0), 0.0)
    at, n, up = (np.array(c, float) for c in zip(*found))
    values = isotonic((up + 0.5) / (n + 1), n)
    wrong = np.cumsum((n - up)[::-1])[::-1] / np.cumsum(n[::-1])[::-1]  # of the rows from this bin on
    fine = np.flatnonzero(wrong <= error)
    return Judge(model, (at + 0.5) / BINS, values, float(values[fine[0]]) if len(fine) else 1.1)


def predict_language(docs: DataFrame, learn: str = LEARN, error: float = 0.01, most_grams: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The language of every whole text.

    Returns the id, held_out (not among the rows that `learn`, a condition on `id`, allows for learning), lang_pred (the
    learned language of the lowest cross-entropy per letter; `und` for null texts and texts without a letter), score (0 to 1:
    the share of right ones among kept-out rows with such a lead over the next language; 0 for `und`) and rejected (`und`, or a
    score below the one from which at most `error` of the kept-out rows are wrong).

    Models are of all rows that `learn` allows whose lang and text are not null, but for a tenth, by a hash of the id, on
    which scores are calibrated; all their grams count, whatever the input's size (most_grams limits them only if given). Equal cross-entropies go to the first language by name. A language without a letter in its
    texts is not learned; if none is, all are `und`. Only the text enters a prediction. A null id is held out; repeated rows
    count each and get equal predictions; other columns are ignored; no rows in, no rows out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    learnable = rows.where(learn).where("lang is not null and text is not null").withColumn("out", F.expr(f"pmod(xxhash64(id, 'calibration'), {FOLDS}) = 0"))
    model = train(learnable.where("not out").select("lang", "text"), most_grams)
    judge = calibrated(model, learnable.where("out").select("lang", "text"), error) if model else Judge(None, np.empty(0), np.empty(0), 0.0)
    judge = docs.sparkSession.sparkContext.broadcast(judge)
    schema = pa.schema([("id", table_type(docs, id_col)), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def predict(batches):
        for batch in small(batches, 500):
            lang, score, rejected = judge.value(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], schema=schema)

    out = rows.select("id", "text").mapInArrow(predict, f"id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
    return out.select(F.col("id").alias(id_col), F.expr(f"not coalesce({learn}, false)").alias("held_out"), "lang_pred", "score", "rejected")
