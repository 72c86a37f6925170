"""Phrases that occur far more often than their parts explain, from sorted streams of counts.

Counting goes by length.  Words come first, as strings, per language; those that occur MIN_COUNT
times get numbers in the order of (language, word).  A phrase can be that frequent only if its
first part and its last part (each one word shorter) are, so each further pass over the texts
counts only phrases whose two parts are both known to be frequent.  Nothing that could qualify is
left out, and counts of what is kept are complete.  Kept phrases are sorted arrays of numbers
in the shared folder, which the next pass maps: the place of a phrase in its array is its own
number, and a longer phrase is the number of its first part followed by a word.

The kept counts of all lengths then form one stream, sorted twice: by the words from the first
on (prefix order) and by the words from the last on (suffix order).  In prefix order a phrase
follows all its first parts, and in suffix order all its last parts, so one lockstep scan of
each order reads off the counts of every left part, every right part and the largest
extension to either side, with no lookup.  The order is cut into ranges of equal size, whatever
words they begin with; a range hands the next one the three parts that are still open.

A longer candidate that holds a phrase somewhere inside has, one word beyond the phrase, a part
that occurs at least as often and is a candidate too; so the largest extension by one word
decides whether a phrase is dropped.

Words are told apart exactly when they are counted and by 64 bits of hash where later passes
look up their numbers.  Null and empty texts have no words; a null language is `und`.  A text
counts as often as its row is repeated.  Equal scores go by count, then by phrase.  An empty
table gives an empty result.  Columns other than text and language are not read.
"""

from __future__ import annotations

import hashlib
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import PART, RANGE_ROWS, in_ranges, numbers, one_table, running
from .shared import load_array, new_folder, save_array, settled
from .words import LOWER, hashed_words, mixed, sliced

MIN_COUNT = 30
LENGTH = 4
TOP = 2000
BLOCK = 1 << 20
FLUSH = 4 << 20
SLICE = 4 << 20
BREAKS = ".,;:!?\n\x0b\x0c\r"
TABLE = LOWER.copy()
TABLE[[ord(c) for c in BREAKS]] = 10
_U64 = np.uint64
_W = [f"w{i}" for i in range(1, LENGTH + 1)]
_PARTS = [f"part{k}" for k in range(1, LENGTH)]


# sorted arrays --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Sorted:
    """Distinct longs in ascending order, in files of `block`; each has a number."""

    folder: str
    first: tuple[int, ...]  # of each file
    size: int
    block: int

    def find(self, values: np.ndarray) -> np.ndarray:
        """The numbers of values, 0 for those that are not there."""
        out = np.zeros(len(values), np.int64)
        block = np.searchsorted(np.array(self.first, np.int64), values, "right") - 1
        for b in np.unique(block[block >= 0]):
            mine = np.flatnonzero(block == b) if len(self.first) > 1 else np.arange(len(values))
            have = load_array(self.folder, f"values-{b}", np.int64)
            at = np.clip(np.searchsorted(have, values[mine]), 0, len(have) - 1)
            hit = have[at] == values[mine]
            out[mine[hit]] = load_array(self.folder, f"numbers-{b}", np.int64)[at[hit]]
        return out

    def value(self, number: np.ndarray) -> np.ndarray:
        """Values by number, where numbers are places from 1 on."""
        out, block = np.empty(len(number), np.int64), (number - 1) // self.block
        for b in np.unique(block):
            mine = block == b
            out[mine] = load_array(self.folder, f"values-{b}", np.int64)[number[mine] - 1 - b * self.block]
        return out


def _sorted(df: DataFrame, name: str, rows: int, size: int) -> Sorted:
    """Store df (value, number) as sorted arrays; a null number is the value's place from 1 on."""
    folder = new_folder(df.sparkSession, name)

    def save(group: pa.Table) -> pa.Table:
        values, place = numbers(group, "value"), numbers(group, "place")
        order = np.argsort(place)
        values, block = values[order], int(group["block"][0].as_py())
        if (values[1:] == values[:-1]).any():
            raise ValueError("two words share a hash")
        save_array(folder, f"values-{block}", values)
        save_array(folder, f"numbers-{block}", group["number"].to_numpy()[order])
        return pa.table({"block": pa.array([block]), "first": values[:1], "size": pa.array([len(values)])})

    placed = running(df.withColumn("all", F.lit(0).cast("long")), "all", ["value"], ["place"], _ones, rows)
    placed = placed.select(F.floor((F.col("place") - 1) / size).cast("long").alias("block"), "value", "place", F.coalesce("number", "place").alias("number"))
    blocks = sorted(tuple(r) for r in placed.groupBy("block").applyInArrow(save, "block long, first long, size long").collect())
    return Sorted(folder, tuple(b[1] for b in blocks), sum(b[2] for b in blocks), size)


def _ones(table: pa.Table) -> list[np.ndarray]:
    return [np.ones(table.num_rows, _U64)]


# counting -------------------------------------------------------------------------------------


def _counted_words(docs: DataFrame, min_count: int) -> DataFrame:
    """(lang, word, n) of frequent words, and per language one row without word for the rest."""
    lowered = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    words = docs.select("lang", F.explode(F.split(lowered, r"[\x20\x09-\x0D.,;:!?]+")).alias("word")).where("word <> ''")
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    kept = F.when(F.col("n") >= min_count, F.col("word"))
    return settled(counts.groupBy("lang", kept.alias("word")).agg(F.sum("n").alias("n")), "words")


def _lang_key(lang: str | None) -> int:
    return int.from_bytes(hashlib.blake2b((lang or "").encode(), digest_size=8).digest(), "little")


def _keys(words, langs: pa.Array) -> np.ndarray:
    """One long per word, by its letters and its text's language."""
    coded = langs.dictionary_encode() if not isinstance(langs, pa.DictionaryArray) else langs
    of_lang = np.array([_lang_key(x) for x in coded.dictionary.to_pylist()] or [0], _U64)
    each = of_lang[coded.indices.to_numpy(zero_copy_only=False)]
    return mixed(words.hashes ^ np.repeat(each, words.counts())).view(np.int64)


def _vocabulary(vocab: DataFrame, rows: int, size: int) -> Sorted:
    def keyed(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_keys(hashed_words(batch["word"]), batch["lang"])), batch["id"]], names=["value", "number"])

    return _sorted(settled(vocab.select("lang", "word", "id").mapInArrow(keyed, "value long, number long"), "word-keys"), "vocabulary", rows, size)


def _known(batch: pa.RecordBatch, vocabulary: Sorted, kept: list[Sorted], base: int) -> tuple[np.ndarray, np.ndarray]:
    """Where two phrases of the last kept length (two words, if none is) overlap but for a word: the first one's number, the last word's."""
    words = hashed_words(batch.column(0), table=TABLE)
    if len(words.hashes) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    values, at = np.unique(_keys(words, batch.column(1)), return_inverse=True)
    ids = vocabulary.find(values)[at]
    breaks = np.cumsum(words.data == 10, dtype=np.int32)
    text = words.text_of_word()
    joined = (text[1:] == text[:-1]) & (breaks[words.starts[1:] - 1] == breaks[words.ends[:-1] - 1])
    number = ids  # of the phrase that begins at each word, 0 where none is kept
    found = np.flatnonzero(joined & (ids[1:] > 0) & (ids[:-1] > 0))
    for width, grams in enumerate(kept, 2):
        values = number[found] * base + ids[found + width - 1]
        number = np.zeros(len(ids), np.int64)
        number[found] = grams.find(values)
        found = np.flatnonzero((number[1:] > 0) & (number[:-1] > 0))
    return number[found], ids[found + len(kept) + 1]


def _counted(docs: DataFrame, vocabulary: Sorted, kept: list[Sorted], base: int, min_count: int) -> DataFrame:
    """(value, n) of frequent phrases one word longer than the last kept ones."""

    def partials(batches):
        held: list[np.ndarray] = []

        def out():
            values, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(values), pa.array(n.astype(np.int64))], names=["value", "n"])

        for batch in sliced(batches, SLICE):
            first, word = _known(batch, vocabulary, kept, base)
            held.append(first * base + word)
            if sum(map(len, held)) >= FLUSH:
                yield out()
        if held:
            yield out()

    rows = docs.select("text", "lang").mapInArrow(partials, "value long, n long")
    return settled(rows.groupBy("value").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count), "phrases")


def _spelled(counts: DataFrame, kept: list[Sorted], base: int) -> DataFrame:
    """Counts with the phrases' words, 0 beyond their end."""
    length = len(kept) + 2

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                value, words = numbers(batch, "value"), []
                for grams in reversed(kept):
                    words.append(value % base)
                    value = grams.value(value // base)
                words += [value % base, value // base]
                words = words[::-1] + [np.zeros(len(value), np.int64)] * (LENGTH - length)
                yield pa.RecordBatch.from_arrays([*map(pa.array, words), batch["n"]], names=[*_W, "n"])

    return counts.mapInArrow(run, ", ".join(f"{w} long" for w in _W) + ", n long")


# streams --------------------------------------------------------------------------------------


def _lockstep(stream: DataFrame, rows: int) -> DataFrame:
    """Each phrase (w1.., n) with the counts of its first parts (part1..) and of its largest extension by a word at the end.

    The stream must hold every first part of what it holds.
    """
    schema = T.StructType(
        [*stream.schema.fields, *(T.StructField(c, T.LongType()) for c in (*_PARTS, "extension", "length")), T.StructField("open", T.BooleanType()), T.StructField(PART, T.IntegerType())]
    )

    def scan(batches):
        table = one_table(batches)
        if table is None:
            return
        n, at = numbers(table, "n"), np.arange(table.num_rows)
        length = sum((numbers(table, w) > 0).astype(np.int64) for w in _W)
        extension, open_, parts = np.zeros(len(n), np.int64), np.zeros(len(n), bool), []
        for k in range(1, LENGTH):
            last = np.maximum.accumulate(np.where(length == k, at, -1))
            parts.append(np.where(length <= k, 0, np.where(last < 0, -1, n[last])))
            longer = np.flatnonzero((length == k + 1) & (last >= 0))
            np.maximum.at(extension, last[longer], n[longer])
            open_[last[-1:][last[-1:] >= 0]] = True
        yield from pa.table(
            [*(table[c] for c in (*_W, "n")), *map(pa.array, (*parts, extension, length, open_)), table[PART]], names=schema.fieldNames()
        ).to_batches()

    done = settled(in_ranges(stream, _W, rows).mapInArrow(scan, schema), "lockstep")
    # of each range: the parts still open at its end, and the largest extension of those open before it
    sums = [F.max(F.when(F.col("open") & (F.col("length") == k), F.col("n"))) for k in range(1, LENGTH)]
    sums += [F.max(F.when((F.col("length") == k + 1) & (F.col(f"part{k}") < 0), F.col("n"))) for k in range(1, LENGTH)]
    edges = sorted(tuple(r) for r in done.groupBy(PART).agg(*sums).collect())
    ranges = max((e[0] for e in edges), default=0) + 1
    before, after = np.zeros((ranges, LENGTH), np.int64), np.zeros((ranges, LENGTH), np.int64)
    for k in range(1, LENGTH):
        n, of = 0, 0
        for part, *values in edges:
            before[part, k] = n
            after[of, k] = max(after[of, k], values[LENGTH - 2 + k] or 0)
            if values[k - 1] is not None:
                n, of = values[k - 1], part
    final = [*_W, "n", *_PARTS, "extension", "length"]

    def handed(batches):
        for batch in batches:
            if batch.num_rows:
                part, length = batch[PART].to_numpy(), numbers(batch, "length")
                open_ = batch["open"].to_numpy(zero_copy_only=False)
                parts = [np.where(x < 0, before[part, k], x) for k, x in enumerate((numbers(batch, c) for c in _PARTS), 1)]
                more = np.where(open_ & (length < LENGTH), after[part, np.minimum(length, LENGTH - 1)], 0)
                extension = np.maximum(numbers(batch, "extension"), more)
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in (*_W, "n")), *map(pa.array, (*parts, extension)), batch["length"]], names=final)

    return done.mapInArrow(handed, ", ".join(f"{c} long" for c in final))


def _turned(df: DataFrame, length: Column, keep: list[str]) -> DataFrame:
    """Words in reverse, 0 beyond the end as before."""
    turned = F.reverse(F.slice(F.array(*_W), F.lit(1), length.cast("int")))
    return df.select(*(F.coalesce(F.get(turned, F.lit(i)), F.lit(0)).cast("long").alias(w) for i, w in enumerate(_W)), *keep)


def score(a: Column, parts: Column) -> Column:
    """floor(2000000 * a / parts), exactly."""
    wide = T.DecimalType(38, 0)
    return F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * a.cast("decimal(19,0)"), parts.cast(wide)).cast("long")


def collocations(
    df: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, top: int | None = TOP, rows: int = RANGE_ROWS,
    block: int = BLOCK,
) -> DataFrame:
    """Per language the `top` best phrases: lang, rank, phrase, a, l, r, n, score."""
    docs = df.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    words = _counted_words(docs, min_count)
    one = settled(words.where("word IS NOT NULL").withColumn("all", F.lit(0).cast("long")), "kept-words")
    vocab = settled(running(one, "all", ["lang", "word"], ["id"], _ones, rows).select("lang", "word", "n", "id"), "vocabulary")
    vocabulary = _vocabulary(vocab, rows, block)
    base, kept = vocabulary.size + 1, []
    none = F.lit(0).cast("long")
    stream = vocab.select(F.col("id").alias("w1"), *(none.alias(w) for w in _W[1:]), "n")
    for length in range(2, LENGTH + 1):
        if max([base, *(g.size + 1 for g in kept)]) * base >= 2**63:
            raise ValueError("too many frequent phrases for 64-bit numbers")
        counts = _counted(docs, vocabulary, kept, base, min_count)
        stream = stream.unionAll(_spelled(counts, kept, base))
        if length < LENGTH:
            kept.append(_sorted(counts.select("value", F.lit(None).cast("long").alias("number")), "phrases", rows, block))
    stream = settled(stream, "stream")

    length = sum((F.when(F.col(w) > 0, 1).otherwise(0) for w in _W), F.lit(0))
    left = _lockstep(stream, rows)
    right = _lockstep(settled(_turned(stream, length, ["n"]), "turned"), rows)
    ends = _turned(right, F.col("length"), [*(F.col(c).alias(f"last_{c}") for c in _PARTS), F.col("extension").alias("to_left")])
    phrases = left.where("length > 1").join(ends.hint("merge"), _W)
    cuts = []
    for k in range(1, LENGTH):
        rest = F.element_at(F.array(*(f"last_{c}" for c in _PARTS)), F.greatest(F.lit(1), F.col("length") - k).cast("int"))
        l, r = F.col(f"part{k}"), rest
        cuts.append(F.when(F.col("length") > k, F.struct(score(F.col("n"), l + r).alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r"))))
    phrases = phrases.where(F.greatest("extension", "to_left") * 5 < F.col("n") * 4)
    phrases = phrases.withColumn("cut", F.array_min(F.array(*cuts))).select(*_W, F.col("n").alias("a"), "cut.l", "cut.r", "cut.score")

    ids = vocab.select(F.col("id").alias("w1"), "lang")
    phrases = phrases.join(ids, "w1")
    if top is not None:  # with all ties, which the phrases themselves break later
        best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
        phrases = phrases.withColumn("rank", F.rank().over(best)).where(F.col("rank") <= top).drop("rank")
    phrases = settled(phrases, "best")
    spelled = phrases.select(*_W, F.posexplode(F.array(*_W)).alias("at", "id")).where("id > 0").join(vocab.select("id", "word"), "id")
    spelled = spelled.groupBy(*_W).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x.word), " ").alias("phrase"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    out = phrases.join(spelled, _W).join(totals, "lang")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = out.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        out = out.where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
