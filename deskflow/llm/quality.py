"""Quality rules with thresholds that follow each language and source.

One pass over the whole texts measures every document.  A mergeable sketch of each measure is
built per language and source: counts in buckets whose edges grow by GAMMA, so a quantile is
known to within 2%, and the same documents give the same sketch however they are partitioned.
Sketches of one language are merged into that language's, and all of them into one for
everything.  The limits read off them are joined back and filter the documents.

The limit of a sketch is the narrowest of three:

- a fence: its quartiles, moved out by `spread` times their distance.  It holds with up to a
  quarter of junk, and says nothing where both quartiles are 0;
- a jump, for junk among values that are mostly 0: from the median upwards, the first gap between
  neighbouring buckets that is wider than everything from the lower quartile up to it and than
  `counts` occurrences in a document of mean length; the limit is its middle;
- for shares, its tail: the 0.99 quantile plus its distance from the 0.9 quantile, if they differ.

A share without any of them is limited by 1.  A group's limit is its own with weight n / (n + prior),
the rest of the weight goes to its language's, which is blended with the overall one in the same
way; so a limit moves steadily with the size of its group.

Words are runs of bytes other than space and 0x09-0x0D.  Null and empty texts have no words
and fail the base rules.  Null languages and sources are groups like any other.  Repeated
rows are measured one by one.  An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settled
from .words import SPACES, U64, hashed_words, mixed, ngrams, sliced, text_bytes

REPEAT_WINDOW = 8
PRIOR = 50.0
SPREAD = 8.0
COUNTS = 16  # fewer occurrences than that set no document apart
TAIL = (90, 99)
GAMMA = 1.02
_ZERO = -(1 << 30)  # the bucket of zeros
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

# Measure: (expression, whether low values are judged too, what one occurrence adds to it)
MEASURES: dict[str, tuple[str, bool, str]] = {
    "word_length": ("try_divide(word_chars, n_words)", True, "0"),
    "symbol_share": ("try_divide(n_symbols, word_chars)", False, "try_divide(1, word_chars)"),
    "line_share": ("try_divide(n_dup_lines, n_lines)", False, "try_divide(1, n_lines)"),
    "repeat_share": ("try_divide(n_repeat_words, n_words)", False, "try_divide(1, n_words)"),
}

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1, np.int64)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.add.reduceat(flags, offsets[full], dtype=np.int64)
    return out


def _repeated_words(words, window: int) -> np.ndarray:
    """Words of each text in windows that occur twice or more in that text."""
    hashes, at = ngrams(words, window)
    text = np.repeat(np.arange(len(words.first) - 1, dtype=np.uint64), words.counts())
    hashes = mixed(hashes ^ mixed((text[at] + U64(1)) * U64(0x9E3779B97F4A7C15)))
    ordered = np.sort(hashes)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    change = np.zeros(len(words.hashes) + 1, np.int32)
    if len(again):
        place = np.minimum(np.searchsorted(again, hashes), len(again) - 1)
        starts = at[again[place] == hashes]
        change[: len(words.hashes)] += np.bincount(starts, minlength=len(words.hashes)).astype(np.int32)
        change -= np.bincount(starts + window, minlength=len(change)).astype(np.int32)
    return _per_text(np.cumsum(change[:-1]) > 0, words.first)


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with words that repeat an earlier one, and all lines with words."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines)), len(lines)


def measured(df: DataFrame, text: str = "text", keep: tuple[str, ...] = (), lines: bool = False) -> DataFrame:
    """The columns `keep` of df and the counts of each text, with n_lines if `lines`."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    names = (*_COUNTS, "n_lines") if lines else _COUNTS
    schema = ", ".join(filter(None, [kinds, ", ".join(f"{c} long" for c in names)]))

    def measure(batches):
        for batch in sliced(batches, 8 << 20):
            texts = batch.column(batch.num_columns - 1)
            words = hashed_words(texts)
            data, offsets = text_bytes(texts)
            view, at = memoryview(data), offsets.tolist()
            repeated, n_lines = zip(*[_lines(bytes(view[a:b])) for a, b in zip(at, at[1:])])
            counts = (
                words.counts(),
                _per_text(~SPACES[data] & ((data & 0xC0) != 0x80), offsets),
                _per_text(SYMBOLS[data], offsets),
                repeated,
                _repeated_words(words, REPEAT_WINDOW),
                n_lines,
            )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *[pa.array(c, pa.int64()) for c in counts[: len(names)]]], names=[*keep, *names]
            )

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(text)).mapInArrow(measure, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _bucket(value: Column) -> Column:
    return F.when(value == 0, _ZERO).otherwise(F.floor(F.ln(value) / F.ln(F.lit(GAMMA))).cast("int"))


def _edge(bucket: Column, upper: bool = False) -> Column:
    return F.when(bucket == _ZERO, 0.0).otherwise(F.pow(F.lit(GAMMA), bucket + int(upper)))


def sketched(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Sketches of all measures: keys, measure, bucket, n, unit (exact sum of what one occurrence adds)."""
    values = F.array(*[
        F.struct(F.lit(m).alias("measure"), F.expr(e).cast("double").alias("value"), F.expr(u).cast("decimal(18,12)").alias("unit"))
        for m, (e, _, u) in MEASURES.items()
    ])
    each = rows.select(*keys, F.explode(values).alias("v")).select(*keys, "v.*").where("value IS NOT NULL")
    return each.groupBy(*keys, "measure", _bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"), F.sum("unit").alias("unit"))


def sketch_limits(sketches: DataFrame, keys: tuple[str, ...], spread: float = SPREAD, counts: int = COUNTS) -> DataFrame:
    """Keys, measure, n, low, high of sketches merged by keys.  A sketch has some thousand buckets at most."""
    whole = Window.partitionBy(*keys, "measure")
    upwards = whole.orderBy("bucket")
    rows = sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"), F.sum("unit").alias("unit"))
    rows = rows.withColumns({
        "upto": F.sum("n").over(upwards), "total": F.sum("n").over(whole), "before": F.lag("bucket").over(upwards),
        "unit": (F.sum("unit").over(whole) / F.sum("n").over(whole)).cast("double"),
    })
    rows = rows.withColumns({f"q{q}": F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("bucket"))).over(whole) for q in (25, 75, *TAIL)})
    below, above, lowest = _edge(F.col("before"), True), _edge(F.col("bucket")), _edge(F.col("q25"))
    jumps = ((F.col("upto") - F.col("n")) * 2 >= F.col("total")) & (above - below > below - lowest + counts * F.col("unit"))
    out = rows.groupBy(*keys, "measure").agg(
        F.max("total").alias("n"), F.min(F.when(jumps, (below + above) / 2)).alias("jump"), *[F.max(f"q{q}").alias(f"q{q}") for q in (25, 75, *TAIL)]
    )
    share = ~F.col("measure").isin(*[m for m, (_, low, _) in MEASURES.items() if low])
    a, b = _edge(F.col("q25")), _edge(F.col("q75"), True)
    c, d = (_edge(F.col(f"q{q}"), True) for q in TAIL)
    fence, tail = F.when(b > 0, b + spread * (b - a)), F.when(share & (d > c), d + (d - c))
    most = F.when(share, 1.0)
    return out.select(*keys, "measure", "n", F.when(~share, a - spread * (b - a)).alias("low"), F.least(fence, tail, "jump", most).alias("high"))


def thresholds(rows: DataFrame, groups: tuple[str, str], prior: float = PRIOR, spread: float = SPREAD) -> DataFrame:
    """Limits per group: the two group columns, and <measure>_low / <measure>_high.

    rows: counts of documents; those that fail the base rules say nothing about the others, and
    counts without n_lines nothing about repeated lines.
    """
    lang, source = groups
    if "n_lines" not in rows.columns:
        rows = rows.withColumn("n_lines", F.lit(None).cast("long"))
    sketches = settled(sketched(rows.where(~base_failed()), groups), "sketches")

    def same(*names: str) -> Column:
        return reduce(Column.__and__, [F.col(f"g.{c}").eqNullSafe(F.col(f"o.{c}")) for c in names])

    out = rows.select(lang, source).distinct().select(lang, source, F.explode(F.array(*map(F.lit, MEASURES))).alias("measure"))
    for k, keys in enumerate(((lang, source), (lang,), ())):
        limits = sketch_limits(sketches, keys, spread)
        more = [F.col(f"o.{c}").alias(f"{c}{k}") for c in ("n", "low", "high")]
        out = out.alias("g").join(limits.alias("o"), same(*keys, "measure"), "left").select("g.*", *more)

    def blended(side: str) -> Column:
        limit = F.col(f"{side}2")
        for k in (1, 0):
            weight = F.col(f"n{k}") / (F.col(f"n{k}") + prior)
            limit = F.coalesce(weight * F.col(f"{side}{k}") + (1 - weight) * limit, limit)
        return limit

    sides = [F.max(F.when(F.col("measure") == m, blended(side))).alias(f"{m}_{side}") for m in MEASURES for side in ("low", "high")]
    return out.groupBy(lang, source).agg(*sides)


def judged(df: DataFrame, id: str = "doc_id", text: str = "text", groups: tuple[str, str] = ("lang", "source"),
           prior: float = PRIOR, spread: float = SPREAD) -> DataFrame:
    """Per row: id, groups, counts, base_failed, kept, reasons (names of the measures whose limits it lies beyond)."""
    rows = settled(measured(df, text, (id, *groups), lines=True), "measured")
    limits = settled(thresholds(rows, groups, prior, spread), "thresholds")
    met = [F.col(f"r.{g}").eqNullSafe(F.col(f"t.{g}")) for g in groups]
    joined = rows.alias("r").join(limits.alias("t"), reduce(Column.__and__, met), "left")
    beyond = []
    for m, (expression, _, _) in MEASURES.items():
        value = F.expr(expression)
        beyond.append(F.when((value > F.col(f"{m}_high")) | (value < F.col(f"{m}_low")), F.lit(m)))
    reasons = F.array_compact(F.array(*beyond))
    return joined.select(
        *[F.col(f"r.{c}") for c in (id, *groups, *_COUNTS)], base_failed().alias("base_failed"),
        (~base_failed() & (F.size(reasons) == 0)).alias("kept"), reasons.alias("reasons"),
    )
