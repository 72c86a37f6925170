"""Removal of word windows that occur more than once, by Rabin-Karp hashes counted in Spark.

Every window of WIDTH consecutive words of every text gets a rolling hash.  Pass one sends
each task's distinct hashes to shards; a shard sorts what it gets and keeps the hashes that
came twice.  Pass two rolls the hashes again, looks them up in the kept arrays, which
workers memory-map, and merges repeated windows that touch into maximal intervals, which
are removed.  Windows are judged on the input, never on what is left.

A hash that fills a third of the corpus reaches its shard at most twice per task flush, so
no shard is larger than another.  Shards grow in number with the text, not in size.  Within
a shard, hashes are told apart by 64 bits that are independent of the choice of the shard,
so a chance match needs 64 + log2(shards) equal bits.

Words are runs of bytes other than space and 0x09-0x0D.  Null and empty texts, and texts of
fewer than WIDTH words, lose nothing.  Repeated rows repeat each other's windows and both
lose them.  Kept words are joined by one space.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import load_array, new_folder, packed, save_array, unpacked
from .words import Words, hashed_words, mixed, ngrams, sliced

WIDTH = 35
SHARD_BYTES = 16 << 20
FLUSH = 4 << 20
_BASE = 0xA0761D6478BD642D
_U64 = np.uint64


def _windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    return ngrams(words, width, _BASE)


def _by_shard(hashes: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that is met, and the places of its hashes in ascending order."""
    shard = mixed(hashes ^ _U64(0x2545F4914F6CDD1D)) % _U64(shards)
    order = np.lexsort((hashes, shard))
    met, at = np.unique(shard[order], return_index=True)
    return zip(met.tolist(), np.split(order, at[1:]))


def repeated_windows(df: DataFrame, text: str, width: int, shard_bytes: int = SHARD_BYTES) -> tuple[str, int]:
    """Pass one: the hashes of all windows that occur twice or more; their folder and shards."""
    spark = df.sparkSession
    folder = new_folder(spark, "windows")
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))

    def partials(batches):
        held: list[np.ndarray] = []

        def out():
            hashes = np.sort(np.concatenate(held)) if held else np.empty(0, _U64)
            held.clear()
            if not len(hashes):
                return
            new = np.ones(len(hashes), bool)
            new[1:] = hashes[1:] != hashes[:-1]
            first = np.flatnonzero(new)
            again = np.diff(first, append=len(hashes)) > 1
            hashes = hashes[first]
            for s, mine in _by_shard(hashes, shards):
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([s], pa.int64()), "hashes": pa.array([packed(hashes[mine])], pa.binary()),
                    "again": pa.array([packed(hashes[mine[again[mine]]])], pa.binary()),
                })

        for batch in sliced(batches):
            held.append(_windows(hashed_words(batch.column(0)), width)[0])
            if sum(map(len, held)) >= FLUSH:
                yield from out()
        yield from out()

    def build(group: pa.Table) -> pa.Table:
        parts = [unpacked(x.as_py()) for name in ("hashes", "again") for x in group[name]]
        hashes = np.sort(np.concatenate(parts))
        found = hashes[1:][hashes[1:] == hashes[:-1]]
        shard = group["shard"][0].as_py()
        save_array(folder, str(shard), np.unique(found))
        return pa.table({"shard": pa.array([shard], pa.int64())})

    rows = df.select(text).mapInArrow(partials, "shard long, hashes binary, again binary")
    # as many partitions as shards, so a task's share does not grow with the input
    rows.repartition(shards, "shard").groupBy("shard").applyInArrow(build, "shard long").count()
    return folder, shards


def _repeated(hashes: np.ndarray, folder: str, shards: int) -> np.ndarray:
    hit = np.zeros(len(hashes), bool)
    if not len(hashes):
        return hit
    for s, mine in _by_shard(hashes, shards):
        known = load_array(folder, str(s), np.uint64)
        if len(known):
            place = np.minimum(np.searchsorted(known, hashes[mine]), len(known) - 1)
            hit[mine] = known[place] == hashes[mine]
    return hit


def remove_repeated_windows(
    df: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Per row: id, n_words, spans (first and end word of each removed interval), n_removed, kept_text."""
    folder, shards = repeated_windows(df, text, width, shard_bytes)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([
        T.StructField(id, df.schema[id].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(span)), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()),
    ])

    def clean(batches):
        for batch in sliced(batches):
            words = hashed_words(batch.column(1))
            hashes, at = _windows(words, width)
            starts = at[_repeated(hashes, folder, shards)]
            change = np.zeros(len(words.hashes) + 1, np.int32)
            np.add.at(change, starts, 1)
            np.subtract.at(change, starts + width, 1)
            gone = np.cumsum(change[:-1]) > 0
            edge = np.diff(gone.astype(np.int8), prepend=0, append=0)
            edge_at = words.first[1:-1][(words.first[1:-1] > 0) & (words.first[1:-1] < len(gone))]
            # intervals of neighbouring texts that touch are two
            apart = edge_at[gone[edge_at] & gone[edge_at - 1]] if len(edge_at) else edge_at
            apart = np.unique(apart)
            begin = np.sort(np.concatenate([np.flatnonzero(edge == 1), apart]))
            end = np.sort(np.concatenate([np.flatnonzero(edge == -1), apart]))
            first = words.first
            of = np.searchsorted(begin, first)
            raw = words.data
            counts, spans, removed, kept = words.counts(), [], [], []
            bytes_at = words.starts
            whole = memoryview(raw)
            for i in range(batch.num_rows):
                a, b = first[i], first[i + 1]
                mine = [(int(x - a), int(y - a)) for x, y in zip(begin[of[i] : of[i + 1]], end[of[i] : of[i + 1]])]
                spans.append([{"start": x, "end": y} for x, y in mine])
                removed.append(sum(y - x for x, y in mine))
                if a == b:
                    kept.append(b"")
                    continue
                pieces, left = [], 0
                for x, y in [*mine, (int(b - a), 0)]:
                    if x > left:
                        pieces.append(bytes(whole[bytes_at[a + left] : words.ends[a + x - 1]]))
                    left = y
                kept.append(b" ".join(b" ".join(pieces).split()))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(counts, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
            ], names=[f.name for f in schema.fields])

    return df.select(id, text).mapInArrow(clean, schema)
