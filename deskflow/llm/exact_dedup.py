"""Exact duplicates by two-pass Bloom filtering.

Pass one reads every text, hashes it and streams the hashes into Bloom filters, one per
shard of hashes.  A hash whose bits are all set when it arrives may be a repetition and
goes into the shard's second filter.  Pass two reads the texts again and tests each hash
against the second filters, which workers memory-map.  Rows that the filter rules out are
unique and pass straight through; only the others shuffle, by the SHA-256 of their text.

A filter has a fixed number of bits; their number grows with the rows, so the share of
false candidates stays the same at every size.  A false candidate only shuffles in vain.

Two texts are equal when they are identical after A-Z are lowered; null equals the empty
text.  Of equal texts the row with the largest id stays (a null id is smaller than any);
of repeated rows with one id exactly one stays.  An empty table gives an empty result.
Other columns, whatever their names, are carried along and never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import load_array, new_folder, packed, save_array, settled, unpacked, unused
from .words import LOWER, mixed, text_bytes

SHARD_KEYS = 1 << 20
BITS_PER_KEY = 16
HASHES = 6
TASK_KEYS = 1 << 20
SHA, MAYBE, ROW = "__llm_sha256", "__llm_maybe", "__llm_row"


def _digests(texts: pa.Array) -> list[bytes]:
    data, offsets = text_bytes(texts)
    view = memoryview(LOWER[data])
    at = offsets.tolist()
    return [hashlib.sha256(view[a:b]).digest() for a, b in zip(at, at[1:])]


def _keys(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 4)[:, 0]


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(keys) % np.uint64(shards)).astype(np.int64)


def _places(keys: np.ndarray, shard_keys: int) -> np.ndarray:
    """The bits of each key within its shard's filter: HASHES x keys."""
    step = mixed(keys + np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
    return np.stack([(keys + np.uint64(i) * step) % np.uint64(shard_keys * BITS_PER_KEY) for i in range(HASHES)])


def possibly_repeated(df: DataFrame, text: str = "text", shard_keys: int = SHARD_KEYS) -> tuple[str, int]:
    """Pass one: build the second filters; gives their folder and number."""
    folder = new_folder(df.sparkSession, "repeats")
    shards = max(1, -(-df.count() // shard_keys))

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                keys, counts = np.unique(np.concatenate(held), return_counts=True)
                shard = _shard(keys, shards)
                found = np.unique(shard)
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array(found, pa.int64()),
                    "keys": pa.array([packed(keys[shard == s]) for s in found], pa.binary()),
                    "again": pa.array([packed(keys[(shard == s) & (counts > 1)]) for s in found], pa.binary()),
                })
                held.clear()

        for batch in batches:
            held.append(_keys(_digests(batch.column(0))))
            if sum(map(len, held)) >= TASK_KEYS:
                yield from out()
        yield from out()

    def build(group: pa.Table) -> pa.Table:
        once = np.zeros(shard_keys * BITS_PER_KEY, bool)
        twice = np.zeros_like(once)
        for keys, again in zip(group["keys"], group["again"]):
            places = _places(unpacked(keys.as_py()), shard_keys)
            twice[places[:, once[places].all(0)]] = True
            twice[_places(unpacked(again.as_py()), shard_keys)] = True
            once[places] = True
        shard = group["shard"][0].as_py()
        save_array(folder, str(shard), np.packbits(twice, bitorder="little"))
        return pa.table({"shard": pa.array([shard], pa.int64())})

    df.select(text).mapInArrow(partials, "shard long, keys binary, again binary").groupBy("shard").applyInArrow(build, "shard long").count()
    return folder, shards


def marked(df: DataFrame, text: str = "text", shard_keys: int = SHARD_KEYS, drop_text: bool = False,
           added: tuple[str, str] = (SHA, MAYBE)) -> DataFrame:
    """df with the text's SHA-256 (hex) and whether its hash may be repeated, in columns named as in `added`."""
    folder, shards = possibly_repeated(df, text, shard_keys)
    left = [f for f in df.schema.fields if not (drop_text and f.name == text)]
    schema = T.StructType([*left, T.StructField(added[0], T.StringType()), T.StructField(added[1], T.BooleanType())])
    names = [f.name for f in left]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = _digests(batch.column(text))
            keys = _keys(digests)
            maybe = np.zeros(len(keys), bool)
            shard = _shard(keys, shards)
            for s in np.unique(shard):
                bits = load_array(folder, str(s), np.uint8)
                mine = np.flatnonzero(shard == s)
                at = _places(keys[mine], shard_keys)
                maybe[mine] = ((bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(0)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array([d.hex() for d in digests], pa.string()), pa.array(maybe)],
                names=[*names, *added],
            )

    return df.mapInArrow(mark, schema)


def exact_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per row of df: id, keep_id, group_size, kept, text_sha256."""
    rows = marked(df.select(id, text), text, shard_keys, drop_text=True)
    rows = settled(rows.withColumn(ROW, F.monotonically_increasing_id()), "hashed")
    maybe = rows.where(MAYBE)
    groups = maybe.groupBy(SHA).agg(F.max(F.struct(id, ROW)).alias("top"), F.count("*").alias("group_size"))
    groups = settled(groups, "groups")  # a plain join of two tables, whose hot keys Spark splits
    met = maybe.join(groups, SHA).select(
        id, F.col(f"top.{id}").alias("keep_id"), "group_size",
        (F.col(ROW) == F.col(f"top.{ROW}")).alias("kept"), F.col(SHA).alias("text_sha256"),
    )
    alone = rows.where(~F.col(MAYBE)).select(
        id, F.col(id).alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col(SHA).alias("text_sha256"),
    )
    return alone.unionAll(met)


def drop_exact_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", shard_keys: int = SHARD_KEYS) -> DataFrame:
    """df with one row of each group of equal texts, all columns unchanged.

    Rows with the same largest id are told apart by a hash of all their columns.
    """
    sha, maybe = unused(df, SHA), unused(df, MAYBE)
    rows = marked(df, text, shard_keys, added=(sha, maybe))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = (
        rows.where(F.col(maybe)).groupBy(sha)
        .agg(F.max_by(row, F.struct(F.col(id), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))).alias("best"))
        .select("best.*")
    )
    return rows.where(~F.col(maybe)).select(*df.columns).unionAll(best)
