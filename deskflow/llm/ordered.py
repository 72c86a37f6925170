"""Work along an order that no single task holds: sorted ranges, and running sums across them.

A table is cut into ranges of its order, each sorted and of about the same number of rows,
however many rows share a key.  Every range is worked off by itself; what one hands on to the
next is a row per range, so the driver sees as many rows as there are ranges and no more.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import settled

RANGE_ROWS = 1 << 17
PART = "range_number"


def in_ranges(df: DataFrame, order: list[str], rows: int = RANGE_ROWS) -> DataFrame:
    """df in ranges of about `rows` rows, each sorted; their numbers, in order, are in PART."""
    n = max(1, -(-df.count() // rows))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(PART, F.spark_partition_id())


def one_table(batches) -> pa.Table | None:
    """All rows of a range, None if there are none."""
    batches = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(batches).combine_chunks() if batches else None


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def unsigned(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, np.int64).view(np.uint64)


def running(
    df: DataFrame, key: str, order: list[str], names: list[str], steps: Callable[[pa.Table], list[np.ndarray]], rows: int = RANGE_ROWS
) -> DataFrame:
    """df with sums modulo 2**64 (as longs) over the rows of the same key so far, in the order given.

    `steps` gives a range's summands, one uint64 array for each of `names`.  `name` has the sum
    with the row itself, `name_before` that without it.  df is read twice: pass a stored table.
    The key must be a long without nulls; rows that are equal in key and order come in any order.
    """
    given = df.columns
    columns = [*names, *(f"{n}_before" for n in names)]
    fields = [*df.schema.fields, *(T.StructField(c, T.LongType()) for c in columns)]
    marks = [T.StructField(PART, T.IntegerType()), T.StructField("__head", T.BooleanType()), T.StructField("__last", T.BooleanType())]
    inner = T.StructType([*fields, *marks])

    def scan(batches):
        table = one_table(batches)
        if table is None:
            return
        k, at = numbers(table, key), np.arange(table.num_rows)
        start = np.maximum.accumulate(np.where(np.concatenate([[True], k[1:] != k[:-1]]), at, 0))
        sums, before = [], []
        for step in steps(table):
            total = np.cumsum(step, dtype=np.uint64)
            own = total - (total - step)[start]
            sums.append(pa.array(own.view(np.int64)))
            before.append(pa.array((own - step).view(np.int64)))
        yield from pa.table(
            [*(table[c] for c in given), *sums, *before, table[PART], pa.array(k == k[0]), pa.array(at == len(at) - 1)], names=inner.fieldNames()
        ).to_batches()

    done = settled(in_ranges(df, [key, *order], rows).mapInArrow(scan, inner), "running")
    # the last row of each range and the key it begins with: as many rows as ranges
    edges = done.groupBy(PART).agg(F.max(F.when(F.col("__last"), F.struct(key, *names))).alias("last"), F.max(F.when(F.col("__head"), F.col(key))).alias("first"))
    carry, have, sums = {}, None, [0] * len(names)
    for part, last, first in sorted(tuple(r) for r in edges.collect()):
        carry[part] = sums if first == have else [0] * len(names)
        sums = [(a + b) % 2**64 for a, b in zip(last[1:], carry[part] if last[0] == first else [0] * len(names))]
        have = last[0]
    table_of = np.zeros((max(carry, default=0) + 1, len(names)), np.uint64)
    for part, values in carry.items():
        table_of[part] = values
    schema = T.StructType(fields)

    def carried(batches):
        for batch in batches:
            if batch.num_rows:
                more = table_of[batch[PART].to_numpy()] * np.array(batch["__head"].to_numpy(zero_copy_only=False), np.uint64)[:, None]
                arrays = [batch[c] for c in given]
                arrays += [pa.array((unsigned(batch[c].to_numpy()) + more[:, i % len(names)]).view(np.int64)) for i, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return done.mapInArrow(carried, schema)
