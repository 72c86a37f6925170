"""Mixing sources to target weights by subset-sum budget fitting.

Sources by code point (null last) weigh 1, 2, 3, 1, ... and share the budget, which is a
given share of all words.  A target stops at MAX_REPEATS times its source's words; what is
cut off goes to the others by weight until no target is above its limit.

A source's whole repetitions of itself are taken first.  The rest of its budget is fitted
exactly: its documents are counted by length, each length gives its proportional share, a
seeded pass over the lengths brings what is missing below DP_BUDGET words, and a bounded
knapsack over the counts that are left finds the sum closest to it.  Of each length the
planned number of documents is then picked by a seeded hash of the id.

Only lengths and counts meet in one task (a source of n words has fewer than sqrt(2n)
lengths), never documents; picking cuts each (source, length) into BINS by hash, so that no
group of documents is ranked as a whole.  Sources are ranked by a range partitioning and
the shares are found from sums alone, so their number is not bound either.

Size is the number of words; null and empty texts have size 0, are taken with 0 words and
fill no budget.  Repeated rows are documents of their own.  An empty table gives an empty
result.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import settled, unused
from .words import sliced, word_counts

MAX_REPEATS = 3
DP_BUDGET = 1 << 16
BINS = 1024
SEED = 17
_KEYS = ["__s", "__null"]
_PLACE = (1 << 33) - 1


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED, dp_budget: int = DP_BUDGET) -> np.ndarray:
    """How many documents of each length to take so that their words come closest to the budget.

    Up to half of all words the sum is not above it; beyond that the documents left out are
    fitted in the same way, and the sum is not below it.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if 2 * budget > total:
        return counts - fit_counts(lengths, counts, total - budget, seed, dp_budget)
    take = np.floor(counts * (budget / total)).astype(np.int64) if total else np.zeros_like(counts)
    left = budget - int((lengths * take).sum())
    order = np.random.default_rng(seed).permutation(len(lengths))
    moved = True
    while left > dp_budget and moved:
        moved = False
        for i in order:
            if left > dp_budget and lengths[i] <= left and take[i] < counts[i]:
                take[i] += 1
                left -= int(lengths[i])
                moved = True
    return take + _knapsack(lengths, counts - take, min(left, dp_budget), order)


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int, order: np.ndarray) -> np.ndarray:
    """Bounded knapsack over sums 0..budget; for each sum the first (length, number) that reached it."""
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    item, number = np.full(budget + 1, -1), np.zeros(budget + 1, np.int64)
    for i in order:
        step, have, k = int(lengths[i]), int(counts[i]), 1
        while have > 0 and step and step * min(k, have) <= budget:
            k = min(k, have)
            new = reached[: budget + 1 - step * k] & ~reached[step * k :]
            at = np.flatnonzero(new) + step * k
            item[at], number[at] = i, k
            reached[at] = True
            have -= k
            k *= 2
        if reached[budget]:
            break
    out = np.zeros_like(counts)
    at = int(np.flatnonzero(reached)[-1])
    while at:
        out[item[at]] += number[at]
        at -= int(lengths[item[at]] * number[at])
    return out


def sized(df: DataFrame, text: str, size: str) -> DataFrame:
    """df without its text, with the number of words instead."""
    names = [c for c in df.columns if c != text]
    kinds = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != text], f"`{size}` long"])

    def count(batches):
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(word_counts(batch.column(text)))], names=[*names, size]
            )

    return df.mapInArrow(count, kinds)


def source_targets(rows: DataFrame, share: float = 1.0, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per source (columns __s, __null): source_size, weight, target.  rows: __s, __null, size."""
    spark = rows.sparkSession
    sums = settled(rows.groupBy(*_KEYS).agg(F.sum("size").alias("source_size")), "sources")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = settled(
        sums.repartitionByRange(parts, F.col("__null"), F.col("__s")).sortWithinPartitions("__null", "__s")
        .withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))),
        "ranked",
    )
    # one row per partition
    before = ranked.groupBy("part").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    weighed = settled(
        ranked.join(before.select("part", "before"), "part")
        .select(*_KEYS, "source_size", ((F.col("before") + F.col("place")) % 3 + 1).alias("weight")), "weights",
    )
    total, heaviest = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    limit = max_repeats * F.col("source_size")
    budget = share * (total or 0)
    capped, weight, level, last = 0, heaviest or 0, 0.0, None
    while weight and (capped, weight) != last:
        last = (capped, weight)
        level = (budget - capped) / weight
        over = limit <= F.col("weight") * F.lit(level)
        capped, weight = weighed.agg(
            F.coalesce(F.sum(F.when(over, limit)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))
        ).first()
    return weighed.withColumn("target", F.least(limit.cast("double"), F.col("weight") * F.lit(float(level))))


def _plan(seed: int):
    def plan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size", ignore_index=True)
        take = fit_counts(group["size"].to_numpy(), group["n"].to_numpy(), int(group["budget"].iloc[0]), seed)
        out = group[[*_KEYS, "size", "n"]].assign(take=take)
        return out[out["take"] > 0]

    return plan


def mixed_rows(rows: DataFrame, id: str = "doc_id", source: str = "source", share: float = 1.0, seed: int = SEED) -> DataFrame:
    """Times that each row is taken.

    rows: id, source, size and a unique __row.  Gives them with source_size, target, times.
    """
    rows = rows.withColumns({"__s": F.coalesce(source, F.lit("")), "__null": F.col(source).isNull()})
    targets = source_targets(rows, share)
    rest = F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    targets = settled(
        targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
        .withColumn("budget", F.when(F.col("source_size") > 0, rest).otherwise(0)), "targets",
    )
    lengths = rows.where("size > 0").groupBy(*_KEYS, "size").agg(F.count("*").alias("n"))
    plan = settled(
        lengths.join(targets.where("budget > 0").select(*_KEYS, "budget"), _KEYS).groupBy(*_KEYS)
        .applyInPandas(_plan(seed), "__s string, __null boolean, size long, n long, take long"), "plan",
    )
    picked = rows.withColumn("__hash", F.xxhash64(F.lit(seed), id, "__row")).withColumn("__bin", F.pmod("__hash", F.lit(BINS)))
    group = [*_KEYS, "size"]
    bins = picked.join(plan, group, "left_semi").groupBy(*group, "__bin").agg(F.count("*").alias("__in"))
    bins = bins.withColumn("__upto", F.sum("__in").over(Window.partitionBy(*group).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)))
    bins = bins.join(plan.select(*group, "take"), group).withColumn("__part", F.col("take") - (F.col("__upto") - F.col("__in"))).where("__part > 0")
    bins = settled(bins.select(*group, "__bin", "__in", "__part"), "bins")
    key = [*group, "__bin"]
    whole = picked.join(bins.where("__part >= __in").select(*key), key, "left_semi")
    edge = picked.join(bins.where("__part < __in").select(*key, "__part"), key)
    edge = edge.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy("__hash", "__row"))).where("__k <= __part")
    chosen = whole.select("__row").unionAll(edge.select("__row")).withColumn("__picked", F.lit(1))
    return (
        rows.join(chosen, "__row", "left").join(targets.select(*_KEYS, "source_size", "target", "whole"), _KEYS)
        .withColumn("times", F.col("whole") + F.coalesce("__picked", F.lit(0))).drop(*_KEYS, "whole", "__picked")
    )


def mix(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.0, seed: int = SEED) -> DataFrame:
    """Per row: id, source, size, source_size, target, times it is taken, words taken."""
    rows = sized(df.select(id, source, text), text, "size").withColumn("__row", F.monotonically_increasing_id())
    done = mixed_rows(settled(rows, "sizes"), id, source, share, seed)
    return done.select(id, source, "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


def mixture(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.0, seed: int = SEED) -> DataFrame:
    """The rows of df, each as often as the mix takes it, all columns unchanged.

    Texts without words fill no budget; the mix takes each of them once.
    """
    row, copies = unused(df, "__row"), unused(df, "__times")
    rows = settled(df.withColumn(row, F.monotonically_increasing_id()), "numbered")
    sizes = settled(sized(rows.select(F.col(row).alias("__row"), id, source, text), text, "size"), "sizes")
    times = mixed_rows(sizes, id, source, share, seed)
    times = times.select(F.col("__row").alias(row), F.when(F.col("size") == 0, 1).otherwise(F.col("times")).alias(copies)).where(F.col(copies) > 0)
    return rows.join(times, row).select(*df.columns, F.explode(F.sequence(F.lit(1), copies)).alias(unused(df, "__copy"))).select(*df.columns)
