"""Packing of token pieces into sequences of fixed capacity by a grouping genetic algorithm.

A piece that fills a sequence has one of its own.  All others are dealt by hash into blocks
of about BLOCK pieces.  Each block is packed by ISLANDS populations, each in a task of its
own.  A solution is a list of bins; crossover injects whole well-filled bins of one parent
into the other, drops the bins that hold a piece twice, and puts the displaced pieces back
by best fit; mutation empties badly filled bins.  After each epoch the best solution of an
island (its elite) migrates to the next island of its block, until a block needs no more
sequences than its words fill or an epoch saves no sequence in any block.

What lies in badly filled bins is then dealt into blocks again, at most half as many each time,
until one block is left; where most bins are badly filled, only each block's least filled ones
are.  So the loss is a part of one sequence, not one per block.  A block holds at most about
BLOCK pieces, or twice as many as one sequence can; only the number of blocks grows.

Null and empty texts are the closing id alone.  Repeated rows are packed as often as they
occur.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settled
from .tokens import pieces

CAPACITY = 4096
BLOCK = 8192
ISLANDS = 3
EPOCHS = 2
POPULATION = 4
GENERATIONS = 6
WEAK = 0.97
LEAST = 8  # one in so many pieces of a block, those in its least filled bins
SEED = 43


class _Bins:
    """Bins by free room; the tightest one that fits is found in a bit set."""

    def __init__(self, capacity: int):
        self.capacity, self.mask = capacity, 0
        self.by_room: dict[int, list[list[int]]] = {}

    def put(self, items: list[int], room: int) -> None:
        at = self.by_room.setdefault(room, [])
        if not at:
            self.mask |= 1 << room
        at.append(items)

    def best_fit(self, item: int, size: int) -> None:
        left = self.mask >> size
        if not left:
            self.put([item], self.capacity - size)
            return
        room = size + (left & -left).bit_length() - 1
        at = self.by_room[room]
        items = at.pop()
        if not at:
            self.mask &= ~(1 << room)
        items.append(item)
        self.put(items, room - size)

    def all(self) -> list[list[int]]:
        return [items for at in self.by_room.values() for items in at]


def _filled(items, size: list[int]) -> int:
    return sum(size[i] for i in items)


def _placed(kept: list[list[int]], loose: list[int], size: list[int], capacity: int) -> list[list[int]]:
    bins = _Bins(capacity)
    for items in kept:
        bins.put(list(items), capacity - _filled(items, size))
    for i in sorted(loose, key=lambda i: (-size[i], i)):
        bins.best_fit(i, size[i])
    return bins.all()


def _fitness(solution: list[list[int]], size: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    return -len(solution), sum((_filled(items, size) / capacity) ** 2 for items in solution)


def _crossed(a: list[list[int]], b: list[list[int]], size: list[int], capacity: int, rng) -> list[list[int]]:
    fill = np.array([_filled(items, size) for items in b])
    best = np.argsort(-fill, kind="stable")[: max(1, len(b) // 2)]
    share = rng.uniform(0.1, 0.5)
    injected = [b[i] for i in best[rng.random(len(best)) < share]]
    inside = {i for items in injected for i in items}
    kept, loose = [], []
    for items in a:
        if inside.isdisjoint(items):
            kept.append(items)
        else:
            loose.extend(i for i in items if i not in inside)
    return _placed([*injected, *kept], loose, size, capacity)


def _mutated(a: list[list[int]], size: list[int], capacity: int, rng) -> list[list[int]]:
    fill = np.array([_filled(items, size) for items in a])
    order = np.argsort(fill + rng.random(len(a)) * capacity * 0.2, kind="stable")
    out = set(order[: max(2, len(a) // 50)].tolist())
    return _placed([x for k, x in enumerate(a) if k not in out], [i for k in out for i in a[k]], size, capacity)


def evolve(size: list[int], capacity: int, elites: list[list[list[int]]], seed: int,
           population: int = POPULATION, generations: int = GENERATIONS) -> list[list[int]]:
    """The best solution; stops after some generations that save no bin, or when no solution can have fewer."""
    least = -(-sum(size) // capacity)
    rng = np.random.default_rng(seed)
    people = [x for x in elites if x]
    if not people:
        people = [_placed([], list(range(len(size))), size, capacity)]
    key = lambda s: _fitness(s, size, capacity)
    best = max(people, key=key)
    if len(best) <= least:
        return best
    while len(people) < population:
        bins = _Bins(capacity)
        for i in rng.permutation(len(size)).tolist():
            bins.best_fit(i, size[i])
        people.append(bins.all())
    fewest, idle = min(map(len, people)), 0
    while idle < generations:
        people.sort(key=key, reverse=True)
        if len(people[0]) <= least:
            break
        fewest, idle = (len(people[0]), 1) if len(people[0]) < fewest else (fewest, idle + 1)
        a, b = people[0], people[1 + int(rng.integers(len(people) - 1))]
        children = [_crossed(a, b, size, capacity, rng), _crossed(b, a, size, capacity, rng), _mutated(a, size, capacity, rng)]
        people = sorted([*people, *children], key=key, reverse=True)[:population]
    return max(people, key=key)


def _to_bytes(solution: list[list[int]], n: int) -> bytes:
    of = np.zeros(n, "<u4")
    for k, items in enumerate(solution):
        of[items] = k
    return of.tobytes()


def _from_bytes(data: bytes | None) -> list[list[int]]:
    if not data:
        return []
    of = np.frombuffer(data, "<u4")
    out: list[list[int]] = [[] for _ in range(int(of.max()) + 1)]
    for i, k in enumerate(of.tolist()):
        out[k].append(i)
    return out


def _blocks(items: DataFrame, n_blocks: int, level: int) -> DataFrame:
    """One row per block: its pieces' numbers and lengths."""

    def gather(group: pa.Table) -> pa.Table:
        number = group["__piece"].combine_chunks().to_numpy()
        order = np.argsort(number)
        return pa.table({
            "block": group["block"][:1].combine_chunks(),
            "numbers": pa.array([number[order].tobytes()], pa.binary()),
            "lengths": pa.array([group["length"].combine_chunks().to_numpy()[order].tobytes()], pa.binary()),
        })

    dealt = items.select("__piece", "length", F.pmod(F.xxhash64(F.lit(SEED + level), "__piece"), F.lit(n_blocks)).alias("block"))
    return dealt.groupBy("block").applyInArrow(gather, "block long, numbers binary, lengths binary")


def _epoch(rows: DataFrame, epoch: int, capacity: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            elites, bins = [], []
            for block, island, lengths, own, guest in zip(*(c.to_pylist() for c in batch.columns)):
                size = np.frombuffer(lengths, np.int64).tolist()
                best = evolve(size, capacity, [_from_bytes(own), _from_bytes(guest)], hash((block, island, epoch, SEED)) & 0x7FFFFFFF)
                elites.append(_to_bytes(best, len(size)))
                bins.append(len(best))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(elites, pa.binary()), pa.array(bins, pa.int64())], names=["block", "island", "elite", "bins"])

    return rows.select("block", "island", "lengths", "own", "guest").mapInArrow(run, "block long, island int, elite binary, bins long")


def _spread_out(df: DataFrame) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block", "island")


def _sequences(elites: DataFrame) -> int:
    return elites.groupBy("block").agg(F.min("bins").alias("bins")).agg(F.coalesce(F.sum("bins"), F.lit(0))).first()[0]


def _packed_level(items: DataFrame, n_blocks: int, level: int, capacity: int) -> DataFrame:
    """Rows (__piece, length, sequence_id, offset, weak, least) of one dealing into blocks."""
    blocks = settled(_blocks(items, n_blocks, level), "blocks")
    islands = _spread_out(blocks.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))))
    none = F.lit(None).cast("binary")
    elites = settled(_epoch(islands.withColumns({"own": none, "guest": none}), 0, capacity), "elites")
    epoch = 1
    before = fewest = _sequences(elites)
    while epoch < EPOCHS or before > fewest:
        guests = elites.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("elite").alias("guest"))
        rows = islands.join(elites.select("block", "island", F.col("elite").alias("own")), ["block", "island"]).join(guests, ["block", "island"])
        elites = settled(_epoch(_spread_out(rows), epoch, capacity), "elites")
        before, fewest, epoch = fewest, _sequences(elites), epoch + 1

    def choose(batches):
        for batch in batches:
            number, length, sequence, offset, weak, least = [], [], [], [], [], []
            for block, numbers, lengths, elites in zip(*(c.to_pylist() for c in batch.columns)):
                of = min((np.frombuffer(e, "<u4") for e in elites), key=lambda x: (int(x.max()), x.tobytes())).astype(np.int64)
                size, name = np.frombuffer(lengths, np.int64), np.frombuffer(numbers, np.int64)
                order = np.argsort(of, kind="stable")
                ends = np.cumsum(size[order])
                first = np.searchsorted(of[order], of[order])
                fill = np.bincount(of, size)
                number.append(name[order])
                length.append(size[order])
                sequence.append((level << 58) + (block << 22) + of[order])
                offset.append(ends - size[order] - (ends - size[order])[first])
                weak.append(fill[of[order]] < WEAK * capacity)
                worst = np.argsort(fill, kind="stable")
                some = np.zeros(len(fill), bool)
                some[worst[: max(1, np.searchsorted(np.cumsum(np.bincount(of)[worst]), len(of) // LEAST, "right"))]] = True
                least.append(some[of[order]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (number, length, sequence, offset, weak, least)], names=["__piece", "length", "sequence_id", "offset", "weak", "least"])

    found = blocks.join(elites.groupBy("block").agg(F.array_sort(F.collect_list("elite")).alias("elites")), "block")
    return settled(
        found.select("block", "numbers", "lengths", "elites").mapInArrow(choose, "__piece long, length long, sequence_id long, offset long, weak boolean, least boolean"),
        "packed",
    )


def assigned(items: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Rows (__piece, sequence_id, offset) for rows (__piece, length); __piece is unique, 0 < length <= capacity."""
    whole = items.where(F.col("length") == capacity)
    done = whole.select("__piece", (-1 - F.col("__piece")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = items.where(F.col("length") < capacity)
    n, level = left.count(), 0
    n_blocks = -(-n // block)
    while n:
        packed = _packed_level(left, n_blocks, level, capacity)
        if n_blocks == 1:
            done = done.unionAll(packed.select("__piece", "sequence_id", "offset"))
            break
        again, rest = "weak", packed.where("weak").count()
        if rest > n // 2:
            again, rest = "least", packed.where("least").count()
        done = done.unionAll(packed.where(f"not {again}").select("__piece", "sequence_id", "offset"))
        left, n, level, n_blocks = packed.where(again), rest, level + 1, min(-(-rest // block), -(-n_blocks // 2))
    return done


def pack(df: DataFrame, path: str, id: str = "doc_id", text: str = "text", end: int | None = 1, capacity: int = CAPACITY,
         extra: dict | None = None) -> DataFrame:
    """Per piece: id, piece, start, length, sequence_id, offset, and `extra` columns made from its `ids` (binary)."""
    extra = {"ids": F.col("ids")} if extra is None else extra
    cut = pieces(df, path, id, text, end, capacity).select(id, "piece", "start", "length", *[c.alias(n) for n, c in extra.items()])
    cut = settled(cut.withColumn("__piece", F.monotonically_increasing_id()), "pieces")
    return cut.join(assigned(cut.select("__piece", "length"), capacity), "__piece").drop("__piece")
