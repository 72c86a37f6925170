"""The trie of all prefixes of conversations: how many share each, and what sharing saves.

A turn is a role and a text.  Each turn and its depth give 128 bits; their sums along a
conversation name its prefixes, so every prefix is known after one ordered scan, however long
a conversation is.  Grouping by these names gives the nodes: members, smallest member,
conversations that end there.

Sums over subtrees are taken in shards.  A node is light if the turns of its members from there
on are at most LIGHT; then its whole subtree is small, and the subtrees below the lowest nodes
that are not light are dealt over shards of bounded size.  A shard gives its nodes' names slots
by a minimal perfect hash, held against the names stored at the slots (a name that is not in
the shard is known to be so), scatters the counts into flat arrays by slot, finds every node's
parent slot, and adds leaves and savings to the parents from the deepest nodes up.  What its
topmost nodes come to is handed to their parents, the heavy nodes, which are worked off in the
same way in bands of at most BAND nodes, the deepest first.

A first turn that a third of all conversations share is one heavy node with one row; a
conversation that holds a third of all turns is cut over many ranges.  Nothing but counts and
a row per range reaches the driver.

Turns go by their number, nulls first; of equal numbers, by a digest of role and text.  Null
roles and texts are empty ones.  Rows without a conversation are left out.  Repeated rows are
turns of their own.  Columns other than the four are not read.  No conversations give no nodes.
Two prefixes of one 128-bit name would be an error if they differ in depth, parent or length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import RANGE_ROWS, numbers, running, unsigned
from .shared import settled
from .words import mixed

LIGHT = 1 << 14
BAND = 1 << 19
ENDS = 12  # ids are joined in chunks of 2**ENDS possible ones
_U64 = np.uint64
NODE = "name0 long, name1 long, conv_id long, depth long, parent0 long, parent1 long, n_convs long, n_ends long, chars long"
FOLDED = NODE + ", parent_conv_id long, n_children long, n_leaves long, saved_tokens long, is_top boolean"


def turns_of(df: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """Rows (conv_id, place from 1, digest, chars) of conversations (conv_id, turn, role, text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    narrow = df.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"),
        F.char_length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("__row"),
    )
    # the row number only parts rows that are equal in all else, so a crowd of them is cut too
    done = running(settled(narrow, "turns"), "conv_id", ["turn", "digest", "__row"], ["place"], lambda t: [np.ones(t.num_rows, _U64)], rows)
    return settled(done.select("conv_id", "place", "digest", "chars"), "places")


def _first(rows: DataFrame, most: int) -> DataFrame:
    """Per conversation: its number of turns, and the first `most` of them."""
    turn = F.when(F.col("place") <= most, F.struct("place", "digest", "chars"))
    return rows.groupBy("conv_id").agg(F.max("place").alias("n"), F.array_sort(F.collect_list(turn)).alias("first"))


def spliced(rows: DataFrame, base, taken, most: int) -> tuple[DataFrame, DataFrame]:
    """Exchange each conversation's first `taken` turns (at most `most`) for those of conversation `base`.

    base, taken: column expressions of conv_id.  A conversation that has fewer gives all, one
    that is absent none.  Gives the new turns, and conversations with their `length`.
    """
    heads = settled(_first(rows, most), "heads")
    given = heads.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("first").alias("base_first"))
    convs = heads.select("conv_id", "n", base.alias("base"), taken.cast("long").alias("taken")).join(given, "base", "left")
    shared = F.least("taken", F.coalesce("base_n", F.lit(0)))
    convs = convs.select(
        "conv_id", "taken", shared.alias("shared"), F.slice("base_first", F.lit(1), shared.cast("int")).alias("first"),
        (shared + F.greatest(F.lit(0), F.col("n") - F.col("taken"))).alias("length"),
    )
    convs = settled(convs, "spliced")
    front = convs.select("conv_id", "length", F.explode("first").alias("t")).select("conv_id", F.col("t.place").alias("depth"), "t.digest", "t.chars", "length")
    rest = rows.join(convs.select("conv_id", "taken", "shared", "length"), "conv_id").where(F.col("place") > F.col("taken"))
    rest = rest.select("conv_id", (F.col("place") - F.col("taken") + F.col("shared")).alias("depth"), "digest", "chars", "length")
    return settled(front.unionAll(rest), "rebuilt"), convs.select("conv_id", "length")


def whole(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as they are, and conversations with their `length`."""
    convs = settled(rows.groupBy("conv_id").agg(F.max("place").alias("length")), "lengths")
    return settled(rows.withColumnRenamed("place", "depth").join(convs, "conv_id").select("conv_id", "depth", "digest", "chars", "length"), "whole"), convs


def _steps(table: pa.Table) -> list[np.ndarray]:
    """Two numbers of each turn at its depth."""
    halves = np.frombuffer(b"".join(table["digest"].to_pylist()), _U64).reshape(-1, 2)
    depth = unsigned(numbers(table, "depth"))
    return [mixed(halves[:, i] ^ mixed(depth * _U64(2) + _U64(i + 1))) for i in (0, 1)]


class Slots:
    """A minimal perfect hash of distinct names (rows of two uint64), held against the names themselves.

    Names that are alone at their place in a level's bits stay there; the others go on to the
    next level.  A name's slot is the number of set bits before its own.
    """

    def __init__(self, names: np.ndarray):
        self.levels, left, before = [], names, 0
        while len(left):
            size = 2 * len(left)
            at = self._places(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((alone, before + np.cumsum(alone) - 1))
            before += int(alone.sum())
            left = left[~alone[at]]
            if len(self.levels) > 64:
                raise ValueError("names must be distinct")
        self.names = np.zeros((before, 2), _U64)
        self.names[self._slots(names)] = names

    @staticmethod
    def _places(names: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = mixed(np.array([level + 1], _U64))[0]
        return (mixed(names[:, 0] ^ seed) + mixed(names[:, 1] + seed)) % _U64(size)

    def _slots(self, names: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(names), -1, np.int64), np.arange(len(names))
        for level, (alone, slot) in enumerate(self.levels):
            at = self._places(names[open_], level, len(alone))
            hit = alone[at]
            out[open_[hit]] = slot[at[hit]]
            open_ = open_[~hit]
        return out

    def find(self, names: np.ndarray) -> np.ndarray:
        """Slots of names; -1 for those that are not in the table."""
        out = self._slots(names)
        some = np.flatnonzero(out >= 0)
        wrong = (self.names[out[some]] != names[some]).any(axis=1)
        out[some[wrong]] = -1
        return out


def _folded(group: pa.Table) -> pa.Table:
    """A shard's or band's nodes with their subtrees summed up; `from_*` is what was handed to them."""
    names, parents = (np.column_stack([unsigned(numbers(group, f"{what}{i}")) for i in (0, 1)]) for what in ("name", "parent"))
    slots = Slots(names)
    slot, depth_of_row = slots.find(names), numbers(group, "depth")

    def flat(column: str) -> np.ndarray:
        out = np.zeros(len(names), np.int64)
        out[slot] = numbers(group, column)
        return out

    conv, depth, count, chars = flat("conv_id"), flat("depth"), flat("n_convs"), flat("chars")
    children, leaves, saved = flat("from_children"), flat("from_leaves"), flat("from_saved")
    parent = np.full(len(names), -1, np.int64)
    parent[slot] = np.where(depth_of_row > 0, slots.find(parents), -1)
    inside = np.flatnonzero(parent >= 0)
    if (depth[parent[inside]] != depth[inside] - 1).any():
        raise ValueError("two prefixes share a name")
    children += np.bincount(parent[inside], minlength=len(names))
    leaves += children == 0
    saved += (count - 1) * chars
    order = inside[np.argsort(-depth[inside], kind="stable")]
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    up = parent[slot]
    columns = [group[c] for c in ("name0", "name1", "conv_id", "depth", "parent0", "parent1", "n_convs", "n_ends", "chars")]
    columns.append(pa.array(conv[np.maximum(up, 0)], mask=up < 0))
    columns += [pa.array(x[slot]) for x in (children, leaves, saved)]
    return pa.table([*columns, pa.array(up < 0)], schema=_FOLDED)


_FOLDED = pa.schema([(f.split()[0], pa.bool_() if f.split()[1] == "boolean" else pa.int64()) for f in FOLDED.split(", ")])


def _handed(tops: DataFrame) -> DataFrame:
    """What the topmost nodes of shards or bands hand to their parents."""
    return tops.where("is_top AND depth > 0").groupBy(F.col("parent0").alias("name0"), F.col("parent1").alias("name1")).agg(
        F.count("*").alias("from_children"), F.sum("n_leaves").alias("from_leaves"), F.sum("saved_tokens").alias("from_saved")
    )


def _ends(rows: DataFrame) -> DataFrame:
    """Per node: SHA-256 of the ids that end there, ascending, joined by commas.

    Ids are joined in chunks first; then a task takes the chunks of a node one after another.
    """
    import hashlib

    chunk = F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",")
    chunks = rows.where("depth = length").groupBy("name0", "name1", F.shiftright("conv_id", ENDS).alias("chunk")).agg(chunk.alias("ids"))

    def hashed(batches):
        open_, state, done = None, None, []
        for batch in batches:
            for a, b, ids in zip(*(batch[c].to_pylist() for c in ("name0", "name1", "ids"))):
                if (a, b) == open_:
                    state.update(b"," + ids.encode())
                    continue
                if open_:
                    done.append((*open_, state.hexdigest()))
                open_, state = (a, b), hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["name0", "name1", "ends_sha256"])
                done = []
        if open_:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*open_, state.hexdigest())], names=["name0", "name1", "ends_sha256"])

    return chunks.repartition("name0", "name1").sortWithinPartitions("name0", "name1", "chunk").mapInArrow(hashed, "name0 long, name1 long, ends_sha256 string")


def prefix_trie(
    turns: DataFrame, convs: DataFrame, light: int = LIGHT, band: int = BAND, rows: int = RANGE_ROWS
) -> DataFrame:
    """Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, n_ends, ends_sha256.

    turns: (conv_id, depth from 1, digest, chars, length); convs: (conv_id, length), both stored.
    """
    spark = turns.sparkSession
    named = running(turns, "conv_id", ["depth"], ["name0", "name1"], _steps, rows)
    named = named.select("conv_id", "depth", "name0", "name1", F.col("name0_before").alias("parent0"), F.col("name1_before").alias("parent1"), "chars", "length")
    zero = F.lit(0).cast("long")
    top = convs.select("conv_id", zero.alias("depth"), *(zero.alias(c) for c in ("name0", "name1", "parent0", "parent1", "chars")), "length")
    named = settled(named.unionAll(top), "named")

    same = F.lit(True)
    for c in ("depth", "parent0", "parent1", "chars"):
        same = same & (F.min(c) == F.max(c))
    depth = F.when(same, F.min("depth")).otherwise(F.raise_error(F.lit("two prefixes share a name")))
    nodes = named.groupBy("name0", "name1").agg(
        F.min("conv_id").alias("conv_id"), depth.alias("depth"), F.min("parent0").alias("parent0"), F.min("parent1").alias("parent1"),
        F.count("*").alias("n_convs"), F.sum((F.col("depth") == F.col("length")).cast("long")).alias("n_ends"), F.min("chars").alias("chars"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("turns_below"),
    )
    nodes = settled(nodes, "nodes")
    none = [zero.alias(c) for c in ("from_children", "from_leaves", "from_saved")]

    # light nodes: the subtree each belongs to is that of the topmost light node on its smallest member's path
    heavy = nodes.where(F.col("turns_below") > light)
    over = heavy.select(F.col("name0").alias("parent0"), F.col("name1").alias("parent1"), F.lit(True).alias("under_heavy"))
    lights = nodes.where(F.col("turns_below") <= light)
    tops = lights.join(over, ["parent0", "parent1"], "left").where("depth = 0 OR under_heavy").select("name0", "name1")
    subtree = named.join(tops, ["name0", "name1"]).select("conv_id", F.xxhash64("name0", "name1").alias("subtree"))
    size = lights.agg(F.count("*")).first()[0]
    shards = max(1, -(-size // light))
    dealt = lights.join(subtree, "conv_id").select(F.pmod("subtree", F.lit(shards)).alias("shard"), "*", *none)
    done = settled(dealt.groupBy("shard").applyInArrow(_folded, FOLDED), "folded")

    n_heavy = heavy.count()
    if n_heavy:
        order = settled(heavy.withColumn("up", -F.col("depth")).withColumn("all", zero), "heavy")
        ranked = settled(running(order, "all", ["up", "name0", "name1"], ["rank"], lambda t: [np.ones(t.num_rows, _U64)], rows), "ranked")
        for k in range(-(-n_heavy // band)):
            here = ranked.where((F.col("rank") > k * band) & (F.col("rank") <= (k + 1) * band))
            here = here.join(_handed(done), ["name0", "name1"], "left").fillna(0, ["from_children", "from_leaves", "from_saved"])
            folded = here.select(F.lit(k).alias("shard"), "*").groupBy("shard").applyInArrow(_folded, FOLDED)
            done = done.unionAll(settled(folded, "folded"))
    above = heavy.select(F.col("name0").alias("parent0"), F.col("name1").alias("parent1"), F.col("conv_id").alias("heavy_conv_id"))
    out = done.where("NOT is_top OR depth = 0").select("*", F.lit(None).cast("long").alias("heavy_conv_id"))
    out = out.unionByName(done.where("is_top AND depth > 0").join(above, ["parent0", "parent1"]))
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return out.join(_ends(named), ["name0", "name1"], "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "heavy_conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", empty).alias("ends_sha256"), "n_ends",
    )
