import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from deskflow.llm.ordered import running
from deskflow.llm.prefix_trie import Slots, prefix_trie, spliced, turns_of, whole
from deskflow.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def conversations(rows):
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    return {c: tuple((r, t) for *_, r, t in sorted(v)) for c, v in by.items()}


def rebuilt(rows):
    own = conversations(rows)
    heads = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, ())[: heads[c]] + own[c][heads[c] :] for c in own}


def brute(convs):
    members, children = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        kids = children[p]
        leaves[p] = sum(leaves[k] for k in kids) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in kids)
        if p:
            children[p[:-1]].append(p)
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), parent, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def told(df):
    return sorted((tuple(r)[:8] for r in df.collect()), key=lambda r: r[:2])


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(QUERIES["op12_prefix_trie"](spark, sf)) == brute(rebuilt(rows))


def test_small_shards_bands_and_ranges(spark):
    """Many shards, several bands of heavy nodes, one conversation with a third of all turns, a crowd of copies."""
    rows = [(1, i, "user", f"long {i % 7}") for i in range(90)]
    rows += [(1 + k, i, "user", f"long {i % 7}") for k in (50, 60) for i in range(40)]
    rows += [(200 + k, i, ("user", "assistant")[i % 2], f"é copy {i}") for k in range(40) for i in range(3)]
    rows += [(400 + k, 0, "user", "") for k in range(30)] + [(400 + k, 1, "user", f"own {k % 9}") for k in range(30)]
    rows += [(500, 3, None, None)] * 80 + [(None, 1, "user", "none")] * 3 + [(501, None, "user", "first"), (501, -5, "user", "second"), (-3, 1, "user", "x")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("place", F.lit("clash")).withColumn("length", F.lit(1)).withColumn("name0", F.lit(2))
    turns = turns_of(df, 60)
    assert told(prefix_trie(*whole(turns), light=50, band=25, rows=60)) == brute(conversations(rows))
    c = F.col("conv_id")
    parts = spliced(turns, c - c % 100, F.crc32(c.cast("string")) % 6, 5)
    want = conversations(rows)
    heads = {k: zlib.crc32(str(k).encode()) % 6 for k in want}
    base = {k: int(np.fmod(k, 100)) for k in want}
    want = {k: want.get(k - base[k], ())[: heads[k]] + want[k][heads[k] :] for k in want}
    assert told(prefix_trie(*parts, light=50, band=25, rows=60)) == brute(want)


def test_empty_and_turnless(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert told(prefix_trie(*whole(turns_of(empty)))) == []
    rows = spark.createDataFrame([(7, 1, "user", "a")], SCHEMA)
    done = told(prefix_trie(*spliced(turns_of(rows), F.lit(0).cast("long"), F.lit(3), 5)))
    assert done == [(7, 0, None, 1, 0, 1, 0, hashlib.sha256(b"7").hexdigest())]


def test_slots():
    names = np.random.default_rng(1).integers(0, 2**63, (5000, 2), dtype=np.uint64)
    slots = Slots(names[:4000])
    assert sorted(slots.find(names[:4000])) == list(range(4000))
    assert (slots.find(names[4000:]) == -1).all()
    with pytest.raises(ValueError):
        Slots(names[[0, 0]])


def test_running(spark):
    rows = [(k, i, (k * 7 + i) % 5) for k, n in ((1, 300), (2, 1), (5, 40), (6, 0), (9, 77)) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, i long, v long").repartition(5)
    done = running(df, "k", ["i"], ["s"], lambda t: [t["v"].to_numpy().astype(np.uint64) + np.uint64(2**63)], 30).collect()
    sums = collections.Counter()
    for k, i, v in sorted(rows):
        before, sums[k] = sums[k], (sums[k] + v + 2**63) % 2**64
        row = next(r for r in done if (r.k, r.i) == (k, i))
        assert (row.s_before % 2**64, row.s % 2**64) == (before, sums[k])
