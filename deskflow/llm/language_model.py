"""Interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted arrays.

Tokens are the words of a text with A-Z lowered, then one end; null and empty texts are one
end.  Training takes two counting passes:

1. words: each task sends its distinct word hashes with counts to shards that are ranges of
   the hash; a shard's sorted array gives every word a number (its rank);
2. bigrams: pairs of numbers with counts go to shards cut along both words, so that a word
   which precedes or follows a third of all others is spread; a shard keeps a sorted array of
   pairs and their counts.  What the model needs of each word as context (pairs seen once,
   twice, more often) and as continuation (distinct words before it) is summed per block of
   word numbers.

Only sums (counts of counts, totals) reach the driver.  Arrays lie in the shared folder and
are memory-mapped by the workers that score; the probability of a pair is put together from
counts as it is looked up.  Shards grow in number with the text, not in size.

The discounts follow from the counts of counts of each order and are held within
(0.05, i - 0.05) for small corpora.  The lowest order is mixed with a uniform distribution
over all known tokens and one unknown, so unknown words have a share too and the
probabilities over all tokens sum to one.  Without training texts every token has
probability 1.  Repeated rows count as often as they occur.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import load_array, new_folder, packed, save_array, unpacked
from .words import hashed_words, sliced

SHARD_BYTES = 16 << 20
FLUSH = 4 << 20
BLOCK = 1 << 18
END, START, FIRST = 0, 1, 2  # numbers of the two marks and of the first word
MANY = 255  # counts from here on are kept apart
_U64 = np.uint64


@dataclass(frozen=True)
class Model:
    folder: str
    shards: int
    cuts: int
    offsets: tuple[int, ...]
    texts: int
    tokens: int
    kinds: int
    pairs: int
    discounts: tuple[float, float, float]
    low_discounts: tuple[float, float, float]
    low_rest: float


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of things seen once, twice, three and four times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    out = []
    for i in (1, 2, 3):
        d = i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else i / 2
        out.append(min(max(d, 0.05), i - 0.05))
    return out[0], out[1], out[2]


def _discount(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _word_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Edges of the shards in sorted hashes: shard s is hashes[edge[s]:edge[s + 1]]."""
    edges = [(s << 64) // shards for s in range(shards)]
    return np.append(np.searchsorted(hashes, np.array(edges, _U64)), len(hashes))


def _count_words(df: DataFrame, text: str, folder: str, shards: int) -> list[tuple[int, int, int]]:
    def partials(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out():
            if not held:
                return
            keys, counts = _summed(*map(np.concatenate, zip(*held)))
            held.clear()
            edge = _word_shard(keys, shards)
            for s in range(shards):
                a, b = edge[s], edge[s + 1]
                if b > a:
                    yield pa.RecordBatch.from_pydict({
                        "shard": pa.array([s], pa.int64()), "keys": pa.array([packed(keys[a:b])], pa.binary()),
                        "counts": pa.array([counts[a:b].tobytes()], pa.binary()),
                    })

        for batch in sliced(batches):
            keys, counts = np.unique(hashed_words(batch.column(0), lower=True).hashes, return_counts=True)
            held.append((keys, counts))
            if sum(len(k) for k, _ in held) >= FLUSH:
                yield from out()
        yield from out()

    def build(group: pa.Table) -> pa.Table:
        keys = np.concatenate([unpacked(x.as_py()) for x in group["keys"]])
        counts = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in group["counts"]])
        keys, counts = _summed(keys, counts)
        shard = group["shard"][0].as_py()
        save_array(folder, f"words-{shard}", keys)
        save_array(folder, f"counts-{shard}", counts)
        return pa.table({"shard": pa.array([shard], pa.int64()), "n": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64())})

    done = df.select(text).mapInArrow(partials, "shard long, keys binary, counts binary").groupBy("shard").applyInArrow(build, "shard long, n long, total long")
    return [tuple(r) for r in done.collect()]


@dataclass
class _Tokens:
    """Distinct words of a slice (sorted by hash) and where they stand in it.

    number, count: per distinct word, then of the end and the start.  previous, current:
    per token, as indices into these.  first: where each text's tokens begin.
    """

    number: np.ndarray
    count: np.ndarray
    previous: np.ndarray
    current: np.ndarray
    first: np.ndarray


def _tokens(texts: pa.Array, folder: str, shards: int, offsets: tuple[int, ...], n_texts: int) -> _Tokens:
    words = hashed_words(texts, lower=True)
    known, place = np.unique(words.hashes, return_inverse=True)
    number, count = np.full(len(known) + 2, -1, np.int64), np.zeros(len(known) + 2, np.int64)
    edge = _word_shard(known, shards)
    for s in range(shards):
        have = load_array(folder, f"words-{s}", np.uint64)
        a, b = edge[s], edge[s + 1]
        if b > a and len(have):
            at = np.minimum(np.searchsorted(have, known[a:b]), len(have) - 1)
            hit = np.flatnonzero(have[at] == known[a:b])
            number[a + hit] = FIRST + offsets[s] + at[hit]
            count[a + hit] = load_array(folder, f"counts-{s}", np.int64)[at[hit]]
    number[-2:], count[-2:] = (END, START), (n_texts, n_texts)
    n = len(words.first) - 1
    first = words.first + np.arange(n + 1)
    current = np.full(len(words.hashes) + n, len(known), np.int64)
    current[np.arange(len(words.hashes)) + words.text_of_word()] = place
    previous = np.empty_like(current)
    previous[1:] = current[:-1]
    previous[first[:-1]] = len(known) + 1
    return _Tokens(number, count, previous, current, first)


def _pair_keys(v: np.ndarray, w: np.ndarray, cuts: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each pair of word numbers and its key within it."""
    return (v % cuts) * cuts + w % cuts, (v // cuts).astype(np.uint64) << _U64(32) | (w // cuts).astype(np.uint64)


def _in_shards(shard: np.ndarray, key: np.ndarray, cuts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by shard and key, and where each shard begins in it."""
    order = np.argsort(key)
    order = order[np.argsort(shard[order].astype(np.uint16 if cuts < 256 else np.int64), kind="stable")]
    return order, np.searchsorted(shard[order], np.arange(cuts * cuts + 1))


def _count_pairs(df: DataFrame, text: str, folder: str, shards: int, cuts: int, offsets: tuple[int, ...], n_texts: int):
    def partials(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out():
            if not held:
                return
            shard, key = map(np.concatenate, zip(*held))
            held.clear()
            order, at = _in_shards(shard, key, cuts)
            for s in range(cuts * cuts):
                if at[s + 1] > at[s]:
                    keys, counts = np.unique(key[order[at[s] : at[s + 1]]], return_counts=True)
                    yield pa.RecordBatch.from_pydict({
                        "shard": pa.array([s], pa.int64()), "keys": pa.array([packed(keys)], pa.binary()),
                        "counts": pa.array([counts.astype(np.uint32).tobytes()], pa.binary()),
                    })

        for batch in sliced(batches):
            t = _tokens(batch.column(0), folder, shards, offsets, n_texts)
            held.append(_pair_keys(t.number[t.previous], t.number[t.current], cuts))
            if sum(len(k) for k, _ in held) >= FLUSH:
                yield from out()
        yield from out()

    def build(group: pa.Table) -> pa.Table:
        keys = np.concatenate([unpacked(x.as_py()) for x in group["keys"]])
        counts = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in group["counts"]]).astype(np.int64)
        keys, counts = _summed(keys, counts)
        shard = group["shard"][0].as_py()
        save_array(folder, f"pairs-{shard}", keys)
        save_array(folder, f"times-{shard}", np.minimum(counts, MANY).astype(np.uint8))
        many = np.flatnonzero(counts >= MANY)
        save_array(folder, f"many-{shard}", many)
        save_array(folder, f"many-times-{shard}", counts[many])
        v = (keys >> _U64(32)).astype(np.int64) * cuts + shard // cuts
        w = np.sort((keys & _U64(0xFFFFFFFF)).astype(np.int64)) * cuts + shard % cuts
        rows = []
        for kind, of in enumerate((v[counts == 1], v[counts == 2], v[counts > 2], w)):
            number, n = np.unique(of, return_counts=True)
            block = number // BLOCK
            for b in np.unique(block):
                mine = block == b
                rows.append((int(b), kind, packed(number[mine].astype(np.uint64)), n[mine].astype(np.uint32).tobytes()))
        size = [int((counts == i).sum()) for i in (1, 2, 3, 4)]
        rows.append((-1, 0, np.array([*size, len(keys)], np.int64).tobytes(), b""))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["block", "kind", "numbers", "n"])

    def gather(group: pa.Table) -> pa.Table:
        block = group["block"][0].as_py()
        if block < 0:
            sums = sum(np.frombuffer(x.as_py(), np.int64) for x in group["numbers"])
            return _sums(0, sums)
        out = np.zeros((4, BLOCK), np.uint32)
        for kind, numbers, n in zip(group["kind"], group["numbers"], group["n"]):
            out[kind.as_py(), unpacked(numbers.as_py()).astype(np.int64) - block * BLOCK] += np.frombuffer(n.as_py(), np.uint32)
        save_array(folder, f"block-{block}", out)
        before = out[3]
        return _sums(1, [int((before == i).sum()) for i in (1, 2, 3, 4)] + [int((before > 2).sum())])

    def _sums(low: int, values) -> pa.Table:
        return pa.table([pa.array([int(x)], pa.int64()) for x in (low, *values)], names=["low", "n1", "n2", "n3", "n4", "n"])

    rows = df.select(text).mapInArrow(partials, "shard long, keys binary, counts binary").groupBy("shard").applyInArrow(build, "block long, kind long, numbers binary, n binary")
    # sums of all shards are a row each; the group of block -1 holds one small row per shard
    rows = rows.groupBy("block").applyInArrow(gather, "low long, n1 long, n2 long, n3 long, n4 long, n long")
    found = {r[0]: list(r[1:]) for r in rows.groupBy("low").sum("n1", "n2", "n3", "n4", "n").collect()}
    return found.get(0, [0] * 5), found.get(1, [0] * 5)


def train(df: DataFrame, text: str = "text", shard_bytes: int = SHARD_BYTES) -> Model:
    folder = new_folder(df.sparkSession, "model")
    size, n_texts = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)), F.count("*")).first()
    shards = max(1, -(-size // shard_bytes))
    cuts = int(np.ceil(np.sqrt(shards)))
    n, total = np.zeros(shards, np.int64), 0
    for shard, kinds, tokens in _count_words(df, text, folder, shards):
        n[shard] = kinds
        total += tokens
    offsets = tuple(int(x) for x in np.cumsum(n) - n)
    kinds = int(n.sum()) + (n_texts > 0)
    high, low = _count_pairs(df, text, folder, shards, cuts, offsets, n_texts)
    d, pairs = discounts(high[:4]), high[4]
    low_d = discounts(low[:4])
    rest = (low_d[0] * low[0] + low_d[1] * low[1] + low_d[2] * low[4]) / pairs if pairs else 1.0
    return Model(folder, shards, cuts, offsets, n_texts, total + n_texts, kinds, pairs, d, low_d, rest)


def _times(model: Model, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """How often each pair of word numbers was seen; 0 where one is unknown."""
    out = np.zeros(len(v), np.int64)
    both = np.flatnonzero((v >= 0) & (w >= 0))
    shard, key = _pair_keys(v[both], w[both], model.cuts)
    order, at = _in_shards(shard, key, model.cuts)
    for s in range(model.cuts**2):
        mine = order[at[s] : at[s + 1]]
        have = load_array(model.folder, f"pairs-{s}", np.uint64)
        if len(mine) and len(have):
            place = np.minimum(np.searchsorted(have, key[mine]), len(have) - 1)
            hit = have[place] == key[mine]
            mine, place = mine[hit], place[hit]
            n = load_array(model.folder, f"times-{s}", np.uint8)[place].astype(np.int64)
            many = np.flatnonzero(n == MANY)
            if len(many):
                found = np.searchsorted(load_array(model.folder, f"many-{s}", np.int64), place[many])
                n[many] = load_array(model.folder, f"many-times-{s}", np.int64)[found]
            out[both[mine]] = n
    return out


def _word_statistics(model: Model, number: np.ndarray) -> np.ndarray:
    """Pairs after each word seen once, twice, more often, and distinct words before it: 4 x words."""
    out = np.zeros((4, len(number)), np.int64)
    block = number // BLOCK
    for b in np.unique(block[number >= 0]):
        table = load_array(model.folder, f"block-{b}", np.uint32)
        if len(table):
            mine = np.flatnonzero(block == b)
            out[:, mine] = table.reshape(4, BLOCK)[:, number[mine] - b * BLOCK]
    return out


def score(df: DataFrame, model: Model, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, `keep`, n_tokens, n_known, base_score (add-one unigrams), score; both log10 of the whole text."""
    names = [id, *keep]
    schema = T.StructType([*[df.schema[c] for c in names], *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")],
                           *[T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]])

    def run(batches):
        for batch in sliced(batches):
            t = _tokens(batch.column(len(names)), model.folder, model.shards, model.offsets, model.texts)
            stats = _word_statistics(model, t.number)
            uniform = 1 / (model.kinds + 1)
            low = model.low_rest * uniform
            if model.pairs:
                low = low + (stats[3] - _discount(stats[3], model.low_discounts)) / model.pairs
            low = np.broadcast_to(low, len(t.number))
            seen = np.maximum(t.count, 1)
            rest = np.where(t.count > 0, np.array(model.discounts) @ stats[:3] / seen, 1.0)
            times = _times(model, t.number[t.previous], t.number[t.current])
            p = (times - _discount(times, model.discounts)) / seen[t.previous] + rest[t.previous] * low[t.current]
            base = np.log10((t.count + 1) / (model.tokens + model.kinds + 1))
            first = t.first[:-1]
            sums = [np.add.reduceat(x, first) for x in ((t.count > 0)[t.current].astype(np.int64), base[t.current], np.log10(p))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], *[pa.array(x) for x in (np.diff(t.first), *sums)]], names=schema.fieldNames()
            )

    return df.select(*names, text).mapInArrow(run, schema)
