"""Byte-level BPE: exact ids of whole texts by a file of ranks, and back.

The file holds a token and its rank per line; the rank is both the token's id and its place
in the order of merges.  Each match of the splitting pattern is encoded by itself: one that is
a token as a whole gets that token, as the ranks' own library does; any other one is covered
from its end to its start.  An Aho-Corasick automaton over all tokens, their bytes written as
Latin-1 letters, names the longest token that ends at each place.  The search takes the
longest one that is compatible with the token to its right, falls back to its longest proper
suffix that is a token, and where none is left gives the place up for good and takes the
neighbour back.  Two tokens are compatible if the merges leave them apart when they stand side
by side; a text's encoding is the only sequence of tokens with compatible neighbours, so the
search ends at exactly what the merges give, and each place is given up at most once: linear
time.  Compatibility is worked out by undoing the merges at the seam, the latest first, and
kept per pair of tokens; the ids of short matches are kept too, both in bounded tables.

Null and empty texts have no ids and decode to no bytes.  A long text is split a megabyte at a
time, at spaces between two ASCII words, where the pattern always begins a match.  Repeated
rows are encoded like any others, an empty table gives an empty result, and no columns but
those asked for are read.  Bytes that are no UTF-8 are read as U+FFFD.  Ids that the file does
not hold can't be decoded: an error.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tokens import Recent
from .words import sliced, text_bytes

SLICE = 4 << 20
SEGMENT = 1 << 20
KEPT_LENGTH = 48
PAIRS_KEPT = 1_000_000
MATCHES_KEPT = 300_000
CUT = regex.compile(rb"[!-~](?= [!-~])")
_ID = np.dtype("<u4")


class Merges:
    """Tokens by rank, how each one was last merged, and what follows from that."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.base = max(self.tokens) + 1
        self.merged: dict[int, int] = {}  # left * base + right -> the token they merge to
        self.halves = {rank: (rank, rank) for token, rank in ranks.items() if len(token) == 1}
        self.compatible = Recent(self._compatible, PAIRS_KEPT)
        for rank in sorted(self.tokens):
            if rank not in self.halves:
                self._learn(rank)
        self.automaton = ahocorasick.Automaton()
        for rank in self.halves:
            self.automaton.add_word(self.tokens[rank].decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.length = [len(self.tokens.get(rank, b"")) for rank in range(self.base)]
        self.shorter = [self._suffix(self.tokens[rank]) if rank in self.halves else -1 for rank in range(self.base)]

    def _learn(self, rank: int) -> None:
        """Find the two tokens that the merges of lower rank make of a token."""
        token = self.tokens[rank]
        for at in range(1, len(token)):
            left, right = self.ranks.get(token[:at]), self.ranks.get(token[at:])
            if left in self.halves and right in self.halves and self._compatible(left * self.base + right):
                self.halves[rank] = left, right
                self.merged[left * self.base + right] = rank
                return
        if self.by_merging(token) == [rank]:
            raise ValueError(f"token {rank} is merged from tokens of a higher rank")

    def by_merging(self, data: bytes) -> list[int]:
        """The definition: merge the pair of the lowest rank, the first of equals, until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            found = [(self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ranks]
            if not found:
                break
            at = min(found)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _compatible(self, pair: int) -> bool:
        left, right = divmod(pair, self.base)
        before = self.base  # merges across the seam of a rank below this one would have come first
        while True:
            if self.merged.get(left * self.base + right, self.base) < before:
                return False
            (_, inner_left), (inner_right, _) = self.halves[left], self.halves[right]
            whole_left, whole_right = inner_left == left, inner_right == right
            if whole_left and whole_right:
                return True
            # of two equal ranks the left one was merged first, so the right one is undone first
            if whole_right or (not whole_left and left > right):
                left, before = inner_left, left
            else:
                right, before = inner_right, right + 1

    def _suffix(self, token: bytes) -> int:
        """The longest proper suffix that is a token, or -1."""
        for at in range(1, len(token)):
            rank = self.ranks.get(token[at:])
            if rank in self.halves:
                return rank
        return -1

    def encode(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        # of the tokens that end at a place the longest comes first, so it is the last one written
        longest = dict([*self.automaton.iter(data.decode("latin-1"))][::-1])
        dead: set[int] = set()
        length, shorter, compatible, base = self.length, self.shorter, self.compatible, self.base
        out: list[int] = []
        last = len(data) - 1  # the place of the last byte not covered yet
        token = longest[last]
        while last >= 0:
            while token >= 0:
                before = last - length[token]
                if before not in dead and (not out or compatible[token * base + out[-1]]):
                    out.append(token)
                    last = before
                    token = longest.get(last, -1)
                    break
                token = shorter[token]
            else:
                dead.add(last)
                token = out.pop()
                last += length[token]
        out.reverse()
        return out


class Matches(Recent):
    """Ids (little-endian, unsigned, 32 bits) of matches; long ones are not kept."""

    def __missing__(self, match: str) -> bytes:
        return super().__missing__(match) if len(match) <= KEPT_LENGTH else self.make(match)


@lru_cache(2)
def _opened(path: str) -> Merges:
    with open(path, "rb") as file:
        return Merges({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)})


@lru_cache(2)
def _matches(path: str, pattern: str) -> tuple[Matches, regex.Pattern]:
    merges = _opened(path)
    return Matches(lambda match: np.array(merges.encode(match.encode()), _ID).tobytes(), MATCHES_KEPT), regex.compile(pattern)


def _segments(data: bytes, size: int):
    at = 0
    while at < len(data):
        cut = CUT.search(data, at + size) if len(data) - at > size else None
        end = cut.end() if cut else len(data)
        yield data[at:end].decode("utf-8", "replace")
        at = end


def token_ids(data: bytes, path: str, pattern: str, segment: int = SEGMENT) -> bytes:
    """Ids of one text as bytes."""
    known, split = _matches(path, pattern)
    return b"".join(b"".join(map(known.__getitem__, split.findall(part))) for part in _segments(data, segment))


def encode(df: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, ids): the ids of each whole text, as an array."""
    schema = T.StructType([T.StructField(id, df.schema[id].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for batch in sliced(batches, SLICE):
            data, offsets = text_bytes(batch.column(1))
            whole, at = memoryview(data), offsets.tolist()
            ids = [token_ids(bytes(whole[a:b]), path, pattern) for a, b in zip(at, at[1:])]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), _ID).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=schema.fieldNames())

    return df.select(id, text).mapInArrow(run, schema)


@lru_cache(2)
def _spelled(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes in a row; where each id's bytes begin, and how many they are (-1: no such id)."""
    tokens = _opened(path).tokens
    length = np.full(max(tokens) + 1, -1, np.int64)
    for rank, token in tokens.items():
        length[rank] = len(token)
    held = np.maximum(length, 0)
    return np.frombuffer(b"".join(tokens[rank] for rank in sorted(tokens)), np.uint8), np.cumsum(held) - held, length


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """All columns but `ids`, and the bytes that the ids spell in `into`; null ids spell none."""
    names = [c for c in df.columns if c not in (ids, into)]
    schema = T.StructType([*[df.schema[c] for c in names], T.StructField(into, T.BinaryType())])

    def run(batches):
        spelled, begin, length = _spelled(path)
        for batch in sliced(batches, SLICE):
            lists = batch.column(len(names)).cast(pa.large_list(pa.int32()))
            counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            flat = lists.flatten()
            numbers = flat.to_numpy(zero_copy_only=False)
            if flat.null_count or len(numbers) and (numbers.min() < 0 or numbers.max() >= len(length) or length[numbers].min() < 0):
                raise ValueError("an id that the file of ranks does not hold")
            n = length[numbers]
            ends = np.concatenate([[0], np.cumsum(n)])
            places = np.repeat(begin[numbers] - ends[:-1], n) + np.arange(ends[-1])
            edges = ends[np.concatenate([[0], np.cumsum(counts)])]
            texts = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), batch.num_rows, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(spelled[places]))]
            )
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], texts.cast(pa.binary())], names=schema.fieldNames())

    return df.select(*names, ids).mapInArrow(run, schema)
