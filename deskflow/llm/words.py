"""Words of whole texts as 64-bit hashes, computed for whole Arrow batches at once.

A word is a maximal run of bytes other than space and 0x09-0x0D.  Its hash is a
polynomial over its bytes modulo 2**64 (a prefix sum over the batch, rebased to the
start of each word), then mixed.  Nothing depends on a word's place, so equal words
have equal hashes in every batch, task and run.

Nulls and empty texts have no words.  A text of any length is worked off in blocks of
256 KB that end between words, so memory follows the batch, not the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK = 1 << 18
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Lower-case letters, digits and non-ASCII bytes; everything else is a space.
NORMAL = np.full(256, 32, np.uint8)
NORMAL[48:58] = np.arange(48, 58)
NORMAL[65:91] = np.arange(97, 123)
NORMAL[97:123] = np.arange(97, 123)
NORMAL[128:] = np.arange(128, 256)
_BYTE_BASE = 0x9E3779B97F4A7C15
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of every bit over all bits (a bijection)."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse modulo 2**64, kept per worker."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK + 1)
        both = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, U64)
            p[0] = 1
            both.append(np.cumprod(p))
        have = _tables[base] = (both[0], both[1])
    return have[0][:n], have[1][:n]


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes of all windows of `width` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    power, inverse = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * power[:-1], out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * inverse[:n])


@dataclass
class Words:
    """hashes: all words of a batch in order; first[i]:first[i + 1] are those of text i.

    starts and ends are byte positions in `data`, the batch's text bytes as hashed.
    """

    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the n + 1 offsets of its texts; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def hashed_words(texts: pa.Array, lower: bool = False, table: np.ndarray | None = None) -> Words:
    """Hash every word of every text, with A-Z lowered or bytes exchanged by a table first if asked."""
    data, offsets = text_bytes(texts)
    if lower:
        data = LOWER[data]
    if table is not None:
        data = table[data]
    hashes, starts, ends = [], [], []
    bounds = offsets[:-1]
    a = 0
    while a < len(data):
        b = min(a + BLOCK, len(data))
        if b < len(data):
            b = _cut(data, bounds, a, b)
        piece = data[a:b]
        space = SPACES[piece]
        word = ~space
        apart = space.copy()
        apart[:-1] = space[1:]
        apart[-1] = True
        inner = bounds[np.searchsorted(bounds, a, "right") : np.searchsorted(bounds, b)] - a
        before = np.ones(len(piece), bool)
        before[1:] = space[:-1]
        before[inner] = True
        apart[inner - 1] = True
        s, e = np.flatnonzero(word & before), np.flatnonzero(word & apart) + 1
        power, inverse = powers(_BYTE_BASE, len(piece) + 1)
        sums = np.zeros(len(piece) + 1, U64)
        np.cumsum(_BYTE_VALUES[piece] * power[:-1], out=sums[1:])
        hashes.append(mixed((sums[e] - sums[s]) * inverse[s]))
        starts.append(s + a)
        ends.append(e + a)
        a = b
    whole = [np.concatenate(x) if x else np.empty(0, kind) for x, kind in ((hashes, U64), (starts, np.int64), (ends, np.int64))]
    return Words(whole[0], np.searchsorted(whole[1], offsets), whole[1], whole[2], data)


def _cut(data: np.ndarray, bounds: np.ndarray, a: int, b: int) -> int:
    """The last place in (a, b] that lies between two words, or else the first one after b."""
    k = np.searchsorted(bounds, b, "right") - 1
    at = int(bounds[k]) if k >= 0 else 0
    found = np.flatnonzero(SPACES[data[a:b]])
    best = max(at, a + int(found[-1]) if len(found) else 0)
    if best > a:
        return best
    step = b
    limit = int(bounds[k + 1]) if k + 1 < len(bounds) else len(data)
    while step < limit:
        found = np.flatnonzero(SPACES[data[step : step + BLOCK]])
        if len(found):
            return min(step + int(found[0]), limit)
        step += BLOCK
    return limit


def ngrams(words: Words, width: int, base: int = 0xD1B54A32D192ED03) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams that lie in one text, and the place of each one's first word."""
    windows = rolling(words.hashes, width, base)
    if not len(windows):
        return windows, np.empty(0, np.int64)
    left = np.repeat(words.first[1:], words.counts())[: len(windows)]
    inside = np.flatnonzero(np.arange(width, width + len(windows)) <= left)
    return windows[inside], inside


def sliced(batches: Iterator[pa.RecordBatch], size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into pieces of at most about `size` bytes (a row is never cut)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = max(1, batch.num_rows * size // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()  # a worker stays for the next stage, what it freed does not


def word_counts(texts: pa.Array) -> np.ndarray:
    """Words of each text."""
    data, offsets = text_bytes(texts)
    begins = ~SPACES[data]
    inner = offsets[:-1][np.diff(offsets) > 0]
    at_start = begins[inner]
    begins[1:] &= SPACES[data[:-1]]
    begins[inner] = at_start
    out = np.zeros(len(offsets) - 1, np.int64)
    if len(inner):
        out[np.diff(offsets) > 0] = np.add.reduceat(begins, inner, dtype=np.int64)
    return out
