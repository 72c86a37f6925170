"""Token ids of whole texts by a vocabulary file of the tokenizers library.

For the lower-casing word vocabulary the ids of a text are those of its words one after
another, so words are looked up in a bounded dictionary of each worker, and only new ones
are given to the library: plain words to its BPE model in the pieces its own pre-tokenizer
would make, all others to the whole tokenizer.  Any other file is applied to whole texts.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa

from .words import sliced, text_bytes

WORDS_KEPT = 400_000

# How the word vocabulary normalises and splits (its file says so).
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level BPE writes bytes with: printable ones stay, others follow 255."""
    stay = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in stay]
    return {b: chr(256 + k) for k, b in enumerate(others)}


class Recent(dict):
    """A bounded dictionary that makes what it lacks; what was not asked for lately is forgotten."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.half, self.old = make, size // 2, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


def word_ids(tokenizer) -> Recent:
    """Ids (little-endian, unsigned, 32 bits) of words without white space."""
    letters, model = _byte_letters(), tokenizer.model

    def of_piece(piece: str) -> bytes:
        ids = [t.id for t in model.tokenize(piece.encode().decode("latin-1").translate(letters))]
        return pack(f"<{len(ids)}I", *ids)

    def of_word(word: bytes) -> bytes:
        text = word.decode()
        if PLAIN.fullmatch(text) and "<|" not in text:
            parts = PIECES.findall(text.lower())
            # pieces are looked up as words, so "end" and the one in "end." are one entry
            return of_piece(parts[0]) if len(parts) == 1 else b"".join([known[p.encode()] for p in parts])
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    known = Recent(of_word, WORDS_KEPT)
    return known


@lru_cache(2)
def _opened(path: str):
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    tokenizer = Tokenizer.from_file(path)
    steps = content.get("pre_tokenizer") or {}
    split = (steps.get("pretokenizers") or [{}])[0]
    by_word = content.get("normalizer") == WORD_NORMALIZER and split.get("pattern") == {"Regex": WORD_SPLIT} and split.get("invert")
    return tokenizer, word_ids(tokenizer) if by_word else None


def _lowered(text: bytes) -> bytes:
    """A-Z lowered, so that "The" and "the" are one entry; not where marks of special tokens may stand, which are told by case."""
    return text if b"<|" in text else text.lower()


def token_ids(texts: pa.Array, path: str, end: int | None) -> list[bytes]:
    """Ids of each text as bytes; a null is empty.  `end`: an id that closes each text."""
    tokenizer, words = _opened(path)
    close = b"" if end is None else np.array([end], "<u4").tobytes()
    data, offsets = text_bytes(texts)
    view, at = memoryview(data), offsets.tolist()
    if words is not None:
        return [b"".join(map(words.__getitem__, _lowered(bytes(view[a:b])).split())) + close for a, b in zip(at, at[1:])]
    return [np.array(tokenizer.encode(str(view[a:b], "utf-8"), add_special_tokens=False).ids, "<u4").tobytes() + close for a, b in zip(at, at[1:])]


def pieces(df, path: str, id: str, text: str, end: int | None, capacity: int):
    """Rows (id, piece, start, length, ids): texts cut into pieces of `capacity` ids, the last may be shorter."""
    from pyspark.sql import types as T

    schema = T.StructType([
        T.StructField(id, df.schema[id].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])

    def cut(batches):
        for batch in sliced(batches, 4 << 20):
            ids = token_ids(batch.column(1), path, end)
            row, piece, out = [], [], []
            for i, x in enumerate(ids):
                for k in range(0, max(len(x), 1), 4 * capacity):
                    row.append(i)
                    piece.append(k // (4 * capacity))
                    out.append(x[k : k + 4 * capacity])
            number = np.array(piece, np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(row, pa.int64())), pa.array(number.astype(np.int32)), pa.array(number * capacity),
                pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary()),
            ], names=schema.fieldNames())

    return df.select(id, text).mapInArrow(cut, schema)
