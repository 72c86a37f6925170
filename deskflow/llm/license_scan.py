"""Licence scan: ordered signature rules behind a keyword gate.

Texts are normalised to words of [0-9a-z] and non-ASCII bytes (A-Z lowered).  A rule runs
only over texts that hold one of its gate words; whatever it matches holds one.  Detections are intervals of words; they are taken
by priority, then length, then place, and one is dropped when it lies within the interval of
one that was taken before it, or overlaps one of higher priority.

Base phrases are searched apart from the rules, and their labels always stay.
Null and empty texts have no words and no labels.  An empty table gives an empty result.
Repeated rows are scanned one by one; other columns of the input are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .license_rules import STRENGTH, Rule, build_rules
from .words import NORMAL, sliced, text_bytes

# Fixed values of the contract.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@lru_cache(1)
def numbered_rules() -> list[Rule]:
    return build_rules()


@lru_cache(1)
def gated_rules() -> dict[bytes, list[int]]:
    """Numbers of the rules behind each gate."""
    gates: dict[bytes, list[int]] = {}
    for k, rule in enumerate(numbered_rules()):
        for gate in rule.gates:
            gates.setdefault(gate.encode(), []).append(k)
    return gates


_BASE = [(f" {phrase} ".encode(), label) for phrase, label in BASE_PHRASES.items()]
_BASE_GATES = (b"license", b"cc")


def _spaces(joined: bytes) -> np.ndarray:
    return np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)


def base_places(joined: bytes) -> list[dict]:
    found, spaces = [], None
    for phrase, label in _BASE:
        starts, at = [], joined.find(phrase)
        while at >= 0:
            starts.append(at)
            at = joined.find(phrase, at + 1)
        if starts:
            spaces = _spaces(joined) if spaces is None else spaces
            found += [(word, label) for word in np.searchsorted(spaces, starts).tolist()]
    return [{"label": label, "word": word} for word, label in sorted(found)]


def _united(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint intervals that cover the same places, in order."""
    order = np.argsort(starts, kind="stable")
    starts, upto = starts[order], np.maximum.accumulate(ends[order])
    first = np.append(True, starts[1:] > upto[:-1])
    return starts[first], upto[np.append(first[1:], True)]


def _unsuppressed(matches: list[tuple[int, int, int, Rule]]) -> list[tuple[int, int, int, Rule]]:
    """Matches (priority, start, end, rule) that stay, by sweeps over sorted intervals.

    One priority after the other, highest first: what overlaps the union of all taken before
    goes, then what lies within another interval of its own priority (of equal intervals, the
    first by name stays).
    """
    taken: list[tuple[int, int, int, Rule]] = []
    for priority in sorted({m[0] for m in matches}, reverse=True):
        here = [m for m in matches if m[0] == priority]
        if taken:
            low, high = _united(*np.array([m[1:3] for m in taken], np.int64).T)
            starts, ends = np.array([m[1:3] for m in here], np.int64).T
            # the last interval that begins before a match ends is the only one that can reach farthest into it
            before = np.searchsorted(low, ends) - 1
            free = (before < 0) | (high[before] <= starts)
            here = [m for m, f in zip(here, free.tolist()) if f]
        here.sort(key=lambda m: (m[1], -m[2], m[3].name))
        upto = -1
        for m in here:
            if m[2] > upto:
                taken.append(m)
                upto = m[2]
    return taken


def detections(joined: bytes, words: set[bytes]) -> list[dict]:
    """What stays of all rule matches after suppression, in order of place."""
    gates, rules, matches = gated_rules(), numbered_rules(), []
    for k in {k for gate in gates.keys() & words for k in gates[gate]}:
        rule = rules[k]
        matches += [(rule.priority, m.start(), m.end(), rule) for m in rule.pattern.finditer(joined)]
    if not matches:
        return []
    taken = sorted(_unsuppressed(matches), key=lambda m: (m[1], m[2], m[3].name))
    spaces = _spaces(joined)
    starts = np.searchsorted(spaces, [a - 1 for _, a, _, _ in taken]).tolist()
    ends = np.searchsorted(spaces, [b for _, _, b, _ in taken]).tolist()
    return [
        {"rule": rule.name, "label": rule.label, "start": start, "end": end, "strength": STRENGTH[priority]}
        for (priority, _, _, rule), start, end in zip(taken, starts, ends)
    ]


PLACE = T.StructType([T.StructField("label", T.StringType()), T.StructField("word", T.LongType())])
FOUND = T.StructType([
    T.StructField("rule", T.StringType()), T.StructField("label", T.StringType()), T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()), T.StructField("strength", T.DoubleType()),
])
_PLACE = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
_FOUND = pa.list_(pa.struct([("rule", pa.string()), ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("strength", pa.float64())]))


def scan(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_words, base (label, word), found (rule, label, start, end, strength)."""
    schema = T.StructType([
        T.StructField(id, df.schema[id].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("base", T.ArrayType(PLACE)), T.StructField("found", T.ArrayType(FOUND)),
    ])

    def run(batches):
        for batch in sliced(batches):
            data, offsets = text_bytes(batch.column(1))
            data = NORMAL[data]
            word = data != 32
            begins = word.copy()
            begins[1:] &= ~word[:-1]
            first = offsets[:-1][np.diff(offsets) > 0]
            begins[first] = word[first]
            counts = np.zeros(batch.num_rows, np.int64)
            counts[np.diff(offsets) > 0] = np.add.reduceat(begins, first, dtype=np.int64) if len(first) else []
            view, at = memoryview(data), offsets.tolist()
            base, found = [], []
            for a, b in zip(at, at[1:]):
                words = bytes(view[a:b]).split()
                have = set(words)
                gated = not have.isdisjoint(gated_rules())
                if not gated and have.isdisjoint(_BASE_GATES):
                    base.append([])
                    found.append([])
                    continue
                joined = b" " + b" ".join(words) + b" "
                base.append(base_places(joined))
                found.append(detections(joined, have) if gated else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(base, _PLACE), pa.array(found, _FOUND)],
                names=[f.name for f in schema.fields],
            )

    return df.select(id, text).mapInArrow(run, schema)
