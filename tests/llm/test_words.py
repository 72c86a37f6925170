"""Word hashing against plain splitting."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from deskflow.llm import words as w

TEXTS = [
    "", None, " ", "one", "one two  one", "\t\na\x0bb\x0cc\rd ", "é é x y", "a" * 50, "x\x1cy z\x85",
    "Ärger ÄRGER aB AB", " lead", "trail ", "\n\n",
]


def split(text, lower=False):
    text = text or ""
    if lower:
        text = text.translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", text)


@pytest.mark.parametrize("block", [1, 3, 7, 1 << 20])
@pytest.mark.parametrize("lower", [False, True])
def test_words_of_texts(monkeypatch, block, lower):
    monkeypatch.setattr(w, "BLOCK", block)
    found = w.hashed_words(pa.array(TEXTS, pa.string()), lower)
    expected = [x for t in TEXTS for x in split(t, lower)]
    assert found.counts().tolist() == [len(split(t)) for t in TEXTS]
    assert [bytes(found.data[a:b]).decode() for a, b in zip(found.starts, found.ends)] == expected
    by_word = {}
    for word, h in zip(expected, found.hashes.tolist()):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_slices_and_nulls():
    texts = pa.array(["skip me", "a b", None, "c"]).slice(1)
    assert w.hashed_words(texts).counts().tolist() == [2, 0, 1]
    assert w.word_counts(texts).tolist() == [2, 0, 1]
    assert w.word_counts(pa.array([], pa.string())).tolist() == []
    assert w.hashed_words(pa.array([None, None], pa.string())).counts().tolist() == [0, 0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té", max_size=30), max_size=8))
def test_ngrams(texts):
    found = w.hashed_words(pa.array(texts, pa.string()))
    hashes, at = w.ngrams(found, 3)
    expected = {}
    flat = [x for t in texts for x in split(t)]
    places = [found.first[i] + k for i, t in enumerate(texts) for k in range(max(0, len(split(t)) - 2))]
    assert at.tolist() == places
    for h, p in zip(hashes.tolist(), places):
        assert expected.setdefault(tuple(flat[p : p + 3]), h) == h
    assert len(set(expected.values())) == len(expected)
    assert w.word_counts(pa.array(texts, pa.string())).tolist() == [len(split(t)) for t in texts]


def test_rolling_of_few_values():
    assert len(w.rolling(np.arange(3, dtype=np.uint64), 5, 12345)) == 0
