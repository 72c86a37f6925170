import random
import re
from collections import Counter

import numpy as np

from deskflow.llm import substring_dedup
from deskflow.llm.substring_dedup import remove_repeated_windows


def brute(texts, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \n ", "a", "a b c d", "a b c d", "a b c d e"]
    texts += [rng.choice(["", " ", "\n"]).join(rng.choice(["x", "y z ", "é\t", "Q "]) for _ in range(rng.randrange(60))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for width in (3, 8):
        rows = {r.doc_id: r for r in remove_repeated_windows(df, width=width, shard_bytes=256).collect()}
        for i, expected in enumerate(brute(texts, width)):
            assert (rows[i].n_words, rows[i].n_removed, rows[i].kept_text) == expected
            spans = [tuple(s) for s in rows[i].spans]
            assert sum(b - a for a, b in spans) == rows[i].n_removed
            assert all(a >= d for (a, _), (_, d) in zip(spans[1:], spans))


def test_neighbouring_texts_share_no_interval(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "q")], "doc_id long, text string").coalesce(1)
    rows = {r.doc_id: r for r in remove_repeated_windows(df, width=3).collect()}
    assert [tuple(s) for s in rows[1].spans] == [(0, 3)] == [tuple(s) for s in rows[2].spans]
    assert rows[3].kept_text == "q" and rows[3].spans == []


def test_odd_rows(odd_wide, empty):
    rows = remove_repeated_windows(odd_wide, width=3).collect()
    assert len(rows) == odd_wide.count()
    long = next(r for r in rows if r.doc_id == 7)
    assert long.n_removed == 5000 and long.kept_text == ""
    assert next(r for r in rows if r.doc_id == 3).kept_text == ""
    assert remove_repeated_windows(empty).count() == 0


def test_only_shards_that_are_met_are_opened(tmp_path, monkeypatch):
    opened = []

    def load(folder, name, dtype):
        opened.append(name)
        return np.empty(0, dtype)

    monkeypatch.setattr(substring_dedup, "load_array", load)
    hashes = np.arange(20, dtype=np.uint64)
    assert not substring_dedup._repeated(hashes, str(tmp_path), 100_000).any()
    assert 0 < len(set(opened)) == len(opened) <= 20
    assert not len(substring_dedup._repeated(hashes[:0], str(tmp_path), 7))
