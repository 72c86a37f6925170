import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest

from deskflow.llm import near_dedup as nd
from deskflow.llm.components import components

LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows, width):
    """Least id that can be reached, per row (id, text)."""
    sets = [shingle_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (id, _) in enumerate(rows):
        least[root(i)].append(id)
    return [(len(sets[i]), min(x for x in least[root(i)])) for i in range(len(rows))]


def texts(rng, n, words=60, vocabulary=200):
    return [" ".join(rng.choice(["w", "V", "é"]) + str(rng.randrange(vocabulary)) for _ in range(words)) for _ in range(n)]


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("width", [2, 5])
def test_components_against_brute_force(spark, width):
    rng = random.Random(width)
    base = texts(rng, 30)
    rows = [*base, *base[:5], *[edited(rng, rng.choice(base), rng.randrange(1, 6)) for _ in range(80)]]
    hot = texts(rng, 1, 80)[0]
    rows += [edited(rng, hot, rng.randrange(1, 9)) for _ in range(60)]  # a group whose links are not complete
    rows += ["a", "A", "a b", None, "", " \n", "b", "a b c", "a b c d"]
    rng.shuffle(rows)
    data = [(3 * i + 1, t) for i, t in enumerate(rows)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(df, width=width).collect()}
    expected = brute(data, width)
    assert {i: e for (i, _), e in zip(data, expected)} == found


def test_values_that_many_texts_share_and_chains(spark):
    rng = random.Random(9)
    shared = texts(rng, 1, 50)[0]
    rows = [f"{shared} {x}" for x in texts(rng, 40, 60)]
    chain = texts(rng, 1, 120)[0].split()
    for k in range(12):  # each text is like the next one only
        rows.append(" ".join(chain[3 * k :] + [f"z{i}" for i in range(3 * k)]))
    data = list(enumerate(rows))
    df = spark.createDataFrame(data, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(df, width=2).collect()}
    assert found == {i: e for (i, _), e in zip(data, brute(data, 2))}


def test_many_chunks_of_one_value(spark, monkeypatch):
    for name in ("CHUNK", "HEADS", "CELL"):
        monkeypatch.setattr(nd, name, 2)
    rng = random.Random(10)
    hot = texts(rng, 1, 80)[0]
    rows = [edited(rng, hot, rng.randrange(1, 12)) for _ in range(70)] + texts(rng, 20, 60)
    data = list(enumerate(rows))
    found = nd.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), width=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {i: e for (i, _), e in zip(data, brute(data, 2))}


def test_pairs_of_heads_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nd, "HEADS", 3)
    heads = [(1, -1, c) for c in range(9)] + [(1, 5, c) for c in range(4)] + [(1, 8, 0), (2, -1, 0), (2, 7, 1)]
    n = {k: sum(h[0] == k for h in heads) for k in (1, 2)}
    found = nd._head_pairs(spark.createDataFrame([(*h, n[h[0]]) for h in heads], "key long, tag long, cut long, heads long")).collect()
    expected = {(k, (t, c), (u, d)) for k, t, c in heads for m, u, d in heads if k == m and (t, c) <= (u, d) and (t < 0 or t != u)}
    assert len(found) == len(expected) and {(r.key, tuple(r.x), tuple(r.y)) for r in found} == expected


def test_rows_that_stay(odd_wide, empty):
    kept = nd.drop_near_duplicates(odd_wide)
    assert kept.columns == odd_wide.columns
    rows = kept.collect()
    # of the three equal texts the first id stays, of the two "word" rows the one with an id
    assert sorted((r.doc_id for r in rows if r.text), key=str) == [1, 5, 6, 7, 8]
    assert sum(not (r.text or "").strip() for r in rows) == 4  # texts without words are linked with nothing
    assert nd.drop_near_duplicates(empty).count() == 0
    assert nd.near_duplicates(empty).count() == 0


def test_signatures_estimate_similarity():
    rng = random.Random(2)
    a = texts(rng, 1, 400)[0]
    both = pa.array([a, edited(rng, a, 20), a.upper(), texts(rng, 1, 400)[0]])
    hashes, first = nd.shingles(both, 2)
    s = nd._signatures(hashes, first)
    exact = len(shingle_set(both[0].as_py(), 2) & shingle_set(both[1].as_py(), 2)) / len(shingle_set(both[0].as_py(), 2) | shingle_set(both[1].as_py(), 2))
    assert abs((s[0] == s[1]).mean() - exact) < 0.25
    assert (s[0] == s[3]).mean() < 0.4


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 1), (9, 8), (5, 5), (20, 7), (7, 20), *[(100 + i, 101 + i) for i in range(40)], *[(300, 301 + i) for i in range(50)]]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {
        1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 7: 7, 20: 7, **{100 + i: 100 for i in range(41)}, **{300 + i: 300 for i in range(51)},
    }
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sets_are_written_for_candidates_only(spark, monkeypatch):
    rng = random.Random(11)
    shared = texts(rng, 1, 50)[0]
    rows = [f"{shared} {x}" for x in texts(rng, 20, 60)]  # values in common, but no candidates
    rows.append(edited(rng, rows[0], 1))
    wanted, real = [], nd._stored_sets

    def noted(df, of, *args):
        wanted.extend(r.doc_id for r in of.collect())
        return real(df, of, *args)

    monkeypatch.setattr(nd, "_stored_sets", noted)
    data = list(enumerate(rows))
    found = nd.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), width=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {i: e for (i, _), e in zip(data, brute(data, 2))}
    assert sorted(wanted) == [0, 20]
