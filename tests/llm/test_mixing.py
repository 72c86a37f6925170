import random
import re
from collections import defaultdict

import numpy as np
import pytest

from deskflow.llm.mixing import fit_counts, mix, mixture


def targets(sizes, repeats=3):
    """By the words of the contract: share by weight, stop at the limit, share the excess again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in full]
        left, w = total - sum(full.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w >= repeats * sizes[s]]
        if not over:
            return full | {s: left * weight[s] / w for s in free}
        full |= {s: repeats * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(6))
def test_knapsack_reaches_the_budget(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(1, 400, 60))
    counts = rng.integers(1, 30, len(lengths))
    total = int((lengths * counts).sum())
    for budget in (0, 1, total // 7, total // 2, total - 1, total, total + 5):
        take = fit_counts(lengths, counts, budget, seed, dp_budget=500)
        assert (take >= 0).all() and (take <= counts).all()
        missed = abs(min(budget, total) - int((lengths * take).sum()))
        assert missed <= (0 if 400 < budget < total - 400 or budget >= total else int(lengths[0]))


def test_knapsack_is_optimal_when_small():
    rng = random.Random(4)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(2, 30), 4)))
        counts = np.array([rng.randrange(1, 4) for _ in lengths])
        sums = {0}
        for step, n in zip(lengths.tolist(), counts.tolist()):
            sums = {x + k * step for x in sums for k in range(n + 1)}
        budget = rng.randrange(0, int((lengths * counts).sum()) + 1)
        from deskflow.llm.mixing import _knapsack

        take = _knapsack(lengths, counts, budget, np.arange(4))
        assert int((take * lengths).sum()) == max(x for x in sums if x <= budget)


def test_mix_against_brute_force_targets(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(rng.choice([1, 3, 7, 20, rng.randrange(200)]))), rng.choice(["b", "a", "B", "é", None, *["hot"] * 8, "zz"])) for i in range(1200)]
    rows += [(5000, None, "a"), (5001, "", "void"), (5002, "only one", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    found = mix(df).collect()
    assert sorted(map(str, found)) == sorted(map(str, mix(df).collect()))  # reruns agree
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in found:
        assert r.taken == r.size * r.times and 0 <= r.times <= 3
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", next(t for i, t, _ in rows if i == r.doc_id) or ""))
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    for s, expected in targets(dict(sizes)).items():
        assert abs(target[s] - expected) < 1e-6 * max(1, expected)
        assert abs(taken[s] - expected) <= 1
    assert all(r.source_size == sizes[r.source] for r in found)


def test_rows_of_the_mixture(odd_wide, empty):
    done = mixture(odd_wide)
    assert done.columns == odd_wide.columns
    times = defaultdict(int)
    for r in mix(odd_wide).collect():
        times[(r.doc_id, r.source)] += r.times if r["size"] else 1
    got = defaultdict(int)
    for r in done.collect():
        got[(r.doc_id, r.source)] += 1
    assert got == {k: v for k, v in times.items() if v}
    assert mix(empty).count() == 0 and mixture(empty).count() == 0
