import math
import random
import re
from collections import Counter, defaultdict

import pytest

from deskflow.llm import language_model as lm


def tokens(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), None]


class Brute:
    def __init__(self, texts):
        rows = [tokens(t) for t in texts]
        self.c1 = Counter(w for t in rows for w in t)
        self.c2 = Counter(p for t in rows for p in zip(["<s>", *t[:-1]], t))
        self.n, self.v = sum(self.c1.values()), len(self.c1)
        self.before, self.after, self.total = Counter(b for _, b in self.c2), defaultdict(lambda: [0, 0, 0]), Counter()
        for (a, _), n in self.c2.items():
            self.after[a][min(n, 3) - 1] += 1
            self.total[a] += n
        self.d2, self.d1 = (self.discounts(c.values()) for c in (self.c2, self.before))

    @staticmethod
    def discounts(counts):
        n = [sum(1 for x in counts if x == i) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        raw = [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else i / 2 for i in (1, 2, 3)]
        return [0, *(min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw))]

    def low(self, w):
        if not self.c2:
            return 1 / (self.v + 1)
        rest = sum(self.d1[min(n, 3)] for n in self.before.values()) / len(self.c2)
        return (self.before[w] - self.d1[min(self.before[w], 3)]) / len(self.c2) + rest / (self.v + 1)

    def p(self, a, w):
        if a not in self.total:
            return self.low(w)
        rest = sum(n * d for n, d in zip(self.after[a], self.d2[1:])) / self.total[a]
        return (self.c2[a, w] - self.d2[min(self.c2[a, w], 3)]) / self.total[a] + rest * self.low(w)

    def score(self, text):
        t = tokens(text)
        base = sum(math.log10((self.c1[w] + 1) / (self.n + self.v + 1)) for w in t)
        return len(t), sum(self.c1[w] > 0 for w in t), base, sum(math.log10(self.p(a, w)) for a, w in zip(["<s>", *t[:-1]], t))


@pytest.mark.parametrize("shard_bytes", [1 << 24, 512])
def test_against_brute_force(spark, shard_bytes):
    rng = random.Random(6)
    text = lambda: rng.choice(["", " "]) + " ".join(rng.choice(["the", "The", "of", "é", f"w{rng.randrange(60)}"]) for _ in range(rng.randrange(40)))
    train = [*(text() for _ in range(150)), None, "", "the of " * 300]  # a pair that is counted beyond 255
    scored = [*train, *(f"{text()} unseen words here {text()}" for _ in range(30))]
    model = lm.train(spark.createDataFrame([(t,) for t in train], "text string").repartition(4), shard_bytes=shard_bytes)
    brute = Brute(train)
    assert (model.tokens, model.kinds, model.pairs, model.texts) == (brute.n, brute.v, len(brute.c2), len(train))
    for a in ("<s>", "the", "w1"):
        assert abs(sum(brute.p(a, w) for w in [*brute.c1, "never seen"]) - 1) < 1e-9
    df = spark.createDataFrame(list(enumerate(scored)), "doc_id long, text string").repartition(3)
    for r in lm.score(df, model).collect():
        n, known, base, score = brute.score(scored[r.doc_id])
        assert (r.n_tokens, r.n_known) == (n, known)
        assert abs(r.base_score - base) < 1e-8 and abs(r.score - score) < 1e-8


def test_odd_and_empty_tables(odd_wide, empty):
    model = lm.train(empty)
    assert (model.tokens, model.kinds) == (0, 0)
    rows = lm.score(odd_wide, model).collect()
    assert len(rows) == odd_wide.count() and all(r.score == 0 == r.base_score and r.n_known == 0 for r in rows)
    model = lm.train(odd_wide)
    rows = lm.score(odd_wide, model, keep=("lang",)).collect()
    assert all(math.isfinite(r.score) and r.score < 0 and r.n_known == r.n_tokens for r in rows)
    assert lm.score(empty, model).count() == 0
