import random

import numpy as np
import pyarrow as pa

from deskflow.llm import toxicity as tx


def corpus(rng, n, share=0.15):
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 120))]
        toxic = rng.random() < share
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(["Nasty!", "vile,", "grubble" + rng.choice("abcdefghij")])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(random.Random(5), 3000)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(5)
    labels = docs.select("doc_id", "toxic").where("doc_id % 3 = 0")
    model = tx.learn(docs.where(tx.learned_from()), labels.where(tx.learned_from()))
    held = tx.scored(docs.where(~tx.learned_from()), model).collect()
    caught = [r.score >= 0.5 for r in held if r.toxic]
    wrong = [r.score >= 0.5 for r in held if not r.toxic]
    assert np.mean(caught) > 0.9 and np.mean(wrong) < 0.01
    assert all(0 <= r.score <= 1 for r in held)


def test_risk_is_held_above_zero():
    rng = random.Random(1)
    rows = corpus(rng, 600, 0.3)
    positive = pa.array([t for _, t, toxic in rows if toxic])
    unlabelled = pa.array([t for _, t, _ in rows])
    model = tx.fit(positive, unlabelled, 0.3)
    row, feature = tx._pairs(unlabelled)
    logit = model.bias + np.bincount(row, model.table()[feature], len(rows))
    prior, toxic = 0.3, np.array([x for _, _, x in rows]) == 1
    loss = np.logaddexp(0, logit)
    assert loss.mean() - prior * loss[toxic].mean() > -0.05
    assert (logit[toxic] > 0).mean() > 0.9 and (logit[~toxic] > 0).mean() < 0.02


def test_features_of_inflected_words():
    a, b = ({int(f) for f in tx._pairs(pa.array([t]))[1]} for t in ("grubblex", "Grubbley."))
    assert len(a & b) == len(tx.PREFIXES)
    once, twice = (len(tx._pairs(pa.array([t]))[1]) for t in ("abc", "abc abc abc"))
    assert (once, twice) == (1, 2)


def test_odd_rows(spark, odd_wide, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (5, 0), (6, 0), (99, 1)], "doc_id long, toxic int")
    model = tx.learn(odd_wide, labels)
    rows = tx.scored(odd_wide, model, score="p").collect()
    assert len(rows) == odd_wide.count() and all(0 <= r.p <= 1 for r in rows)
    kept = tx.drop_toxic(odd_wide, labels)
    assert kept.columns == odd_wide.columns
    none = tx.learn(odd_wide, labels.limit(0))
    assert all(r.p < 1e-6 for r in tx.scored(odd_wide, none, score="p").collect())
    assert tx.scored(empty, none).count() == 0 and tx.drop_toxic(empty, labels).count() == 0
    assert tx.drop_toxic(odd_wide, labels.limit(0)).count() == odd_wide.count()
