"""Toxicity by non-negative positive-unlabelled learning.

MEMBERS numpy classifiers are trained, each in a Spark task of its own, from the confirmed
toxic examples and a share of the unlabelled texts.  Labels of harmless texts are never used
to train.  The risk is that of positive-unlabelled learning corrected by the class prior:
prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)); while the second part
is negative, its own gradient is followed upwards.  The prior is the share of toxic rows
among the labelled rows that may be learned from.

Features are the words of a text (letters, digits and non-ASCII, A-Z lowered) and the first
4, 5 and 6 bytes of longer words, hashed, each also as "twice or more"; a classifier uses those
that the positives have significantly more or less often than the unlabelled texts.  The score is the logistic
function of the members' mean, so it is a probability of label 1.

Training reads at most POSITIVES and MEMBERS * UNLABELLED texts, picked by a seeded hash of
the id; scoring reads every whole text.  Null and empty texts have no feature and score as
the bias says.  Repeated ids count once for training and are scored row by row.  Conflicting
labels count as toxic.  Without a toxic example every text scores 0.  Only ids and texts are
read; other columns are carried along.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import unused
from .words import NORMAL, U64, Words, hashed_words, mixed, sliced

POSITIVES = 4000
UNLABELLED = 6000
MEMBERS = 4
BITS = 20
PREFIXES = (4, 5, 6)
SIGNIFICANT = 5.0
LEAST = 3
RIDGE = 3e-4
STEPS = 400
SEED = 29
SLICE = 1 << 20  # bytes of text whose features a task holds at a time
_VALUES = np.random.Generator(np.random.PCG64(41)).integers(1, 2**63, (max(PREFIXES), 256), dtype=np.uint64)


@dataclass(frozen=True)
class Classifier:
    features: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.features] = self.weights
        return out


def _features(words: Words) -> list[np.ndarray]:
    """Feature numbers of every word: of itself and of its prefixes; -1 where it has none."""
    shift = U64(64 - BITS)
    out = [(words.hashes >> shift).astype(np.int32)]
    length = words.ends - words.starts
    last = max(len(words.data) - 1, 0)
    sums = np.zeros(len(words.hashes), U64)
    for k in range(max(PREFIXES)):
        if len(sums):
            sums += _VALUES[k][words.data[np.minimum(words.starts + k, last)]]
        if k + 1 in PREFIXES:
            out.append(np.where(length > k + 1, (mixed(sums + U64(k)) >> shift).astype(np.int32), -1))
    return out


def _again(features: np.ndarray) -> np.ndarray:
    """The feature of occurring twice or more."""
    return (features * 0x9E3779B1 + 0x7F4A7C15) & ((1 << BITS) - 1)


def _with_again(chosen: np.ndarray) -> np.ndarray:
    """The chosen features and those whose second occurrence is chosen."""
    return chosen | chosen[_again(np.arange(1 << BITS))]


def _pairs(texts: pa.Array, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs; only of the chosen features, as _with_again gives them."""
    words = hashed_words(texts, table=NORMAL)
    text = words.text_of_word()
    found = []
    for numbers in _features(words):
        at = np.flatnonzero(numbers >= 0 if chosen is None else (numbers >= 0) & chosen[numbers])
        found.append(text[at] << BITS | numbers[at])
    both, times = np.unique(np.concatenate(found), return_counts=True)
    row, feature = both >> BITS, both & ((1 << BITS) - 1)
    more = times > 1
    return np.concatenate([row, row[more]]), np.concatenate([feature, _again(feature[more])])


def _parts(texts: pa.Array, rows: int = 500):
    """Slices of a sample, so that only one slice's features are held at a time."""
    return [(at, texts.slice(at, rows)) for at in range(0, len(texts), rows)]


def _documents_with(texts: pa.Array) -> np.ndarray:
    """The number of texts that have each feature."""
    out = np.zeros(1 << BITS, np.int64)
    for _, part in _parts(texts):
        out += np.bincount(_pairs(part)[1], minlength=1 << BITS)
    return out


def fit(positive: pa.Array, unlabelled: pa.Array, prior: float, steps: int = STEPS) -> Classifier:
    """One classifier by the non-negative risk, with full gradients (Adam)."""
    n_p, n_u = len(positive), len(unlabelled)
    in_p, in_u = (_documents_with(texts) for texts in (positive, unlabelled))
    rate = (in_p + in_u + 1) / (n_p + n_u + 2)
    z = (in_p - n_p * rate) / np.sqrt(n_p * rate * (1 - rate) + 1)
    chosen = np.flatnonzero((np.abs(z) >= SIGNIFICANT) & (in_p + in_u >= LEAST) & ((in_p >= LEAST) | (z < 0)))
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    wanted = _with_again(place >= 0)
    met = [(at + start, *_pairs(part, wanted)) for texts, at in ((positive, 0), (unlabelled, n_p)) for start, part in _parts(texts)]
    row = np.concatenate([np.empty(0, np.int64), *[start + r for start, r, _ in met]])
    column = place[np.concatenate([np.empty(0, np.int64), *[f for _, _, f in met]])]
    row, column = row[column >= 0], column[column >= 0]
    w = np.zeros(len(chosen) + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        logit = w[-1] + np.bincount(row, w[:-1][column], n_p + n_u)
        share = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        loss = np.logaddexp(0, logit)  # of calling a text harmless's opposite: log(1 + e^x)
        rest = loss[n_p:].mean() - prior * loss[:n_p].mean()
        g = np.zeros(n_p + n_u)
        if rest >= 0:
            g[:n_p] = prior * (share[:n_p] - 1) / n_p
            g[:n_p] -= prior * share[:n_p] / n_p
            g[n_p:] = share[n_p:] / n_u
        else:
            g[:n_p] = prior * share[:n_p] / n_p
            g[n_p:] = -share[n_p:] / n_u
        grad = np.append(np.bincount(column, g[row], len(chosen)), g.sum()) + RIDGE * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Classifier(chosen, w[:-1], float(w[-1]))


def learn(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Classifier:
    """Train from all rows of `labels` given and from texts of docs whose id may be learned from.

    labels must hold no row that is kept for testing.  Gives the mean of the members.
    """
    known = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(id).agg(F.max(label).alias("label"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum((F.col("label") == 1).cast("long")), F.lit(0))).first()
    if not toxic:
        return Classifier(np.empty(0, np.int64), np.empty(0), -30.0)
    prior = min(max(toxic / n, 1e-4), 0.9)
    order = F.xxhash64(F.lit(SEED), id)
    ids = docs.select(id).where(F.col(id).isNotNull()).distinct()
    positive = known.where("label = 1").select(id).orderBy(order, id).limit(POSITIVES).withColumn("member", F.lit(-1))
    rest = ids.orderBy(order, id).limit(MEMBERS * UNLABELLED)
    rest = rest.withColumn("member", F.pmod(F.xxhash64(F.lit(SEED + 1), id), F.lit(MEMBERS)).cast("int"))
    picked = docs.select(id, text).join(F.broadcast(positive.unionAll(rest)), id)  # at most POSITIVES + MEMBERS * UNLABELLED ids
    picked = picked.withColumn("positive", F.col("member") < 0).withColumn(
        "member", F.explode(F.when(F.col("member") < 0, F.sequence(F.lit(0), F.lit(MEMBERS - 1))).otherwise(F.array("member")))
    )

    def train(group: pd.DataFrame) -> pd.DataFrame:
        texts = group.drop_duplicates([text, "positive"])
        one = fit(pa.array(texts.loc[texts["positive"], text], pa.large_string()), pa.array(texts.loc[~texts["positive"], text], pa.large_string()), prior)
        return pd.DataFrame({"features": [one.features.tobytes()], "weights": [one.weights.tobytes()], "bias": [one.bias]})

    found = picked.select("member", "positive", text).groupBy("member").applyInPandas(train, "features binary, weights binary, bias double").collect()
    if not found:
        return Classifier(np.empty(0, np.int64), np.empty(0), -30.0)
    mean = np.zeros(1 << BITS)
    for r in found:
        mean[np.frombuffer(r["features"], np.int64)] += np.frombuffer(r["weights"]) / len(found)
    at = np.flatnonzero(mean)
    return Classifier(at, mean[at], float(np.mean([r["bias"] for r in found])))


def scored(df: DataFrame, model: Classifier, text: str = "text", score: str = "score", drop_text: bool = False) -> DataFrame:
    """df with the probability of label 1."""
    left = [f for f in df.schema.fields if not (drop_text and f.name == text)]
    schema = T.StructType([*left, T.StructField(score, T.DoubleType())])
    names = [f.name for f in left]

    def run(batches):
        table = model.table()
        wanted = _with_again(table != 0)
        for batch in sliced(batches, SLICE):
            row, feature = _pairs(batch.column(text), wanted)
            logit = model.bias + np.bincount(row, table[feature], batch.num_rows)
            share = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(share)], names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def learned_from(id: str = "doc_id", folds: int = 5) -> Column:
    """Rows whose labels may be learned from."""
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit(""))) % folds != 0


def drop_toxic(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, all columns unchanged."""
    model = learn(docs.where(learned_from(id)), labels.where(learned_from(id)), id, text)
    score = unused(docs, "__llm_score")
    return scored(docs, model, text, score).where(F.col(score) < threshold).drop(score)
