import math
import random

import numpy as np
import pytest

from deskflow.functions import fixed_values as fv
from deskflow.operators import retrieval as r

WORDS = ["app", "crash", "login", "refund", "song", "can't", "premium", "account", "the", "of", "ok"]


def lexical_brute(queries, corpus, k):
    stop = set(fv.STOP_WORDS)
    words = lambda t: [w for w in (t or "").split() if len(w) > 2 and w not in stop]
    out = []
    for q, text in queries:
        asked = set(words(text))
        scored = []
        for d, doc in corpus:
            dt = words(doc)
            hit = sum(w in asked for w in dt)
            if hit:
                scored.append((-hit / math.sqrt(len(asked) * len(dt)), d))
        out += [(q, rk, d, -s) for rk, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def texts(n, seed, hot=0.0):
    """Random word lists; a share of them starts with one and the same word."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        body = [rng.choice(WORDS) for _ in range(rng.randint(0, 8))]
        rows.append((i * 7 + 1, " ".join((["hotword"] if rng.random() < hot else []) + body) or None))
    return rows


@pytest.mark.parametrize("blocks", [(1024, 2048), (7, 11), (1, 1000)])
def test_lexical_topk_matches_brute_force(spark, blocks):
    q, c = texts(40, 1), texts(150, 2, hot=0.5)
    qdf, cdf = (spark.createDataFrame(x, "id bigint, text string") for x in (q, c))
    got = r.lexical_topk(qdf, cdf, 3, query_rows=blocks[0], corpus_rows=blocks[1]).collect()
    expected = lexical_brute(q, c, 3)
    assert sorted((x.query_id, x.rk, x.corpus_id) for x in got) == [e[:3] for e in expected]
    assert [x.score for x in sorted(got)] == [e[3] for e in expected]


def test_one_word_and_one_text_in_a_third_of_all_rows(spark):
    q = [(i, "hotword login") for i in range(300)]
    c = [(i, "hotword hotword" if i % 3 == 0 else f"hotword login word{i}") for i in range(900)]
    qdf, cdf = (spark.createDataFrame(x, "id bigint, text string") for x in (q, c))
    got = r.lexical_topk(qdf, cdf, 4, query_rows=64, corpus_rows=100).collect()
    assert len(got) == 1200
    # 2 / sqrt(2 * 2) for the copies beats 2 / sqrt(2 * 3); equal scores rank by id.
    assert {(x.rk, x.corpus_id) for x in got} == {(1, 0), (2, 3), (3, 6), (4, 9)}


def test_lexical_topk_without_matches(spark):
    qdf = spark.createDataFrame([(1, "the of"), (2, "xyz")], "id bigint, text string")
    cdf = spark.createDataFrame([(1, "app crash"), (2, "")], "id bigint, text string")
    assert r.lexical_topk(qdf, cdf).collect() == []
    assert r.lexical_topk(qdf, cdf.where("id < 0")).collect() == []


@pytest.mark.parametrize("blocks", [(1024, 8192), (6, 13)])
def test_dense_topk_matches_brute_force(spark, blocks):
    rng = np.random.default_rng(3)
    c = rng.normal(size=(120, 8)).astype("float32")
    c[50:60] = c[0]  # copies: equal scores
    c[7] = 0
    q = np.vstack([rng.normal(size=(20, 8)), np.zeros((1, 8)), c[:1]]).astype("float32")
    frame = lambda m: spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(m)], "id bigint, embedding array<float>")
    got = r.dense_topk(frame(q), frame(c), 4, query_rows=blocks[0], corpus_rows=blocks[1]).collect()
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
    s = np.round(unit(q.astype(float)) @ unit(c.astype(float)).T, 9)
    expected = [(i, rk, int(d)) for i, row in enumerate(s) for rk, d in enumerate(np.lexsort((np.arange(120), -row))[:4], 1)]
    assert sorted((x.query_id, x.rk, x.corpus_id) for x in got) == expected
    assert [x.score for x in sorted(got)] == pytest.approx([s[a, d] for a, _, d in expected], abs=1e-9)
    top = r.dense_top1(frame(q), frame(c)).collect()
    assert {x.query_id: x.top_score for x in top} == pytest.approx({i: row.max() for i, row in enumerate(s)}, abs=1e-9)


def test_fewer_rows_than_k_and_null_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, 1.0])], "id bigint, embedding array<float>")
    got = r.dense_topk(df, df, 5).orderBy("query_id", "rk").collect()
    assert [(x.query_id, x.corpus_id) for x in got] == [(1, 1), (1, 3), (3, 3), (3, 1)]


def test_l2_normalize(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [x.u for x in df.select(r.l2_normalize(F.col("v")).alias("u")).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_plan_has_no_cross_join_and_no_broadcast(spark):
    df = spark.createDataFrame([(1, "app crash")], "id bigint, text string")
    plan = r.lexical_topk(df, df)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
    for operator in ["CartesianProduct", "BroadcastNestedLoopJoin", "BroadcastExchange"]:
        assert operator not in plan


def test_unusable_vectors_change_nothing(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [1.0, i / 10, 0.5]) for i in range(6)]
    bad = [(20, [nan, 1.0, 0.0]), (21, [inf, 0.0, 0.0]), (22, [None, 1.0, 1.0]), (23, None), (24, [nan] * 3)]
    kind = "id long, embedding array<float>"
    queries = spark.createDataFrame([(100, [1.0, 0.2, 0.5]), (101, [nan, 0.0, 1.0])], kind)
    clean = r.dense_topk(queries, spark.createDataFrame(good, kind), 3).collect()
    mixed = r.dense_topk(queries, spark.createDataFrame(good + bad, kind), 3).collect()
    assert len(clean) == 3 and sorted(map(tuple, clean)) == sorted(map(tuple, mixed))


def test_memory_of_a_vector_cell_is_bounded():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)
    side = lambda name, n: pa.table({name: pa.array(range(n)), "payload": pa.array(list(rng.normal(size=(n, 4)).astype("float32")))})
    q, c = side("query_id", 2048), side("corpus_id", r.VECTOR_BLOCK)
    score = r._vector_cell(3)
    tracemalloc.start()
    try:
        found = score(q, c)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found.num_rows == 3 * 2048 and peak < 32 << 20
