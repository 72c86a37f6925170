import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from deskflow.functions.text import keyword_flag
from deskflow.operators import sweeps as s
from deskflow.plans.calibration import recalibrated_run
from deskflow.sources.config import GateConfig

CFG = GateConfig(2.0, -1.5, 0.1, 0.5)


@pytest.fixture(scope="module")
def tickets(spark):
    rng = random.Random(4)
    number = lambda: rng.choice([round(rng.random(), 2), 0.7, 0.5, None, float("nan")])
    texts = [rng.choice(["hi", "hacked", "hello", None, "fine"]) for _ in range(700)]
    rows = [
        (i, t, number(), number(), rng.random() < 0.1, rng.random() < (0.9 if t == "hacked" else 0.06))
        for i, t in enumerate(texts)
    ]
    cols = "tweet_id int, text string, confidence double, retrieval_score double, llm_risk boolean, true_escalate boolean"
    return spark.createDataFrame(rows, cols), rows


def below(x, t):
    return x is not None and x < t  # False for NaN


def score(c, r):
    if c is None or r is None or math.isnan(c) or math.isnan(r):
        return float("nan")
    return 1 / (1 + math.exp(-(CFG.w_confidence * c + CFG.w_retrieval * r + CFG.intercept)))


def rates(rows, escalates):
    auto = [r for r in rows if not escalates(r)]
    miss, risks = sum(r[5] for r in auto), sum(r[5] for r in rows)
    return len(auto) / len(rows), miss / len(auto) if auto else 0.0, miss / risks if risks else 0.0


def test_operating_curve_matches_brute_force(tickets):
    df, rows = tickets
    got = s.operating_curve(df, CFG).orderBy("threshold").collect()
    assert len(got) == 19
    for row, t in zip(got, np.arange(0.05, 0.96, 0.05)):
        a, v, r = rates(rows, lambda x: score(x[2], x[3]) >= t or x[1] == "hacked")
        assert (row.threshold, row.auto_handle_rate, row.volume_false_auto, row.risk_miss_rate) == pytest.approx(
            (round(t, 2), a, v, r), abs=6e-5
        )
    assert [r.auto_handle_rate for r in got] == sorted(r.auto_handle_rate for r in got)


def test_gate_grid_matches_brute_force(tickets):
    df, rows = tickets
    got = {(r.conf_thresh, r.ret_thresh): r for r in s.gate_grid(df).collect()}
    assert len(got) == 90
    for c in np.arange(0.50, 0.96, 0.05):
        for ret in np.arange(0.20, 0.61, 0.05):
            expected = rates(rows, lambda x: below(x[2], c) or below(x[3], ret) or x[1] == "hacked" or x[4])
            row = got[(round(c, 2), round(ret, 2))]
            assert (row.auto_handle_rate, row.volume_false_auto, row.risk_miss_rate) == pytest.approx(expected, abs=6e-5)


def test_choose_threshold_matches_brute_force(tickets):
    df, rows = tickets
    steps = [round(t, 2) for t in np.arange(0.05, 0.96, 0.05)]
    at = {t: rates(rows, lambda x, t=t: score(x[2], x[3]) >= t or x[1] == "hacked" or x[4]) for t in steps}
    allowed = [t for t in steps if at[t][2] <= 0.25]
    chosen = max(allowed, key=lambda t: (at[t][0], -t))
    best = (chosen, at[chosen][0], at[chosen][2])
    row = s.choose_threshold(df, CFG).first()
    assert tuple(row) == pytest.approx(best, abs=6e-5)


def test_choose_threshold_default(spark):
    df = spark.createDataFrame(
        [("hi", 0.0, 1.0, False, True)],
        "text string, confidence double, retrieval_score double, llm_risk boolean, true_escalate boolean",
    )
    assert tuple(s.choose_threshold(df, GateConfig(0.0, 0.0, -5.0, 0.5)).first()) == (0.5, 0.0, 1.0)


def test_best_gates(tickets):
    df, _ = tickets
    grid = s.gate_grid(df)
    top = s.best_gates(grid, 3).collect()
    allowed = sorted(
        (r for r in grid.collect() if r.risk_miss_rate <= 0.25),
        key=lambda r: (-r.auto_handle_rate, r.conf_thresh, r.ret_thresh),
    )
    assert top == allowed[:3]


def test_fine_curve_uses_decimal_thresholds(spark):
    # 0.37 as a decimal, not as an accumulated sum.
    df = spark.createDataFrame(
        [("hi", 0.0, 0.0, True)], "text string, confidence double, retrieval_score double, true_escalate boolean"
    )
    z = math.log(0.37 / 0.63)
    got = {
        r.threshold: r.auto_handle_rate
        for r in s.operating_curve(df, GateConfig(0.0, 0.0, z, 0.5), s.fine_thresholds(), 4).collect()
    }
    assert len(got) == 91 and got[0.37] == 0.0 and got[0.38] == 1.0


def test_fit_matches_newton(spark):
    rng = np.random.default_rng(0)
    x = rng.random((300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-(3 * x[:, 0] - 4 * x[:, 1])))).astype(float)
    df = spark.createDataFrame(
        [(float(a), float(b), bool(c)) for (a, b), c in zip(x, y)],
        "confidence double, retrieval_score double, true_escalate boolean",
    )
    got = s.fit_gate(df)
    n, pos = len(y), y.sum()
    w = np.where(y == 1, n / (2 * pos), n / (2 * (n - pos)))
    a, beta = np.column_stack([x, np.ones(n)]), np.zeros(3)
    ridge = np.diag([1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ beta))
        grad = a.T @ (w * (p - y)) + ridge @ beta
        beta -= np.linalg.solve(a.T @ (a * (w * p * (1 - p))[:, None]) + ridge, grad)
    assert [got.w_confidence, got.w_retrieval, got.intercept] == pytest.approx(list(beta), abs=1e-5)


def test_fit_does_not_depend_on_partitions_and_ends_at_the_optimum(tickets):
    df, _ = tickets
    one, many = s.fit_gate(df.repartition(1)), s.fit_gate(df.repartition(17))
    at = np.array([one.w_confidence, one.w_retrieval, one.intercept])
    assert at == pytest.approx([many.w_confidence, many.w_retrieval, many.intercept], abs=1e-9)
    rows = df.selectExpr("confidence", "retrieval_score", "CAST(true_escalate AS DOUBLE) AS label").na.drop()
    n, positive = rows.agg(F.count("*"), F.sum("label")).first()
    weights = n / (2 * (n - positive)), n / (2 * positive)
    sums = s.gate_sums(rows, weights, at)
    assert np.abs([sums.g0 + at[0], sums.g1 + at[1], sums.g2]).max() < 1e-6 * n
    loss = lambda w: s.gate_sums(rows, weights, w).loss + 0.5 * (w[:2] ** 2).sum()
    assert all(loss(at) <= loss(at + d) for d in np.vstack([np.eye(3), -np.eye(3)]) * 0.01)


def test_fit_of_separated_classes(spark):
    rows = [(float(i >= 40) * 1000, 0.5, i >= 40) for i in range(80)]  # steps without halving run off
    got = s.fit_gate(spark.createDataFrame(rows, "confidence double, retrieval_score double, true_escalate boolean"))
    assert all(map(np.isfinite, (got.w_confidence, got.w_retrieval, got.intercept))) and got.w_confidence > 0


def test_fit_needs_both_classes(spark):
    df = spark.createDataFrame([(0.1, 0.2, True)], "confidence double, retrieval_score double, true_escalate boolean")
    with pytest.raises(ValueError):
        s.fit_gate(df)


def test_recalibration_loop(tickets):
    df, _ = tickets
    cfg, run = recalibrated_run(df)
    best = s.choose_threshold(df, cfg).first()
    assert cfg.prob_thresh == best.prob_thresh
    codes = {r.reason_code for r in run.select("reason_code").distinct().collect()}
    assert "keyword" in codes and run.count() == 700
    assert df.select(keyword_flag(df.text).alias("k")).where("k").count() == run.where("reason_code = 'keyword'").count()
