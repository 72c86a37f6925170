import random

import pandas as pd
import pytest

from deskflow.operators import metrics as m

LABELS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(1)
    rows = [
        (i, "a" if rng.random() < 0.6 else rng.choice(LABELS), rng.choice([*LABELS, "error"]),
         rng.random() < 0.3, rng.random() < 0.5, round(rng.random(), 2))
        for i in range(500)
    ]
    cols = ["tweet_id", "true_intent", "pred_intent", "true_escalate", "pred_escalate", "confidence"]
    return spark.createDataFrame(rows, cols), pd.DataFrame(rows, columns=cols)


def f1(t, p, label):
    tp = sum(a == label == b for a, b in zip(t, p))
    wrong = sum((a == label) != (b == label) for a, b in zip(t, p))
    return 2 * tp / (2 * tp + wrong) if tp + wrong else 0.0


def test_intent_metrics(frame):
    df, pdf = frame
    t, p = list(pdf.true_intent), list(pdf.pred_intent)
    row = m.intent_metrics(df).first()
    assert row.accuracy == pytest.approx(sum(a == b for a, b in zip(t, p)) / len(t))
    labels = set(t) | set(p)
    assert row.macro_f1 == pytest.approx(sum(f1(t, p, c) for c in labels) / len(labels))
    assert {r.label: r.f1 for r in m.per_class_f1(df).collect()} == pytest.approx({c: f1(t, p, c) for c in labels})


def test_operational_and_escalation_metrics(frame):
    df, pdf = frame
    t, e = pdf.true_escalate, pdf.pred_escalate
    row = m.operational_metrics(df).first()
    assert row.auto_handle_rate == pytest.approx((~e).mean())
    assert row.volume_false_auto == pytest.approx((~e & t).sum() / (~e).sum())
    assert row.risk_miss_rate == pytest.approx((~e & t).sum() / t.sum())
    pr = m.escalation_metrics(df).first()
    assert (pr.precision, pr.recall) == pytest.approx(((e & t).sum() / e.sum(), (e & t).sum() / t.sum()))


def test_rates_without_a_base(spark):
    df = spark.createDataFrame([(False, True)], "true_escalate boolean, pred_escalate boolean")
    row = m.operational_metrics(df).first()
    assert row.volume_false_auto is None and row.recall is None and row.precision == 0.0
    assert m.escalation_metrics(df).first().recall == 0.0


def test_calibration_bins_and_ece_match_pandas(frame):
    df, pdf = frame
    pdf = pdf.assign(hit=(pdf.true_intent == pdf.pred_intent).astype(int))
    pdf["bin"] = pd.cut(pdf.confidence, bins=[0] + [i * 0.1 for i in range(1, 10)] + [1], include_lowest=True)
    g = pdf.groupby("bin", observed=True).agg(n=("hit", "size"), c=("confidence", "mean"), a=("hit", "mean"))
    got = {r.bin: (r.n, r.mean_conf, r.mean_acc) for r in m.calibration_bins(df).collect()}
    assert {k: v[0] for k, v in got.items()} == {str(k): v for k, v in g.n.items()}
    assert [got[str(k)][1:] for k in g.index] == [pytest.approx((r.c, r.a)) for r in g.itertuples()]
    ece = (g.n / len(pdf) * (g.c - g.a).abs()).sum()
    assert m.ece(df).first().ece == pytest.approx(ece)


def test_bin_edges(spark):
    conf = [0.0, 0.1, 0.3, 0.30000000000000004, 0.30000000000000010, 1.0, 1.1, -0.1, None, float("nan")]
    df = spark.createDataFrame([("x", "x", c) for c in conf], "true_intent string, pred_intent string, confidence double")
    got = {r.bin: r.n for r in m.calibration_bins(df).collect()}
    assert got == {"(-0.001, 0.1]": 2, "(0.2, 0.3]": 2, "(0.3, 0.4]": 1, "(0.9, 1.0]": 1}
    # Out-of-range rows count in N only.
    assert m.ece(df).first().ece == pytest.approx((2 - 0.1 + 2 - 0.6 + 1 - 0.3) / 8, abs=1e-9)


def test_published_calibration_error(spark):
    # (n, mean confidence, hits) per bin of a published report; its error is 0.09865.
    bins = [(2, .3, 2), (3, .3666666666666667, 3), (6, .4483333333333333, 4), (3, .6, 2), (11, .6372727272727272, 9),
            (19, .7552631578947369, 12), (25, .8628, 17), (131, .9542748091603054, 119)]
    rows = [("x", "x" if i < hits else "y", conf) for n, conf, hits in bins for i in range(n)]
    df = spark.createDataFrame(rows, "true_intent string, pred_intent string, confidence double")
    assert m.ece(df).first().ece == pytest.approx(0.09865, abs=1e-9)


def grades(spark, rows):
    cols = ", ".join(f"{s}_{x} double" for x in ["p", "q"] for s in ["human", "judge"])
    return spark.createDataFrame(rows, cols), pd.DataFrame(rows, columns=[c.split()[0] for c in cols.split(", ")])


@pytest.mark.parametrize("complete", [True, False])
def test_spearman_matches_pandas(spark, complete):
    rng = random.Random(2)
    grade = lambda: rng.choice([None, 1.0, 2.0, 3.0, 4.0, 5.0])
    df, pdf = grades(spark, [tuple(grade() for _ in range(4)) for _ in range(300)])
    got = {r.metric: r for r in m.spearman(df, ["p", "q"], complete).collect()}
    base = pdf.dropna(subset=["human_p", "human_q"]) if complete else pdf
    for x in ["p", "q"]:
        sub = base[[f"human_{x}", f"judge_{x}"]].dropna()
        ranks = sub.rank()
        assert got[x].n == len(sub)
        assert got[x].spearman == pytest.approx(ranks[f"human_{x}"].corr(ranks[f"judge_{x}"]))


def test_spearman_without_enough_rows(spark):
    df, _ = grades(spark, [(1.0, 2.0, 3.0, 1.0), (2.0, 1.0, 3.0, 2.0), (None, 1.0, 3.0, 5.0)])
    got = {r.metric: r.spearman for r in m.spearman(df, ["p", "q"], False, 3).collect()}
    assert got == {"p": None, "q": None}  # two rows; a constant side
    assert {r.metric: r.spearman for r in m.spearman(df, ["p", "q"]).collect()}["p"] == pytest.approx(-1.0)


def test_align_fails_on_a_missing_prediction(spark):
    g = spark.createDataFrame([(1,), (2,)], "tweet_id int")
    p = spark.createDataFrame([(1, "a")], "tweet_id int, pred_intent string")
    assert m.align(g.where("tweet_id = 1"), p).count() == 1
    with pytest.raises(Exception, match="no prediction"):
        m.align(g, p).collect()


def test_align_fails_on_surplus_and_repeated_predictions(spark):
    g = spark.createDataFrame([(1,)], "tweet_id int")
    surplus = spark.createDataFrame([(1, "a"), (3, "b")], "tweet_id int, pred_intent string")
    with pytest.raises(Exception, match="no ticket"):
        m.align(g, surplus).collect()
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "tweet_id int, pred_intent string")
    with pytest.raises(Exception, match="several predictions"):
        m.align(g, twice).collect()


def test_calibration_does_not_depend_on_partitions(spark):
    rows = [(i, "a", "a" if i % 3 else "b", (i * 7919 % 1000) / 1000) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, true_intent string, pred_intent string, confidence double")
    one, many = ([m.ece(x).collect(), sorted(m.calibration_bins(x).collect())] for x in (df.repartition(1), df.repartition(37)))
    assert one == many
    hits = [(r[3], r[1] == r[2]) for r in rows]
    exact = 0
    for k in range(10):
        mine = [(round(c * 1000), h) for c, h in hits if k * 100 < round(c * 1000) <= (k + 1) * 100 or k == 0 == round(c * 1000)]
        exact += abs(sum(c for c, _ in mine) - 1000 * sum(h for _, h in mine))
    assert one[0][0].ece == exact / 1000 / 3000


def test_spearman_skips_metrics_without_columns(spark):
    df = spark.createDataFrame([(1, 2, 5), (2, 3, 4), (3, 5, 1)], "human_safety int, judge_safety int, judge_groundedness int")
    got = m.spearman(df, ["groundedness", "safety"], complete_cases=False).collect()
    assert [(r.metric, r.n, round(r.spearman, 9)) for r in got] == [("safety", 3, 1.0)]
    assert m.spearman(df, ["groundedness"]).collect() == []
