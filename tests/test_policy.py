import math

from pyspark.sql import functions as F

from deskflow.functions import fixed_values as fv
from deskflow.functions.numeric import calibrated_prob
from deskflow.operators.policy import decide, decide_all_reasons
from deskflow.sources.config import GateConfig

CFG = GateConfig(1.2884131785495232, -0.9898263692865626, -0.49184527454031646, 0.5)
SCHEMA = "tweet_id int, text string, confidence double, retrieval_score double, llm_risk boolean"


def run(spark, rows, cfg):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    return decide(df, cfg).orderBy("tweet_id").collect()


def test_first_rule_wins(spark):
    rows = [("I was hacked", 1.0, 0.2, True), ("hi", 0.1, 0.9, True), ("hi", 1.0, 0.2, False), ("hi", 0.1, 0.9, False)]
    got = run(spark, rows, CFG)
    assert [r.reason_code for r in got] == ["keyword", "model_risk", "risk_score", "safe"]
    assert [r.pred_escalate for r in got] == [True, True, True, False]
    p = 1 / (1 + math.exp(-(CFG.w_confidence + CFG.w_retrieval * 0.2 + CFG.intercept)))
    assert got[2].reason == f"Calibrated risk score {p:.2f} >= 0.5"
    assert got[0].reason == fv.REASON_KEYWORD and got[3].reason == fv.REASON_SAFE


def test_fallback_gates(spark):
    rows = [("hi", 0.69, 0.1, False), ("hi", 0.7, 0.39, False), ("hi", 0.7, 0.4, False)]
    assert [r.reason_code for r in run(spark, rows, None)] == ["low_confidence", "weak_evidence", "safe"]


def test_missing_numbers_never_escalate(spark):
    nan = float("nan")
    rows = [("hi", None, 0.1, None), ("hi", nan, 0.1, False), (None, 1.0, nan, False)]
    assert [r.reason_code for r in run(spark, rows, CFG)] == ["safe"] * 3
    assert [r.reason_code for r in run(spark, [("hi", nan, nan, None)], None)] == ["safe"]


def test_rules_see_redacted_text(spark):
    # The risk word is part of an address, which is removed before the test.
    assert run(spark, [("write hack@example.com", 0.1, 0.9, False)], CFG)[0].reason_code == "safe"


def test_score_is_clipped(spark):
    for z, expected in [(1e6, 1.0), (-1e6, 1 / (1 + math.exp(700)))]:
        p = spark.range(1).select(calibrated_prob(F.lit(1.0), F.lit(0.0), z, 0.0, 0.0)).first()[0]
        assert p == expected


def test_all_reasons(spark):
    rows = [("I can't CANCEL, this is a SCAM", 0.5, 0.0, True), ("hi", 0.7, 0.0, False), ("hi", None, 0.0, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    got = decide_all_reasons(df).orderBy("tweet_id").collect()
    assert got[0].reasons == [
        fv.REQUEST_REASON_KEYWORD, fv.REQUEST_REASON_DEAD_END, fv.REQUEST_REASON_MODEL_RISK,
        fv.REQUEST_REASON_LOW_CONFIDENCE,
    ]
    assert got[1].reasons == [fv.REQUEST_REASON_SAFE] and not got[1].escalate
    assert not got[2].escalate
