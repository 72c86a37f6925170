from pyspark.sql import functions as F

from deskflow.functions import fixed_values as fv
from deskflow.functions import model_output as mo
from deskflow.operators import calls as cl
from deskflow.operators import tickets as tk


def test_batch_intent(values):
    texts = [
        '{"intent":"app_bug","confidence":0.9,"rationale":"x"}', '{"intent":"other","confidence":"0.8"}',
        '{"confidence":"high"}', "not json", "[1]", None, '{"intent":"a","confidence":1}',
    ]
    got = [tuple(v) for v in values(lambda c: mo.parse_intent(c, "error"), texts)]
    assert got == [
        ("app_bug", 0.9, False), ("other", 0.8, False), ("error", 0.5, False), ("error", 0.5, True),
        ("error", 0.5, True), ("error", 0.5, True), ("a", 1.0, False),
    ]


def test_request_intent(values):
    texts = ['{"intent":"","confidence":null}', '{"intent":null}', '{"confidence":""}', '{"confidence":true}',
             '{"confidence":"x"}', '{"confidence":"0.25","intent":"app_bug"}', "oops"]
    got = [(v.intent, v.confidence) for v in values(mo.parse_request_intent, texts)]
    assert got == [("other", 0.0), ("other", 0.5), ("other", 0.0), ("other", 1.0), ("other", 0.5), ("app_bug", 0.25),
                   ("other", 0.5)]


def test_risk_is_a_truth_value(values):
    cases = {
        '{"risk":true}': True, '{"risk":false}': False, '{"risk":"false"}': True, '{"risk":""}': False,
        '{"risk":0}': False, '{"risk":0.0}': False, '{"risk":2}': True, '{"risk":null}': False, "{}": False,
        '{"risk":[]}': False, '{"risk":{}}': False, '{"risk":[0]}': True, '{"risk":{"a":1}}': True, "no": False,
    }
    assert [v.risk for v in values(mo.parse_risk, list(cases))] == list(cases.values())
    loose = values(lambda c: mo.parse_risk(c, empty_container=True), ['{"risk":[]}', '{"risk":{}}', "x"])
    assert [(v.risk, v.parse_error) for v in loose] == [(True, False), (True, False), (False, True)]


def test_judge(values):
    texts = ['{"groundedness":4,"safety":"5","critique":"fine"}', "x"]
    assert [tuple(v) for v in values(mo.parse_judge, texts)] == [
        (4.0, 5.0, None, "fine", False), (None, None, None, None, True),
    ]


def test_cooldown(values):
    cases = {
        "Limit on TOKENS per day reached, try again in 1s": 21600.0, "requests per day": 21600.0,
        "try again in 2m3.5s": 128.5, "Try again in 7s": 12.0, "try again in 3.s": 8.0, "slow down": 60.0,
        "try again in ms": 60.0,
    }
    assert values(mo.cooldown_seconds, list(cases)) == list(cases.values())
    assert values(mo.cooldown_seconds, [None]) == [60.0]


CALLS = [
    (1, 7, 0, "first", 429, "try again in 1s"), (2, 7, 1, "second", 200, None), (3, 8, 0, "first", 404, "gone"),
    (4, 8, 1, "second", 200, None), (5, 9, 0, "first", 200, None), (6, 9, 1, "second", 200, None),
    (7, 10, 0, "first", 500, None), (8, 10, 1, "second", None, "reset"), (9, 11, 0, "first", 401, None),
]


def calls(spark):
    return spark.createDataFrame(
        CALLS, "call_id int, tweet_id int, priority int, model string, status int, message string"
    )


def test_outcomes(spark):
    got = [(r.outcome, r.cooldown_s) for r in cl.with_outcome(calls(spark)).orderBy("call_id").collect()]
    assert got == [
        ("cooldown", 6.0), ("served", None), ("removed", None), ("served", None), ("served", None), ("served", None),
        ("cooldown", 30.0), ("cooldown", 15.0), ("removed", None),
    ]


def test_fallback_to_the_next_model(spark):
    assert {r.tweet_id: r.model for r in cl.served_by(calls(spark)).collect()} == {7: "second", 8: "second", 9: "first"}
    assert {r.model: r.calls for r in cl.model_usage(calls(spark)).collect()} == {"first": 1, "second": 3}
    summary = {(r.model, r.outcome): (r.calls, r.cooldown_s) for r in cl.attempt_summary(calls(spark)).collect()}
    assert summary[("first", "cooldown")] == (2, 36.0) and summary[("first", "removed")] == (2, 0.0)


def test_scorer_is_made_once_per_partition(spark):
    def factory():
        made = []

        def scorer(texts):
            made.append(1)
            return ['{"intent":"app_bug","confidence":%d}' % len(made) for _ in texts]

        return scorer

    df = spark.createDataFrame([(i, None if i == 0 else "x") for i in range(10)], "tweet_id int, text string").coalesce(1)
    got = tk.score_tickets(df, factory).collect()
    assert len(got) == 10 and {r.payload for r in got} == {'{"intent":"app_bug","confidence":1}'}


def test_default_scorer_is_the_keyword_intent(spark, values):
    from deskflow.functions.text import simple_intent

    texts = ["REFUND now", "login", None, "hello", "it won't play"]
    df = spark.createDataFrame(list(enumerate(texts)), "tweet_id int, text string")
    scored = tk.score_tickets(df).select("tweet_id", mo.parse_intent(F.col("payload")).alias("p"))
    assert [r.p.intent for r in scored.orderBy("tweet_id").collect()] == values(simple_intent, texts)


def test_missing_outputs(spark):
    cols = "tweet_id int, intent_payload string, intent_model string, risk_payload string, risk_model string, reply string, draft_model string"
    row = tk.fill_missing_outputs(spark.createDataFrame([(1, *[None] * 6)], cols)).first()
    assert (row.intent_model, row.risk_model, row.draft_model) == ("fallback", "fallback", "none")
    assert row.reply == fv.DRAFT_UNAVAILABLE and row.risk_payload == '{"risk": false}'


def test_grades_follow_the_ticket(spark):
    new = spark.createDataFrame([(1, "same text"), (2, "same text")], "tweet_id int, tweet string")
    old = spark.createDataFrame([(1, "same text", 5, "note")], "tweet_id int, tweet string, human_safety int, human_notes string")
    got = tk.attach_grades(new, old).orderBy("tweet_id").collect()
    assert [(r.human_safety, r.human_notes) for r in got] == [(5, "note"), (None, None)]
    assert tk.attach_grades(new, new) is new


def test_split_valid_and_first_tickets(spark):
    df = spark.createDataFrame([(3, " a "), (1, ""), (2, "x" * 501)], "tweet_id int, text string")
    good, bad = tk.split_valid(df)
    assert [tuple(r) for r in good.collect()] == [(3, "a")]
    assert {r.error for r in bad.collect()} == {fv.TICKET_LENGTH_ERROR} and bad.count() == 2
    assert [r.tweet_id for r in tk.first_tickets(df, 2).collect()] == [1, 2]
