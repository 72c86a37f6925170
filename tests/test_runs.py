"""Whole runs: config, evaluation plans, bundle, stream."""

import json

import pytest
from pyspark.sql import functions as F

from deskflow.operators.metrics import calibration_bins, ece
from deskflow.operators.prompts import draft_prompts, intent_prompts, judge_prompts
from deskflow.operators.sweeps import choose_threshold, fit_gate, gate_frame
from deskflow.plans.bundle import export_bundle
from deskflow.plans.evaluation import reply_run, risk_run
from deskflow.session import shared_folder
from deskflow.sources.config import GateConfig, gate_config_frame, load_gate_config, write_gate_config
from deskflow.sources.tables import calibration_json
from deskflow.streaming.triage import triage_batch, triage_stream

CFG = GateConfig(1.0, -1.0, 0.0, 0.5)


@pytest.fixture(scope="module")
def features(spark):
    return spark.range(200).selectExpr(
        "id AS tweet_id", "IF(id % 10 = 0, 'hacked', concat('hello ', id)) AS text", "id % 100 / 100D AS confidence",
        "id % 37 / 37D AS retrieval_score", "id % 29 = 0 AS llm_risk", "id % 10 = 0 OR id % 100 > 80 AS true_escalate",
        "IF(id % 3 = 0, 'other', 'app_bug') AS true_intent", "IF(id % 4 = 0, 'other', 'app_bug') AS pred_intent",
        "id % 5 + 1 AS judge_safety", "id % 7 + 1 AS human_safety",
    )


def test_config_round_trip(spark, features, tmp_path):
    assert load_gate_config(spark, str(tmp_path / "none.json")) is None
    fitted = fit_gate(features)
    frame = gate_config_frame(gate_frame(spark, fitted), choose_threshold(features, fitted), "in-sample")
    write_gate_config(frame, str(tmp_path / "cfg"))
    best = choose_threshold(features, fitted).first()
    loaded = load_gate_config(spark, str(tmp_path / "cfg"))
    assert loaded == GateConfig(fitted.w_confidence, fitted.w_retrieval, fitted.intercept, best.prob_thresh)


def test_config_file_layout(spark, tmp_path):
    path = tmp_path / "thresholds.json"
    path.write_text(json.dumps(
        {"mode": "m", "coefficients": {"confidence": 1.5, "retrieval_score": -2.0}, "intercept": 0.25, "prob_thresh": 0.5},
        indent=2,
    ))
    assert load_gate_config(spark, str(path)) == GateConfig(1.5, -2.0, 0.25, 0.5)


def test_calibration_document(features):
    doc = json.loads(calibration_json(calibration_bins(features), ece(features)).first()[0])
    assert len(doc["buckets"]) == 10 and doc["ece"] == round(ece(features).first().ece, 4)
    assert sum(b["n"] for b in doc["buckets"]) == 200


def test_bundle(spark, features, tmp_path):
    risk = features.withColumn("pred_escalate", F.col("confidence") > 0.5)
    export_bundle(str(tmp_path), features, risk, features, CFG, features, ["safety"])
    doc = json.loads(spark.read.text(str(tmp_path / "document")).first()[0])
    assert set(doc) == {"headline", "agreement", "curve"} and len(doc["curve"]) == 19
    assert doc["headline"]["prob_thresh"] == 0.5 and set(doc["agreement"]) == {"safety"}
    tickets = spark.read.json(str(tmp_path / "tickets"))
    assert tickets.count() == 200 and set(tickets.columns) == {"risk_score", "kw", "true_escalate"}
    assert spark.read.json(str(tmp_path / "evidence")).columns == ["text"]


def test_risk_run(spark):
    golden = spark.createDataFrame([(1, "hi", " True"), (2, "hacked", "no"), (3, "x", None)],
                                   "tweet_id bigint, text string, should_escalate string")
    answers = spark.createDataFrame([(1, '{"intent":"other","confidence":0.9}', '{"risk":"yes"}'), (2, "bad", None)],
                                    "tweet_id bigint, intent_payload string, risk_payload string")
    top1 = spark.createDataFrame([(1, 0.4)], "query_id bigint, top_score double")
    got = {r.tweet_id: r for r in risk_run(golden, answers, top1, CFG).collect()}
    assert set(got) == {1, 2}
    assert got[1].reason_code == "model_risk" and got[1].true_escalate and got[1].retrieval_score == 0.4
    assert got[2].reason_code == "keyword" and got[2].confidence == 0.5 and got[2].risk_score is None


def test_reply_run(spark):
    make = spark.createDataFrame
    run = reply_run(
        make([(1, "mail a@b.co", "other")], "tweet_id bigint, text string, intent string"),
        make([(1, 2, 5, 0.1), (1, 1, 4, 0.7)], "query_id bigint, rk int, corpus_id bigint, score double"),
        make([(1, "see https://bad/x")], "tweet_id bigint, reply string"),
        make([(1, '{"safety":5}')], "tweet_id bigint, judge_payload string"),
        make([("path", "https://good/x")], "kind string, key string"),
        make([(1, 4)], "tweet_id bigint, human_safety int"),
    ).first()
    assert run.safe_tweet == "mail [EMAIL]" and run.top_retrieval_score == 0.7
    assert run.verifier_violations == 1 and run.verifier_urls == ["https://bad/x"] and "removed" in run.generated_reply
    assert (run.judge_safety, run.judge_groundedness, run.human_safety) == (5.0, None, 4)


def test_prompts(spark):
    tickets = spark.createDataFrame([(1, "help", "app_bug", "ok"), (2, "hey", "other", "no")],
                                    "tweet_id bigint, safe_text string, intent string, clean_reply string")
    evidence = spark.createDataFrame([(1, 2, 0.5, "second"), (1, 1, 0.753, "first")],
                                     "query_id bigint, rk int, score double, text string")
    draft = {r.tweet_id: r for r in draft_prompts(tickets, evidence, "Acme").collect()}
    assert draft[1].system.startswith("You are drafting a Acme support reply.\n")
    assert draft[1].system.endswith(
        "\nIntent: app_bug.\nRetrieved Historical Evidence:\n- [Score: 0.75] first\n- [Score: 0.50] second"
    )
    assert draft[2].system.endswith("Evidence:\n") and draft[2].user == "Tweet: hey\nDraft:"
    judge = {r.tweet_id: r.user for r in judge_prompts(tickets, evidence).collect()}
    assert judge[1] == "Tweet: help\nReply: ok\nEvidence the reply was allowed to use:\n- first\n- second"
    assert "Acme support tweets" in intent_prompts(tickets, "Acme").first().system


REQUESTS = [
    (1, "I was HACKED, mail a@b.co", '{"intent":"account_login","confidence":0.9}', '{"risk":true}'),
    (2, "   ", None, None), (3, "x" * 501, None, None), (4, "song refund please", None, None),
    (5, "app keeps crashing", '{"intent":"app_bug","confidence":0.95}', '{"risk":false}'),
]


def test_stream_equals_batch(spark, tmp_path):
    cols = "tweet_id bigint, text string, intent_payload string, risk_payload string"
    requests = spark.createDataFrame(REQUESTS, cols)
    corpus = spark.createDataFrame([(10, "please update the app"), (11, "song refund issued"), (12, None)],
                                   "tweet_id bigint, text string")
    for part in range(2):  # two arrivals, one file per micro-batch
        requests.where(f"tweet_id % 2 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run():
        query = triage_stream(stream, corpus, str(tmp_path / "out"), str(tmp_path / "ck"))
        query.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    batch = triage_batch(requests, corpus)
    expected = sorted(batch.collect(), key=str)
    assert sorted(run().select(*batch.columns).collect(), key=str) == expected
    assert run().count() == len(REQUESTS)  # nothing new, nothing twice
    got = {r.tweet_id: r for r in expected}
    assert got[2].error and got[3].error and got[3].escalate is None and got[3].evidence is None
    assert got[1].safe_text == "I was HACKED, mail [EMAIL]" and len(got[1].reasons) == 2
    assert [e.text for e in got[4].evidence] == ["song refund issued", "please update the app"] and got[4].confidence == 0.5
    assert not got[5].escalate and got[5].intent_model == "fallback"



def test_shared_folder_is_the_configured_one():
    from types import SimpleNamespace as Stub

    def session(folder, master):
        conf = {"spark.checkpoint.dir": folder} if folder else {}
        return Stub(conf=conf, sparkContext=Stub(master=master, applicationId="app-1"))

    assert shared_folder(session("/shared/work", "yarn")) == "/shared/work"
    assert shared_folder(session(None, "local[4]"))
    with pytest.raises(ValueError):
        shared_folder(session(None, "yarn"))
