"""The three evaluation runs: intent, risk and replies.

Each takes tickets and the answers that models gave to them as tables, and
returns one lazy DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.model_output import parse_intent, parse_judge, parse_risk
from ..functions.text import parse_bool, predict_escalation, redact_pii
from ..operators.grounding import ground
from ..operators.policy import decide
from ..operators.threads import require
from ..operators.tickets import attach_grades
from ..sources.config import GateConfig


def intent_run(golden: DataFrame, answers: DataFrame) -> DataFrame:
    """Labelled tickets with predicted intent, confidence and rule-layer escalation.

    ``golden``: tweet_id, text, true_intent, should_escalate; ``answers``:
    tweet_id, intent_payload.  Every labelled ticket is returned: one without an answer has
    ``answered`` false, the error intent and the default confidence.
    """
    parsed = parse_intent(F.col("intent_payload"), default=fv.ERROR_INTENT)
    return (
        require(golden, ["true_intent", "should_escalate"])
        .withColumn("should_escalate", parse_bool(F.col("should_escalate")))
        .join(answers.select("tweet_id", "intent_payload"), "tweet_id", "left")
        .withColumn("_p", parsed)
        .select(
            *golden.columns,
            F.col("_p.intent").alias("pred_intent"),
            predict_escalation(redact_pii(F.col("text"))).alias("pred_escalate"),
            F.col("_p.confidence").alias("confidence"),
            F.col("_p.parse_error").alias("parse_error"),
            F.col("intent_payload").isNotNull().alias("answered"),
        )
    )


def risk_run(
    golden: DataFrame, answers: DataFrame, top1: DataFrame, cfg: GateConfig | None
) -> DataFrame:
    """Labelled tickets with the decision of the risk policy.

    ``answers``: tweet_id, intent_payload, risk_payload; ``top1``: query_id,
    top_score.  All joins are on the unique ticket id.  Every labelled ticket is returned;
    ``answered`` and the two parse flags tell which decisions rest on defaults.
    """
    features = (
        require(golden, ["should_escalate"])
        .select("tweet_id", "text", parse_bool(F.col("should_escalate")).alias("true_escalate"))
        .join(answers.select("tweet_id", "intent_payload", "risk_payload"), "tweet_id", "left")
        .join(top1.withColumnRenamed("query_id", "tweet_id"), "tweet_id", "left")
        .withColumns({"_i": parse_intent(F.col("intent_payload")), "_r": parse_risk(F.col("risk_payload"))})
        .select(
            "tweet_id", "text", "true_escalate",
            F.col("_i.intent").alias("intent"),
            F.col("_i.confidence").alias("confidence"),
            F.col("top_score").alias("retrieval_score"),
            F.col("_r.risk").alias("llm_risk"),
            F.col("_i.parse_error").alias("intent_parse_error"),
            F.col("_r.parse_error").alias("risk_parse_error"),
            (F.col("intent_payload").isNotNull() & F.col("risk_payload").isNotNull()).alias("answered"),
        )
    )
    return decide(features, cfg)


def reply_run(
    tickets: DataFrame, evidence: DataFrame, drafts: DataFrame, judgements: DataFrame,
    whitelist: DataFrame, grades: DataFrame | None = None,
) -> DataFrame:
    """Drafted replies: verified, cleaned, with judge scores and earlier human grades.

    ``tickets``: tweet_id, text, intent; ``evidence``: ranked rows per query_id;
    ``drafts``: tweet_id, reply; ``judgements``: tweet_id, judge_payload.  A ticket without
    a draft is returned too, with ``drafted`` false.
    """
    top = evidence.where("rk = 1").select(
        F.col("query_id").alias("tweet_id"), F.col("score").alias("top_retrieval_score")
    )
    clean = ground(drafts.select("tweet_id", "reply"), whitelist).select(
        "tweet_id", F.col("clean_reply").alias("generated_reply"),
        F.col("n_violations").alias("verifier_violations"), F.col("violations").alias("verifier_urls"),
        F.lit(True).alias("drafted"),
    )
    judged = judgements.select("tweet_id", parse_judge(F.col("judge_payload")).alias("_j")).select(
        "tweet_id", *[F.col(f"_j.{m}").alias(f"judge_{m}") for m in [*fv.JUDGE_METRICS, "critique"]]
    )
    run = (
        tickets.select(
            "tweet_id", F.col("text").alias("tweet"),
            redact_pii(F.col("text")).alias("safe_tweet"), "intent",
        )
        .join(top, "tweet_id", "left")
        .join(clean, "tweet_id", "left")
        .withColumn("drafted", F.coalesce("drafted", F.lit(False)))
        .join(judged, "tweet_id", "left")
    )
    return run if grades is None else attach_grades(run, grades)
