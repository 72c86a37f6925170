"""Escalation policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.numeric import calibrated_prob, known
from ..functions.text import dead_end, keyword_flag, redact_pii, risk_hit
from ..sources.config import GateConfig


def never_null(col: Column) -> Column:
    return F.coalesce(col, F.lit(False))


def risk_score(cfg: GateConfig, confidence: str = "confidence", retrieval: str = "retrieval_score"):
    """Risk score of a ticket under a fitted gate."""
    return calibrated_prob(
        F.col(confidence), F.col(retrieval), cfg.w_confidence, cfg.w_retrieval, cfg.intercept
    )


def decide(df: DataFrame, cfg: GateConfig | None) -> DataFrame:
    """Add the decision for every ticket; the first rule that fires gives the reason.

    Rules in order: keyword or dead end in the redacted text, model risk, then
    the calibrated score, or without a config the two fallback gates.  A missing
    number never fires a gate.
    """
    safe_text = F.col("safe_text")
    out = df.withColumn("safe_text", redact_pii(F.col("text")))
    rules = [
        ("keyword", keyword_flag(safe_text), F.lit(fv.REASON_KEYWORD)),
        ("model_risk", F.col("llm_risk"), F.lit(fv.REASON_MODEL_RISK)),
    ]
    if cfg is None:
        out = out.withColumn("risk_score", F.lit(None).cast("double"))
        rules += [
            ("low_confidence", known(F.col("confidence")) < fv.MIN_CONFIDENCE,
             F.lit(fv.REASON_LOW_CONFIDENCE)),
            ("weak_evidence", known(F.col("retrieval_score")) < fv.MIN_RETRIEVAL,
             F.lit(fv.REASON_WEAK_EVIDENCE)),
        ]
    else:
        out = out.withColumn("risk_score", risk_score(cfg))
        rules.append(
            ("risk_score", F.col("risk_score") >= F.lit(cfg.prob_thresh),
             F.format_string(fv.REASON_SCORE_FORMAT + str(cfg.prob_thresh), F.col("risk_score")))
        )

    code = F.lit("safe")
    for name, fires, _ in reversed(rules):
        code = F.when(never_null(fires), name).otherwise(code)
    reason = F.lit(fv.REASON_SAFE)
    for name, _, words in rules:
        reason = F.when(F.col("reason_code") == name, words).otherwise(reason)
    return (
        out.withColumn("reason_code", code)
        .withColumn("pred_escalate", F.col("reason_code") != "safe")
        .withColumn("reason", reason)
    )


def request_reasons(
    safe_text: Column, model_risk: Column, confidence: Column
) -> Column:
    """All reasons that apply to a request, in rule order; empty when there is none."""
    low = never_null(known(confidence) < fv.MIN_CONFIDENCE)
    return F.array_compact(
        F.array(
            F.when(risk_hit(safe_text), fv.REQUEST_REASON_KEYWORD),
            F.when(dead_end(safe_text), fv.REQUEST_REASON_DEAD_END),
            F.when(never_null(model_risk), fv.REQUEST_REASON_MODEL_RISK),
            F.when(low, fv.REQUEST_REASON_LOW_CONFIDENCE),
        )
    )


def decide_all_reasons(
    df: DataFrame, text: str = "text", model_risk: str = "llm_risk", confidence: str = "confidence"
) -> DataFrame:
    """Per-request policy: escalate when any reason applies, and name all of them."""
    return (
        df.withColumn("safe_text", redact_pii(F.col(text), "url_first"))
        .withColumn(
            "reasons", request_reasons(F.col("safe_text"), F.col(model_risk), F.col(confidence))
        )
        .withColumn("escalate", F.size("reasons") > 0)
        .withColumn(
            "reasons",
            F.when(F.col("escalate"), F.col("reasons")).otherwise(
                F.array(F.lit(fv.REQUEST_REASON_SAFE))
            ),
        )
    )
