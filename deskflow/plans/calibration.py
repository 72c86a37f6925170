"""Fit the gate, choose the cut-off, and decide again under the new gate."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import keyword_flag
from ..operators.policy import decide
from ..operators.sweeps import choose_threshold, fit_gate
from ..sources.config import GateConfig


def calibrate(features: DataFrame) -> GateConfig:
    """Gate fitted on tickets with text, true_escalate, confidence, retrieval_score, llm_risk.

    The fit reads its input many times, so the numbers it needs are kept, without
    the texts.  Only the fitted numbers and one result row reach the driver.
    """
    kept = features.select(
        "confidence", "retrieval_score", "llm_risk", "true_escalate",
        keyword_flag(F.col("text")).alias("kw"),
    ).persist()
    try:
        fitted = fit_gate(kept)
        best = choose_threshold(kept, fitted).first()
    finally:
        kept.unpersist()
    return replace(fitted, prob_thresh=best.prob_thresh)


def recalibrated_run(features: DataFrame) -> tuple[GateConfig, DataFrame]:
    """New gate and the decisions under it, without scoring any ticket again."""
    cfg = calibrate(features)
    return cfg, decide(features, cfg)
