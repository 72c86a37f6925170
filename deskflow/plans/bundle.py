"""Results bundle: one small document of headline numbers, and the tickets as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import keyword_flag
from ..operators.metrics import intent_metrics, operational_metrics, spearman
from ..operators.policy import risk_score
from ..operators.sweeps import operating_curve
from ..sources.config import GateConfig
from ..sources.tables import write_document, write_table

def _one() -> Column:
    return F.lit(1).alias("one")


def bundle_headline(preds: DataFrame, risk: DataFrame, cfg: GateConfig) -> DataFrame:
    """Headline numbers, rates in percent."""
    ops = operational_metrics(risk).select(
        F.round(F.col("auto_handle_rate") * 100, 2).alias("auto_handle"),
        F.round(F.col("volume_false_auto") * 100, 2).alias("volume_false_auto"),
        F.round(F.col("risk_miss_rate") * 100, 2).alias("risk_miss"),
        _one(),
    )
    intents = intent_metrics(preds).select(
        F.round("macro_f1", 2).alias("macro_f1"),
        F.round(F.col("accuracy") * 100, 2).alias("accuracy"),
        _one(),
    )
    return ops.join(intents, "one").drop("one").withColumn("prob_thresh", F.lit(cfg.prob_thresh))


def bundle_document(
    preds: DataFrame, risk: DataFrame, replies: DataFrame, cfg: GateConfig,
    metrics: list[str] = fv.JUDGE_METRICS,
) -> DataFrame:
    """Headline, rater agreement and operating curve as one JSON document.

    The parts have a fixed number of rows (1, one per metric, 19).
    """
    headline = bundle_headline(preds, risk, cfg).select(F.struct("*").alias("headline"), _one())
    agreement = spearman(replies, metrics, complete_cases=False, min_n=3).agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("metric", F.round("spearman", 2).alias("value"))))
        ).alias("agreement"),
        _one(),
    )
    curve = operating_curve(risk, cfg).agg(
        F.array_sort(F.collect_list(F.struct("*"))).alias("curve"), _one()
    )
    options = {"ignoreNullFields": "false"}
    return (
        headline.join(agreement, "one").join(curve, "one")
        .select(F.to_json(F.struct("headline", "agreement", "curve"), options).alias("document"))
    )


def bundle_tickets(risk: DataFrame, cfg: GateConfig) -> DataFrame:
    """What the threshold slider needs of every ticket."""
    return risk.select(
        F.round(risk_score(cfg), 4).alias("risk_score"),
        keyword_flag(F.col("text")).alias("kw"),
        "true_escalate",
    )


def export_bundle(
    path: str, preds: DataFrame, risk: DataFrame, replies: DataFrame, cfg: GateConfig,
    evidence: DataFrame, metrics: list[str] = fv.JUDGE_METRICS,
) -> None:
    """Write document, tickets and evidence sample below ``path``.

    Tickets stay a table of JSON lines written in parallel: as one array they
    would have to pass through a single task.
    """
    write_document(bundle_document(preds, risk, replies, cfg, metrics), f"{path}/document")
    write_table(bundle_tickets(risk, cfg), f"{path}/tickets", "json")
    write_table(evidence.select("text"), f"{path}/evidence", "json")
