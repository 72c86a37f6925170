"""Prompt rows for batch inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv


def evidence_block(evidence: DataFrame, id_col: str = "query_id", scores: bool = True) -> DataFrame:
    """One text block of bullets per ticket, best evidence first.

    ``evidence`` has ``rk``, ``score`` and ``text``; a ticket has at most k rows.
    """
    line = (
        F.format_string("- [Score: %.2f] %s", F.col("score"), F.col("text"))
        if scores
        else F.concat(F.lit("- "), F.col("text"))
    )
    return (
        evidence.withColumn("line", line)
        .groupBy(id_col)
        .agg(F.array_sort(F.collect_list(F.struct("rk", "line"))).alias("lines"))
        .select(id_col, F.array_join("lines.line", "\n").alias("evidence"))
    )


def _instructions(text: str, brand: str) -> str:
    return text.replace("{brand}", brand)


def intent_prompts(tickets: DataFrame, brand: str) -> DataFrame:
    """System and user message of the intent call; expects ``safe_text``."""
    return tickets.select(
        "tweet_id",
        F.lit(_instructions(fv.INTENT_INSTRUCTIONS, brand)).alias("system"),
        F.col("safe_text").alias("user"),
    )


def _fixed_prompts(tickets: DataFrame, system: str) -> DataFrame:
    return tickets.select("tweet_id", F.lit(system).alias("system"), F.col("safe_text").alias("user"))


def short_intent_prompts(tickets: DataFrame, per_request: bool = False) -> DataFrame:
    """Messages of the intent call in the risk run or for single requests; expects ``safe_text``."""
    return _fixed_prompts(
        tickets, fv.REQUEST_INTENT_INSTRUCTIONS if per_request else fv.RISK_RUN_INTENT_INSTRUCTIONS
    )


def risk_prompts(tickets: DataFrame, per_request: bool = False) -> DataFrame:
    """Messages of the risk call in the risk run or for single requests; expects ``safe_text``."""
    return _fixed_prompts(
        tickets, fv.REQUEST_RISK_INSTRUCTIONS if per_request else fv.RISK_RUN_RISK_INSTRUCTIONS
    )


def _with_evidence(tickets: DataFrame, evidence: DataFrame, scores: bool) -> DataFrame:
    blocks = evidence_block(evidence, "query_id", scores).withColumnRenamed("query_id", "tweet_id")
    return tickets.join(blocks, "tweet_id", "left").withColumn(
        "evidence", F.coalesce("evidence", F.lit(""))
    )


def draft_prompts(tickets: DataFrame, evidence: DataFrame, brand: str) -> DataFrame:
    """Messages of the drafting call; expects ``safe_text`` and ``intent``."""
    head = F.lit(_instructions(fv.REPLY_INSTRUCTIONS, brand))
    return _with_evidence(tickets, evidence, True).select(
        "tweet_id",
        F.concat(
            head, F.lit("\nIntent: "), "intent",
            F.lit(".\nRetrieved Historical Evidence:\n"), "evidence",
        ).alias("system"),
        F.concat(F.lit("Tweet: "), "safe_text", F.lit("\nDraft:")).alias("user"),
    )


def judge_prompts(tickets: DataFrame, evidence: DataFrame) -> DataFrame:
    """Messages of the judging call; expects ``safe_text`` and ``clean_reply``."""
    return _with_evidence(tickets, evidence, False).select(
        "tweet_id",
        F.lit(fv.JUDGE_INSTRUCTIONS).alias("system"),
        F.concat(
            F.lit("Tweet: "), "safe_text", F.lit("\nReply: "), "clean_reply",
            F.lit("\nEvidence the reply was allowed to use:\n"), "evidence",
        ).alias("user"),
    )


def request_prompt(safe_text: Column, intent: Column) -> Column:
    """User message of the per-request drafting call."""
    return F.concat(
        F.lit("Intent: "), intent, F.lit(".\nTweet: "), safe_text, F.lit("\nDraft:")
    )


def request_system(evidence: Column, brand: str) -> Column:
    """System message of the per-request drafting call; ``evidence`` is a block of bullets."""
    return F.concat(F.lit(_instructions(fv.REQUEST_REPLY_INSTRUCTIONS, brand)), evidence)


def request_prompts(tickets: DataFrame, evidence: DataFrame, brand: str) -> DataFrame:
    """Messages of the per-request drafting call; expects ``safe_text`` and ``intent``."""
    return _with_evidence(tickets, evidence, False).select(
        "tweet_id",
        request_system(F.col("evidence"), brand).alias("system"),
        request_prompt(F.col("safe_text"), F.col("intent")).alias("user"),
    )
