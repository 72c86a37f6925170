"""Reports over the log of model calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.model_output import attempt_outcome


def served() -> Column:
    return F.col("status").between(200, 299)


def with_outcome(calls: DataFrame) -> DataFrame:
    """Add ``outcome`` and ``cooldown_s`` to every call."""
    return calls.withColumn("_o", attempt_outcome(F.col("status"), F.col("message"))).select(
        *calls.columns, "_o.*"
    )


def attempt_summary(calls: DataFrame) -> DataFrame:
    """Calls and total cool-down per model and outcome."""
    return (
        with_outcome(calls)
        .groupBy("model", "outcome")
        .agg(
            F.count("*").alias("calls"),
            F.coalesce(F.sum("cooldown_s"), F.lit(0.0)).alias("cooldown_s"),
        )
    )


def model_usage(calls: DataFrame) -> DataFrame:
    """Served calls per model; models that served none do not appear."""
    return calls.where(served()).groupBy("model").agg(F.count("*").alias("calls"))


def served_by(calls: DataFrame) -> DataFrame:
    """The first model, by priority, that answered a ticket."""
    return (
        calls.where(served())
        .groupBy("tweet_id")
        .agg(F.min_by("model", "priority").alias("model"), F.min("priority").alias("priority"))
    )
