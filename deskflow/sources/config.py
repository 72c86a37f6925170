"""Gate configuration: one small JSON document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv

_SCHEMA = (
    "mode string, coefficients struct<confidence: double, retrieval_score: double>, "
    "intercept double, prob_thresh double, expected_auto_handle_rate double, "
    "expected_risk_miss_rate double, note string"
)


@dataclass(frozen=True)
class GateConfig:
    """Fitted gate; plain numbers, so plans see them as literals."""

    w_confidence: float
    w_retrieval: float
    intercept: float
    prob_thresh: float


def load_gate_config(spark: SparkSession, path: str) -> GateConfig | None:
    """The config at ``path``, or None where there is none (fallback gates apply)."""
    try:
        row = spark.read.schema(_SCHEMA).option("multiLine", True).json(path).first()
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    if row is None:
        return None
    return GateConfig(
        row.coefficients.confidence,
        row.coefficients.retrieval_score,
        row.intercept,
        row.prob_thresh,
    )


def gate_config_frame(fit: DataFrame, choice: DataFrame, note: str = "") -> DataFrame:
    """One row in the layout of the config file from a fit and a threshold choice."""
    one = F.lit(1).alias("one")
    return (
        fit.select("w_confidence", "w_retrieval", "intercept", one)
        .join(choice.select("*", one), "one")
        .select(
            F.lit(fv.CONFIG_MODE).alias("mode"),
            F.struct(
                F.col("w_confidence").alias("confidence"),
                F.col("w_retrieval").alias("retrieval_score"),
            ).alias("coefficients"),
            "intercept",
            "prob_thresh",
            F.col("auto_handle_rate").alias("expected_auto_handle_rate"),
            F.col("risk_miss_rate").alias("expected_risk_miss_rate"),
            F.lit(note).alias("note"),
        )
    )


def write_gate_config(config: DataFrame, path: str) -> None:
    config.coalesce(1).write.mode("overwrite").json(path)
