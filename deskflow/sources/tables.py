"""Stage outputs and report documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Store a stage output: Parquet for the next job, CSV or JSON for people."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
        # spaces at the ends belong to the text
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.format(fmt).save(path)


def write_document(df: DataFrame, path: str) -> None:
    """Store a one-row, one-column document as text."""
    df.coalesce(1).write.mode("overwrite").text(path)


def calibration_json(bins: DataFrame, score: DataFrame) -> DataFrame:
    """One JSON document with the calibration error and its bins (ten at most)."""
    buckets = bins.agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "bin",
                    "n",
                    F.round("mean_conf", 4).alias("mean_conf"),
                    F.round("mean_acc", 4).alias("mean_acc"),
                )
            )
        ).alias("buckets"),
        F.lit(1).alias("one"),
    )
    ece = score.select(F.round("ece", 4).alias("ece"), F.lit(1).alias("one"))
    return ece.join(buckets, "one").select(F.to_json(F.struct("ece", "buckets")).alias("document"))
