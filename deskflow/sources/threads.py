"""Thread and reply-corpus sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

THREAD_SCHEMA = T.StructType(
    [
        T.StructField("tweet_id", T.LongType()),
        T.StructField("author_id", T.StringType()),
        T.StructField("inbound", T.BooleanType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("response_tweet_id", T.StringType()),
        T.StructField("in_response_to_tweet_id", T.LongType()),
    ]
)


def _quoted_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Quoted CSV with line breaks inside fields, all columns as text.

    A multi-line file is read by one task, so a large export should be a folder
    of many files; convert it once with ``write_table`` and work on Parquet.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return raw.select(*columns)


def _id(name: str):
    """Integer id; exports that passed through a float column end in ".0"."""
    return F.regexp_replace(F.col(name), r"\.0$", "").cast("bigint").alias(name)


def read_threads(spark: SparkSession, path: str) -> DataFrame:
    """Thread table from a CSV file or folder; unread columns are pruned."""
    raw = _quoted_csv(spark, path, THREAD_SCHEMA.fieldNames())
    return raw.select(
        _id("tweet_id"),
        "author_id",
        F.col("inbound").cast("boolean").alias("inbound"),
        "created_at",
        "text",
        F.regexp_replace("response_tweet_id", r"\.0$", "").alias("response_tweet_id"),
        _id("in_response_to_tweet_id"),
    )


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Reply corpus from a CSV file or folder, NULL text as the empty string."""
    raw = _quoted_csv(spark, path, ["tweet_id", "text", "in_response_to_tweet_id"])
    return fill_text(raw.select(_id("tweet_id"), "text", _id("in_response_to_tweet_id")))


def fill_text(df: DataFrame) -> DataFrame:
    return df.na.fill("", ["text"])
