"""Are the links of a drafted reply known from past replies?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import extract_urls, is_trusted, sanitize, whitelist_key, whitelist_kind


def build_whitelist(corpus: DataFrame, text: str = "text") -> DataFrame:
    """Distinct (kind, key) of all URLs in the corpus: full paths and bare hosts."""
    url = F.col("url")
    return (
        corpus.select(F.explode(extract_urls(F.col(text))).alias("url"))
        .select(whitelist_kind(url).alias("kind"), whitelist_key(url).alias("key"))
        .distinct()
    )


def reply_urls(replies: DataFrame, id_col: str = "tweet_id", text: str = "reply") -> DataFrame:
    """One row per URL of a reply: id, position, url."""
    return replies.select(id_col, F.posexplode(extract_urls(F.col(text))).alias("pos", "url"))


def violating_urls(
    replies: DataFrame, whitelist: DataFrame, id_col: str = "tweet_id", text: str = "reply"
) -> DataFrame:
    """URLs that are neither trusted nor listed.

    An anti join against distinct keys: no fan-out, and a hot URL is split by
    AQE because the left side of an anti join may be split.
    """
    url = F.col("url")
    return (
        reply_urls(replies, id_col, text)
        .where(~is_trusted(url))
        .withColumns({"kind": whitelist_kind(url), "key": whitelist_key(url)})
        .join(whitelist, ["kind", "key"], "left_anti")
    )


def ground(
    replies: DataFrame, whitelist: DataFrame, id_col: str = "tweet_id", text: str = "reply"
) -> DataFrame:
    """Verify and clean replies.

    Adds ``violations`` (in reply order, duplicates kept), ``passed``,
    ``n_violations``, ``violation_urls`` and ``clean_reply``.  A group of
    collected URLs is never larger than one reply.
    """
    violations = (
        violating_urls(replies, whitelist, id_col, text)
        .groupBy(id_col)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "url"))).alias("found"))
        .select(id_col, F.col("found.url").alias("violations"))
    )
    none = F.array().cast("array<string>")
    return (
        replies.join(violations, id_col, "left")
        .withColumn("violations", F.coalesce("violations", none))
        .withColumns(
            {
                "passed": F.size("violations") == 0,
                "n_violations": F.size("violations"),
                "violation_urls": F.array_join("violations", "; "),
                "clean_reply": sanitize(F.col(text), F.col("violations")),
            }
        )
    )


def grounding_summary(grounded: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Replies, violations and whitelist entries in one row."""
    one = F.lit(1).alias("one")
    found = grounded.agg(
        F.count("*").alias("replies"),
        F.coalesce(F.sum("n_violations"), F.lit(0)).cast("bigint").alias("violations"),
        F.count_if("passed").alias("passed"),
        one,
    )
    listed = whitelist.agg(F.count("*").alias("whitelist_entries"), one)
    return found.join(listed, "one").drop("one")
