"""Operators over reply threads: brand subset, corpus, samples, leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import is_long, is_short, risk_mask, text_or_empty


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without NULL or NaN in ``columns``."""
    return df.na.drop(subset=columns)


def inbound(df: DataFrame) -> DataFrame:
    return df.where(F.col("inbound"))


def outbound(df: DataFrame) -> DataFrame:
    return df.where(~F.col("inbound"))


def response_ids(col: Column) -> Column:
    """Ids of a response list ("12" or "12,13"); unreadable entries are dropped."""
    ids = F.transform(F.split(col, ","), lambda s: F.trim(s).try_cast("bigint"))
    return F.array_compact(ids)


def brand_subset(threads: DataFrame, brand: str) -> DataFrame:
    """Posts of a brand, posts it answers or that answer it, and mentions of it.

    The reply links are matched as narrow (id, linked id) rows, and only rows
    that are not kept for their author or text meet the matched ids again, so
    the wide rows are shuffled at most once, on the unique ``tweet_id``.  The
    links are exploded without NULLs, so rows without links form no hot key.
    """
    own = F.coalesce(F.col("author_id") == brand, F.lit(False))
    mention = F.lower(text_or_empty(F.col("text"))).contains("@" + brand.lower())
    direct = own | mention

    brand_ids = threads.where(own).select(F.col("tweet_id").alias("linked_id")).distinct()
    links = F.array_append(
        F.coalesce(response_ids(F.col("response_tweet_id")), F.array().cast("array<bigint>")),
        F.col("in_response_to_tweet_id"),
    )
    linked = (
        threads.select("tweet_id", F.explode(F.array_compact(links)).alias("linked_id"))
        .join(brand_ids, "linked_id", "left_semi")
        .select("tweet_id")
    )
    return threads.where(direct).unionByName(
        threads.where(~direct).join(linked, "tweet_id", "left_semi").select(*threads.columns)
    )


def reply_corpus(threads: DataFrame) -> DataFrame:
    """Outbound posts that have a text."""
    return require(
        outbound(threads).select("tweet_id", "text", "in_response_to_tweet_id"), ["text"]
    )


def subset_counts(threads: DataFrame) -> DataFrame:
    return threads.groupBy("inbound").agg(F.count("*").alias("n"))


def sample_order(id_col: Column, seed: int) -> Column:
    """Repeatable pseudo-random sort key of a row."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string")))


# Hex digits of the sort key that are counted: 65,536 prefixes.
PREFIX_DIGITS = 4


def _last_prefixes(keyed: DataFrame, n: int, by: str) -> DataFrame:
    """Per ``by`` group of ``n`` rows or more: the prefix in which its n-th sample_key lies.

    Keys are counted by prefix; nothing is sorted but the counts, and groups are few.
    """
    counts = keyed.groupBy(by, _prefix().alias("prefix")).agg(F.count("*").alias("rows_here"))
    upto = Window.partitionBy(by).orderBy("prefix")
    return (
        counts.withColumn("rows_upto", F.sum("rows_here").over(upto))
        .where(F.col("rows_upto") >= n)
        .groupBy(by)
        .agg(F.min("prefix").alias("last_prefix"))
    )


def _prefix() -> Column:
    return F.substring("sample_key", 1, PREFIX_DIGITS)


def _first_prefixes(keyed: DataFrame, n: int, by: str) -> DataFrame:
    """Drop rows that cannot be among the first ``n`` of their ``by`` group by sample_key.

    What stays are ``n`` rows and those that share the last prefix, a 65,536th of the group.
    """
    return (
        keyed.join(_last_prefixes(keyed, n, by), by, "left")
        .where(F.col("last_prefix").isNull() | (_prefix() <= F.col("last_prefix")))
        .drop("last_prefix")
    )


def sample_n(df: DataFrame, id_col: str, n: int, seed: int = fv.SAMPLE_SEED) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer), the same ones on every run."""
    keyed = df.withColumns({"sample_key": sample_order(F.col(id_col), seed), "sample_group": F.lit(0)})
    first = _first_prefixes(keyed, n, "sample_group")
    return first.orderBy("sample_key", id_col).limit(n).select(*df.columns)


def evidence_sample(
    corpus: DataFrame, n: int = fv.EVIDENCE_ROWS, min_len: int = fv.SHORT_TEXT_CHARS
) -> DataFrame:
    """Sample of replies long enough to be useful as evidence."""
    return sample_n(corpus.where(is_long(F.col("text"), min_len)), "tweet_id", n)


def with_label_columns(df: DataFrame) -> DataFrame:
    """Add the empty columns that a labeller fills in."""
    return df.withColumns({c: F.lit("") for c in ["true_intent", "should_escalate", "notes"]})


def golden_set(threads: DataFrame, seed: int = fv.SAMPLE_SEED) -> DataFrame:
    """Tickets to label: random ones, then risky ones, then short ones, each ticket once.

    A stratum can lose at most the picks of earlier strata, so its first 200 rows (the sum of
    all sizes) are enough.  Texts meet the cut-offs of the three strata as one scalar, not in a
    join; every task keeps its own first 200 rows of a stratum before any row moves, and strata
    are settled on the 600 rows that remain.
    """
    sizes = [fv.GOLDEN_RANDOM_ROWS, fv.GOLDEN_RISK_ROWS, fv.GOLDEN_SHORT_ROWS]
    text, key = F.col("text"), sample_order(F.col("tweet_id"), seed).alias("sample_key")
    member = [F.lit(True), risk_mask(text), is_short(text)]
    in_order = Window.partitionBy("stratum").orderBy("sample_key", "tweet_id")
    same_ticket = Window.partitionBy("tweet_id")

    def strata(*held: Column) -> Column:
        return F.explode(F.array_compact(F.array(*[F.when(h, k) for k, h in enumerate(held)]))).alias("stratum")

    tickets = inbound(threads)
    last = _last_prefixes(tickets.select(key, strata(*member)), sum(sizes), "stratum")
    cuts = last.agg(F.map_from_entries(F.collect_list(F.struct("stratum", "last_prefix"))))
    rows = tickets.select("tweet_id", "text", key, cuts.scalar().alias("cuts"))
    # A stratum of fewer rows has no cut-off and keeps them all.
    first = [F.coalesce(_prefix() <= F.try_element_at("cuts", F.lit(k)), F.lit(True)) for k in range(len(sizes))]
    rows = rows.select("tweet_id", "text", "sample_key", strata(*[m & f for m, f in zip(member, first)]))
    rows = rows.withColumn("place", F.row_number().over(in_order)).where(F.col("place") <= sum(sizes)).drop("place")

    for stratum, size in enumerate(sizes):
        here = F.col("stratum") == stratum
        picked = here & (F.row_number().over(in_order) <= size)
        taken = F.max(F.when(picked, 1).otherwise(0)).over(same_ticket) == 1
        rows = (
            rows.withColumn("picked", picked)
            .withColumn("taken", taken)
            # A ticket picked here leaves all later strata; this stratum keeps its picks only.
            .where(F.when(here, F.col("picked")).otherwise(
                (F.col("stratum") < stratum) | ~F.col("taken")))
        )
    name = F.element_at(F.array(*map(F.lit, ["random", "risk", "short"])), F.col("stratum") + 1)
    return with_label_columns(rows.select("tweet_id", "text", name.alias("stratum")))


def leakage_audit(threads: DataFrame, golden: DataFrame, corpus: DataFrame) -> DataFrame:
    """How many labelled tickets have a response, and how many of those responses
    are in the retrieval corpus.

    The labelled tickets are few; corpus ids meet theirs without being made distinct first,
    since a ticket's matches are reduced to one flag anyway.
    """
    rows = threads.join(golden.select("tweet_id").distinct(), "tweet_id", "left_semi").select(
        "tweet_id", "response_tweet_id",
        F.explode_outer(response_ids(F.col("response_tweet_id"))).alias("rid"),
    )
    known = corpus.select(F.col("tweet_id").alias("rid"), F.lit(True).alias("known"))
    tickets = rows.join(known, "rid", "left").groupBy("tweet_id").agg(
        F.max("response_tweet_id").alias("response"), F.max("known").alias("known")
    )
    return tickets.agg(
        F.count("response").alias("with_response"),
        F.count_if(F.coalesce("known", F.lit(False))).alias("leaked"),
    )
