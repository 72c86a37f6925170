"""Ticket-level operators: validation, defaults, grades, batch scoring."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import request_error, request_text, simple_intent


def validated(df: DataFrame, text: str = "text") -> DataFrame:
    """Trim the ticket text and add ``error``, which is NULL for accepted tickets."""
    return df.withColumn(text, request_text(F.col(text))).withColumn(
        "error", request_error(F.col(text))
    )


def split_valid(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) tickets; rejected ones carry ``error``."""
    checked = validated(df, text)
    return (
        checked.where(F.col("error").isNull()).drop("error"),
        checked.where(F.col("error").isNotNull()),
    )


def first_tickets(df: DataFrame, n: int, id_col: str = "tweet_id") -> DataFrame:
    """The first ``n`` tickets by id."""
    return df.orderBy(id_col).limit(n)


def attach_grades(new: DataFrame, old: DataFrame, on: str = "tweet_id") -> DataFrame:
    """Carry the ``human_*`` columns of an earlier evaluation over to a new one."""
    grades = [c for c in old.columns if c.startswith("human_")]
    return new.join(old.select(on, *grades), on, "left") if grades else new


def fill_missing_outputs(df: DataFrame) -> DataFrame:
    """Stand-ins where no model answered: ``*_payload``, ``*_model`` and ``reply``."""
    intent = json.dumps(
        {"intent": fv.OTHER_INTENT, "confidence": fv.DEFAULT_CONFIDENCE}, separators=(",", ":")
    )
    defaults = {
        "intent_payload": intent,
        "intent_model": fv.FALLBACK_MODEL,
        "risk_payload": '{"risk": false}',
        "risk_model": fv.FALLBACK_MODEL,
        "reply": fv.DRAFT_UNAVAILABLE,
        "draft_model": fv.NO_MODEL,
    }
    return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


Scorer = Callable[[Iterable[str]], Iterable[str]]


def score_tickets(
    df: DataFrame, make_scorer: Callable[[], Scorer] | None = None, text: str = "text"
) -> DataFrame:
    """Add ``payload``, the JSON answer of a caller-supplied model to each text.

    ``make_scorer`` is called once per partition, which is where a model or a client
    connection belongs; it gets the texts of a batch at once.  Without one, the answer is
    the keyword intent with a fixed confidence, made by built-in functions.  Parse the
    answers with ``parse_intent``.
    """
    if make_scorer is None:
        answer = F.struct(
            simple_intent(F.col(text)).alias("intent"), F.lit(fv.DEFAULT_CONFIDENCE).alias("confidence")
        )
        return df.withColumn("payload", F.to_json(answer))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            yield batch.assign(payload=list(scorer(batch[text].fillna(""))))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, payload string")
