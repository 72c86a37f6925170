"""Parsing of model answers and of model-call results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .text import java_pattern


def _field(doc: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(doc, f"$.{name}", kind)


def _type(doc: Column, name: str) -> Column:
    """JSON type of a field, NULL when the field is absent, VOID for a JSON null."""
    return F.schema_of_variant(F.variant_get(doc, f"$.{name}", "variant"))


def _object(col: Column) -> Column:
    """Parsed JSON object, NULL for anything else."""
    doc = F.try_parse_json(col)
    return F.when(F.schema_of_variant(doc).startswith("OBJECT"), doc)


def parse_intent(col: Column, default: str = fv.OTHER_INTENT) -> Column:
    """struct<intent, confidence, parse_error> of a batch answer.

    ``default`` stands in for a missing intent, 0.5 for a missing or unusable
    confidence.  Numeric strings count as numbers.
    """
    doc = _object(col)
    return F.struct(
        F.coalesce(_field(doc, "intent"), F.lit(default)).alias("intent"),
        F.coalesce(
            _field(doc, "confidence").try_cast("double"), F.lit(fv.DEFAULT_CONFIDENCE)
        ).alias("confidence"),
        doc.isNull().alias("parse_error"),
    )


def parse_request_intent(col: Column) -> Column:
    """struct<intent, confidence, parse_error> of a per-request answer.

    An empty intent falls back too, and a JSON null or empty confidence is 0.
    """
    doc = _object(col)
    kind = _type(doc, "confidence")
    raw = _field(doc, "confidence")
    number = (
        F.when((kind == "VOID") | (F.trim(raw) == ""), F.lit(0.0))
        .when(kind == "BOOLEAN", F.when(raw == "true", 1.0).otherwise(0.0))
        .otherwise(raw.try_cast("double"))
    )
    finite = F.when(F.abs(number) < F.lit(float("inf")), number)
    intent = _field(doc, "intent")
    return F.struct(
        F.when(intent != "", intent).otherwise(fv.OTHER_INTENT).alias("intent"),
        F.coalesce(finite, F.lit(fv.DEFAULT_CONFIDENCE)).alias("confidence"),
        doc.isNull().alias("parse_error"),
    )


def parse_risk(col: Column, empty_container: bool = False) -> Column:
    """struct<risk, parse_error>; ``risk`` is the truth value of the field.

    A non-empty string counts as true whatever it says, zero, null and the empty
    string as false.  ``empty_container`` is the truth value of [] and {}
    (False in batch answers, True in per-request ones).
    """
    doc = _object(col)
    kind = _type(doc, "risk")
    raw = _field(doc, "risk")
    nested = kind.startswith("ARRAY") | kind.startswith("OBJECT")
    is_empty = F.to_json(F.variant_get(doc, "$.risk", "variant")).isin("[]", "{}")
    truth = (
        F.when(kind.isNull() | (kind == "VOID"), False)
        .when(kind == "BOOLEAN", raw == "true")
        .when(kind == "STRING", raw != "")
        .when(nested, ~is_empty | F.lit(empty_container))
        .otherwise(raw.try_cast("double") != 0)
    )
    return F.struct(
        F.coalesce(truth, F.lit(False)).alias("risk"), doc.isNull().alias("parse_error")
    )


def parse_judge(col: Column) -> Column:
    """struct of the three scores, the critique and parse_error; absent fields are NULL."""
    doc = _object(col)
    scores = [_field(doc, m).try_cast("double").alias(m) for m in fv.JUDGE_METRICS]
    return F.struct(
        *scores, _field(doc, "critique").alias("critique"), doc.isNull().alias("parse_error")
    )


def cooldown_seconds(message: Column) -> Column:
    """Waiting time named in a rate-limit message."""
    low = F.lower(F.coalesce(message, F.lit("")))
    pattern = java_pattern(fv.RETRY_PATTERN)
    minutes = F.regexp_extract(low, pattern, 1).try_cast("double")
    seconds = F.regexp_extract(low, pattern, 2).try_cast("double")
    daily = low.contains(fv.DAILY_LIMIT_TEXTS[0]) | low.contains(fv.DAILY_LIMIT_TEXTS[1])
    named = F.coalesce(minutes, F.lit(0.0)) * 60 + seconds + fv.RETRY_MARGIN_SECONDS
    return F.when(daily, fv.DAILY_COOLDOWN_SECONDS).otherwise(
        F.coalesce(named, F.lit(fv.DEFAULT_COOLDOWN_SECONDS))
    )


def attempt_outcome(status: Column, message: Column) -> Column:
    """struct<outcome, cooldown_s> of one call; a NULL status is a transport error."""
    outcome = (
        F.when(status.isNull(), "cooldown")
        .when(status.between(200, 299), "served")
        .when(status.isin(fv.REMOVED_STATUSES), "removed")
        .otherwise("cooldown")
    )
    wait = (
        F.when(status.isNull(), fv.TRANSPORT_COOLDOWN_SECONDS)
        .when(status == fv.RATE_LIMIT_STATUS, cooldown_seconds(message))
        .when(outcome == "cooldown", fv.STATUS_COOLDOWN_SECONDS)
    )
    return F.struct(outcome.alias("outcome"), wait.alias("cooldown_s"))
