"""Text rules as temporary SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import fixed_values as fv
from .text import java_pattern, words_pattern


def _literal(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _redact_sql() -> str:
    text, phone = "coalesce(text, '')", "(?=[+(\\p{Nd}])" + java_pattern(fv.PHONE_PATTERN)
    steps = [
        (fv.EMAIL_PATTERN, fv.EMAIL_TAG, f"contains({text}, '@')"),
        (phone, fv.PHONE_TAG, None),
        (java_pattern(fv.URL_PATTERN), fv.URL_TAG, f"(contains({text}, 'http') OR contains({text}, 'www.'))"),
    ]
    expr = text
    for pattern, tag, needed in steps:
        clean = f"regexp_replace({expr}, {_literal(pattern)}, {_literal(tag)})"
        expr = f"CASE WHEN {needed} THEN {clean} ELSE {expr} END" if needed else clean
    return expr


_LOW = "lower(coalesce(text, ''))"


def _contains_sql(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({_LOW}, {_literal(w)})" for w in words) + ")"


def _keyword_sql() -> str:
    stems = fv.RISK_STEMS + fv.PROFANITY_STEMS
    risk = _literal(words_pattern(stems, fv.RISK_WORDS))
    stuck = _literal(words_pattern([], fv.DEAD_END_WORDS))
    return (
        f"({_contains_sql(stems + fv.RISK_WORDS)} AND {_LOW} RLIKE {risk})"
        f" OR (contains({_LOW}, {_literal(fv.CANCEL_WORD)}) AND {_LOW} RLIKE {stuck})"
    )


def _intent_sql() -> str:
    cases = " ".join(
        f"WHEN {_contains_sql(words)} THEN {_literal(intent)}" for intent, words in fv.INTENT_KEYWORDS
    )
    return f"CASE {cases} ELSE {_literal(fv.OTHER_INTENT)} END"


def register_functions(spark: SparkSession) -> None:
    """Make redact_pii, keyword_flag and simple_intent callable from SQL in this session.

    They are plain SQL expressions, so they stay inside the optimised plan.
    """
    for name, returns, body in [
        ("redact_pii", "STRING", _redact_sql()),
        ("keyword_flag", "BOOLEAN", _keyword_sql()),
        ("simple_intent", "STRING", _intent_sql()),
    ]:
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS {returns} RETURN {body}"
        )
