"""Column expressions over ticket text (JVM side, no UDFs)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv

# Java's \w, \d, \s and \b mean something else than the dialects the patterns
# were written in, so each shorthand is spelled out: "unicode" is the Python
# meaning, "ascii" the JavaScript one (whose \s is nevertheless Unicode).
_WIDE_BLANKS = [
    (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F),
    (0x205F, 0x205F), (0x3000, 0x3000),
]
_PYTHON_BLANKS = [(0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), *_WIDE_BLANKS]
_ECMA_BLANKS = [(0x09, 0x0D), (0x20, 0x20), (0xFEFF, 0xFEFF), *_WIDE_BLANKS]


def _characters(ranges: list[tuple[int, int]]) -> str:
    return "".join(chr(c) for first, last in ranges for c in range(first, last + 1))


def _class_items(ranges: list[tuple[int, int]]) -> str:
    return "".join(f"\\x{{{first:x}}}-\\x{{{last:x}}}" for first, last in ranges)


PYTHON_WHITESPACE = _characters(_PYTHON_BLANKS)
ECMA_WHITESPACE = _characters(_ECMA_BLANKS)
_CLASSES = {
    "unicode": (r"[\p{L}\p{N}_]", r"\p{Nd}", _class_items(_PYTHON_BLANKS)),
    "ascii": (r"[a-zA-Z0-9_]", r"[0-9]", _class_items(_ECMA_BLANKS)),
}


def java_pattern(pattern: str, dialect: str = "unicode") -> str:
    """Spell out the shorthands of ``pattern`` for Spark's regex functions.

    ``\\s`` may only be used inside a character class, the other shorthands only
    outside; that holds for every pattern in ``fixed_values``.
    """
    word, digit, space = _CLASSES[dialect]
    edge = f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
    spelled = {r"\b": edge, r"\w": word, r"\d": digit, r"\s": space, r"\S": f"[^{space}]"}
    return re.sub(r"\\[bwdsS]", lambda m: spelled[m.group()], pattern)


def words_pattern(stems: list[str], words: list[str], dialect: str = "unicode") -> str:
    """Pattern for a stem at the start of a word, or one of ``words`` as a whole."""
    word = _CLASSES[dialect][0]
    whole = [f"{re.escape(w)}(?!{word})" for w in words]
    return f"(?<!{word})(?:{'|'.join([*map(re.escape, stems), *whole])})"


def contains_any(col: Column, words: list[str]) -> Column:
    """Plain substring test; much cheaper than a regular expression."""
    return reduce(lambda acc, w: acc | w, [col.contains(w) for w in words])


def _has_word(low: Column, stems: list[str], words: list[str], dialect: str = "unicode") -> Column:
    # Few texts contain a stem at all; only those are searched for word limits.
    found = contains_any(low, [*stems, *words])
    return found & low.rlike(words_pattern(stems, words, dialect))


def text_or_empty(col: Column) -> Column:
    """Value as text, NULL as the empty string."""
    return F.coalesce(col.cast("string"), F.lit(""))


def redact_pii(col: Column, order: str = "phone_first") -> Column:
    """Replace e-mail addresses, phone numbers and URLs by tags.

    ``phone_first`` is the batch behaviour.  ``url_first`` is the per-request
    one: URLs go before phone numbers, and ``\\b``/``\\d`` are ASCII.
    """
    dialect, phone_first = {"phone_first": ("unicode", True), "url_first": ("ascii", False)}[order]
    text = text_or_empty(col)

    def email(t: Column) -> Column:
        clean = F.regexp_replace(t, fv.EMAIL_PATTERN, fv.EMAIL_TAG)
        return F.when(text.contains("@"), clean).otherwise(t)

    def phone(t: Column) -> Column:
        # The look-ahead only rejects positions at which no number can start.
        digit = _CLASSES[dialect][1]
        pattern = f"(?=[+({digit}])" + java_pattern(fv.PHONE_PATTERN, dialect)
        return F.regexp_replace(t, pattern, fv.PHONE_TAG)

    def url(t: Column) -> Column:
        clean = F.regexp_replace(t, java_pattern(fv.URL_PATTERN, dialect), fv.URL_TAG)
        return F.when(contains_any(text, ["http", "www."]), clean).otherwise(t)

    return url(phone(email(text))) if phone_first else phone(url(email(text)))


def keyword_flag(col: Column) -> Column:
    """Risk stem, or a cancellation that the writer cannot complete, or profanity."""
    low = F.lower(text_or_empty(col))
    return (
        _has_word(low, fv.RISK_STEMS + fv.PROFANITY_STEMS, fv.RISK_WORDS)
        | (low.contains(fv.CANCEL_WORD) & _has_word(low, [], fv.DEAD_END_WORDS))
    )


def predict_escalation(text: Column, intent: Column | None = None) -> Column:
    """Rule-layer escalation; the intent has no influence."""
    return keyword_flag(text)


def risk_hit(col: Column) -> Column:
    """Per-request risk rule: risk and profanity in one, ASCII letters in any case."""
    text, stems = text_or_empty(col), fv.RISK_STEMS + fv.PROFANITY_STEMS
    pattern = "(?i)" + words_pattern(stems, fv.RISK_WORDS, "ascii")
    return contains_any(F.lower(text), [*stems, *fv.RISK_WORDS]) & text.rlike(pattern)


def dead_end(col: Column) -> Column:
    """Per-request cancellation dead-end rule."""
    text = text_or_empty(col)
    pattern = "(?i)" + words_pattern([], fv.DEAD_END_WORDS, "ascii")
    return F.lower(text).contains(fv.CANCEL_WORD) & text.rlike(pattern)


def simple_intent(col: Column) -> Column:
    """Keyword intent, first matching group wins."""
    low = F.lower(text_or_empty(col))
    first, *rest = [(contains_any(low, words), intent) for intent, words in fv.INTENT_KEYWORDS]
    case = reduce(lambda acc, b: acc.when(b[0], b[1]), rest, F.when(*first))
    return case.otherwise(fv.OTHER_INTENT)


def trivial_intent() -> Column:
    return F.lit(fv.OTHER_INTENT)


def trivial_escalation() -> Column:
    return F.lit(True)


def risk_mask(col: Column) -> Column:
    """Substring test that selects the risk stratum; NULL text is not in it."""
    return F.coalesce(contains_any(F.lower(col), fv.STRATUM_RISK_WORDS), F.lit(False))


def tokens(col: Column) -> Column:
    """Words of at least three characters that are not stop words, duplicates kept."""
    pattern = f"{fv.TOKEN_CHARACTER}{{{fv.MIN_TOKEN_CHARS},}}"
    words = F.regexp_extract_all(F.lower(text_or_empty(col)), F.lit(pattern), F.lit(0))
    stop = [w for w in fv.STOP_WORDS if len(w) >= fv.MIN_TOKEN_CHARS]
    return F.filter(words, lambda w: ~w.isin(stop))


def query_tokens(col: Column) -> Column:
    """Token set of a query."""
    return F.array_distinct(tokens(col))


def parse_bool(col: Column) -> Column:
    """True only for the word "true" in any case, surrounding blanks ignored."""
    stripped = F.btrim(F.lower(col.cast("string")), F.lit(PYTHON_WHITESPACE))
    return F.coalesce(stripped == "true", F.lit(False))


def is_short(col: Column, limit: int = fv.SHORT_TEXT_CHARS) -> Column:
    return F.coalesce(F.length(col) < limit, F.lit(False))


def is_long(col: Column, limit: int = fv.SHORT_TEXT_CHARS) -> Column:
    return F.coalesce(F.length(col) > limit, F.lit(False))


def request_text(col: Column) -> Column:
    """Trimmed ticket text of a request, NULL as the empty string."""
    return F.btrim(text_or_empty(col), F.lit(ECMA_WHITESPACE))


def request_error(trimmed: Column) -> Column:
    """Error text for an empty or too long request, else NULL.

    The limit counts UTF-16 units: characters outside the basic plane are two.
    """
    units = F.length(F.regexp_replace(trimmed, r"[\x{10000}-\x{10FFFF}]", "xx"))
    too_long = (F.length(trimmed) > fv.MAX_TICKET_CHARS) | (units > fv.MAX_TICKET_CHARS)
    return F.when((trimmed == "") | too_long, F.lit(fv.TICKET_LENGTH_ERROR))
