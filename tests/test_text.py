import random
import re

from deskflow.functions import fixed_values as fv
from deskflow.functions import text as tx
from deskflow.functions.sql import register_functions

# Pieces that meet every rule, joined at random; some with characters on which
# regex dialects disagree (accents, superscripts, wide blanks, other digits).
PIECES = [
    "hack", "Hacked", "sue", "issue", "sues", "suing", "ensuing", "suingly", "can't", "cannot", "cant",
    "cancel", "Cancelled", "wont", "won't", "unable", "kill", "skill", "shit", "a@b.co", "a@b.c_x@y.z",
    "x.y+z@mail-host.org.", "555-123-4567", "+1 (555) 123-4567", "5551234567", "(555)123.4567", "12345678901",
    "http://a/555 123 4567", "https://t.co/abc", "www.foo", "wwwx", "http", "é", "²", "٠١٢",
    "٣٤٥٠١٢٣", "\xa0", "　", "\x1c", "\n", "_", "(", ")", "+", "-", ".", "@",
    "\U0001F600", "K", "KİLL", "fraud́", "legal½",
]


def noise(n=1500, seed=7):
    rng = random.Random(seed)
    glue = ["", "", " ", " ", "  ", "\t"]
    return ["".join(rng.choice(PIECES) + rng.choice(glue) for _ in range(rng.randint(0, 8))) for _ in range(n)]


def python_redact(text):
    text = re.sub(fv.EMAIL_PATTERN, fv.EMAIL_TAG, text)
    text = re.sub(fv.PHONE_PATTERN, fv.PHONE_TAG, text)
    return re.sub(fv.URL_PATTERN, fv.URL_TAG, text)


def ascii_redact(text):
    blanks = "[" + re.escape(tx.ECMA_WHITESPACE) + "]"
    phone = fv.PHONE_PATTERN.replace(r"[-.\s]", f"(?:[-.]|{blanks})")
    text = re.sub(fv.EMAIL_PATTERN, fv.EMAIL_TAG, text)
    url = fv.URL_PATTERN.replace(r"\S", "[^" + re.escape(tx.ECMA_WHITESPACE) + "]")
    return re.sub(phone, fv.PHONE_TAG, re.sub(url, fv.URL_TAG, text), flags=re.ASCII)


def python_flag(text, flags=0, lower=True):
    low = text.lower() if lower else text
    stem = "|".join(fv.RISK_STEMS + fv.PROFANITY_STEMS)
    stuck = "|".join(fv.DEAD_END_WORDS)
    risk = re.search(rf"\b(?:(?:{stem})\w*|suing)\b", low, flags)
    dead = re.search(rf"\b(?:{stuck})\b", low, flags) and re.search("cancel", low, flags)
    return bool(risk), bool(dead)


def test_redaction_cases(values):
    got = values(tx.redact_pii, [
        "reach ana-maria+help@mail.example.net, thanks", "ring 020 7946 0958 or 404.555.0123",
        "shots: www.example.org/a?b=1 http://example.net", "nothing private in here", None,
    ])
    assert got == [
        "reach [EMAIL], thanks", "ring 020 7946 0958 or [PHONE]", "shots: [URL] [URL]",
        "nothing private in here", "",
    ]


def test_redaction_of_other_types(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(tx.redact_pii(F.lit(42))).first()[0] == "42"


def test_redaction_order_matters(values):
    text = ["http://a/555 123 4567"]
    assert values(tx.redact_pii, text) == ["[URL]"] or values(tx.redact_pii, text) == [python_redact(text[0])]
    assert values(lambda c: tx.redact_pii(c, "url_first"), text) == ["[URL] 123 4567"]


def test_redaction_matches_python(values):
    texts = noise()
    assert values(tx.redact_pii, texts) == [python_redact(t) for t in texts]
    assert values(lambda c: tx.redact_pii(c, "url_first"), texts) == [ascii_redact(t) for t in texts]


def test_redaction_is_stable_on_its_output(values):
    once = values(tx.redact_pii, noise(300, 3))
    assert values(tx.redact_pii, once) == [python_redact(t) for t in once]


def test_flag_cases(values):
    flagged = [
        "somebody hacked into my profile", "two Unauthorized debits since monday", "so we sue",
        "smells like FRAUD to me", "her lawyers called", "the band is suing again",
        "why cannot I cancel the family plan", "they wont let me cancel",
    ]
    clean = ["tissues and pursuit of a better queue", "cancel it, it is easy", "a shortcut for the album view", None]
    assert values(tx.keyword_flag, flagged + clean) == [True] * 8 + [False] * 4
    assert values(lambda c: tx.predict_escalation(c, c), flagged) == [True] * 8


def test_flag_matches_python(values):
    texts = noise()
    assert values(tx.keyword_flag, texts) == [any(python_flag(t)) for t in texts]


def test_request_rules_match_python(values):
    texts = noise(seed=11)
    expected = [python_flag(t, re.ASCII | re.IGNORECASE, lower=False) for t in texts]
    assert values(tx.risk_hit, texts) == [e[0] for e in expected]
    assert values(tx.dead_end, texts) == [e[1] for e in expected]


def test_simple_intent(values):
    texts = ["Password and refund", "REFUND the bug", "it won't play lyrics", "how do I", "hello", None]
    assert values(tx.simple_intent, texts) == [
        "account_login", "billing_payment", "app_bug", "feature_request", "other", "other",
    ]


def test_tokens(values):
    stop = set(fv.STOP_WORDS)
    texts = noise(400) + ["The app, the APP: don't crash it's 100", ""]
    expected = [[w for w in re.findall("[a-z0-9']+", t.lower()) if len(w) > 2 and w not in stop] for t in texts]
    assert values(tx.tokens, texts) == expected
    assert values(tx.query_tokens, texts) == [list(dict.fromkeys(e)) for e in expected]


def test_parse_bool(values):
    texts = [" True", "TRUE\t", "true", "false", "yes", "", None, "　true\x1c", "truе"]
    assert values(tx.parse_bool, texts) == [True, True, True, False, False, False, False, True, False]


def test_length_predicates(values):
    texts = ["x" * 39, "x" * 40, "x" * 41, None, "\U0001F600" * 39]
    assert values(tx.is_short, texts) == [True, False, False, False, True]
    assert values(tx.is_long, texts) == [False, False, True, False, False]


def test_risk_mask_is_a_substring_test(values):
    assert values(tx.risk_mask, ["an issue", "Angry", "fine", None]) == [True, True, False, False]


def test_request_validation(values):
    texts = [None, " ﻿　", " ok ", "x" * 500, "x" * 501, "\U0001F600" * 250, "\U0001F600" * 251]
    got = values(lambda c: tx.request_error(tx.request_text(c)), texts)
    assert [g is None for g in got] == [False, False, True, True, False, True, False]
    assert values(tx.request_text, [" ok\n"]) == ["ok"]


def test_sql_functions_equal_columns(spark, values):
    from pyspark.sql import functions as F

    register_functions(spark)
    texts = noise(500, 5) + [None]
    for name in ["redact_pii", "keyword_flag", "simple_intent"]:
        column = getattr(tx, name)
        assert values(lambda c: F.call_function(name, c), texts) == values(column, texts)
