"""The registered queries once more, as SQL for DuckDB over the driver's tables.

Written from the meaning of each operator, not from the Spark plans: sweeps are
plain cross joins here, for instance.
"""

from __future__ import annotations

import re

from .views import PHRASES


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_PHRASES = ", ".join(f"({i}, {_quote(p)}, {_quote(intent)})" for i, (p, intent) in enumerate(PHRASES))

# Gate used by the queries, see views.GATE.
_Z = "1.75e0 * confidence + (-0.5e0) * retrieval_score + (-0.625e0)"
_SCORE = f"1e0 / (1e0 + exp(-least(greatest({_Z}, -700e0), 700e0)))"

# Patterns and word lists that the results depend on.
_EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
_PHONE = r"\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
_URL = r"http\S+|www\.\S+"
_NOT_WORD = r"[^\p{L}\p{N}_]"
_STEMS = "hack|stol|steal|fraud|lawyer|legal|sue|unauthoriz|compromis|phish|scam|threat"
_RUDE = "fuck|shit|bitch|kill"
_STUCK = "can't|cannot|cant|unable|won't|wont"


def _redact(col: str, first: str = "phone") -> str:
    out = f"regexp_replace({col}, '{_EMAIL}', '[EMAIL]', 'g')"
    steps = [(_PHONE, "[PHONE]"), (_URL, "[URL]")]
    for pattern, tag in steps if first == "phone" else steps[::-1]:
        out = f"regexp_replace({out}, '{pattern}', '{tag}', 'g')"
    return out


def _word(col: str, alternatives: str, whole: bool = False) -> str:
    right = f"(?:$|{_NOT_WORD})" if whole else ""
    return f"regexp_matches(lower({col}), {_quote(f'(?:^|{_NOT_WORD})(?:{alternatives}){right}')})"


def _stuck(col: str) -> str:
    return f"(contains(lower({col}), 'cancel') AND {_word(col, _STUCK, True)})"


def _keyword(col: str) -> str:
    return (f"({_word(col, _STEMS)} OR {_word(col, 'suing', True)} OR {_stuck(col)}"
            f" OR {_word(col, _RUDE)})")


def _risk_hit(col: str) -> str:
    """Per-request rule: ASCII word characters."""
    edge = "[^a-zA-Z0-9_]"
    stems = f"(?i)(?:^|{edge})(?:(?:{_STEMS}|{_RUDE})|suing(?:$|{edge}))"
    return f"regexp_matches({col}, '{stems}')"


def _request_stuck(col: str) -> str:
    edge = "[^a-zA-Z0-9_]"
    return (f"(contains(lower({col}), 'cancel') AND regexp_matches({col}, "
            f"{_quote(f'(?i)(?:^|{edge})(?:{_STUCK})(?:$|{edge})')}))")


def _intent(col: str) -> str:
    groups = [
        ("account_login", ["password", "login", "sign in", "hacked", "stolen", "account"]),
        ("billing_payment", ["charge", "refund", "premium", "billing", "invoice", "cancel"]),
        ("app_bug", ["crash", "bug", "won't play", "freeze", "error", "doesn't work"]),
        ("feature_request", ["add feature", "lyrics", "wish", "suggest", "how do i"]),
    ]
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({col}), {_quote(w)})" for w in words) + f" THEN '{name}'"
        for name, words in groups
    )
    return f"CASE {cases} ELSE 'other' END"


_STOP = ("a an the and or but if then than that this these those i you he she it we they me my your is"
         " are was were be been am do does did not no so of in on at to for with about into over after"
         " from by as").split()


def _tokens(col: str) -> str:
    stop = ", ".join(f"'{w}'" for w in _STOP)
    return (f"list_filter(regexp_extract_all(lower({col}), '[a-z0-9'']+'), "
            f"lambda w: length(w) > 2 AND NOT list_contains([{stop}], w))")


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"

def _newton(k: int) -> str:
    """One Newton step of the gate's fit: w0, w1 (penalised) and the intercept w2."""
    before = f"fit_{k - 1}" if k > 1 else "(SELECT 0e0 AS w0, 0e0 AS w1, 0e0 AS w2)"
    return f"""
      SELECT w0 - (g0 * (e * f - d * d) - b * (g1 * f - d * g2) + c * (g1 * d - e * g2)) / det AS w0,
        w1 - (a * (g1 * f - d * g2) - g0 * (b * f - d * c) + c * (b * g2 - g1 * c)) / det AS w1,
        w2 - (a * (e * g2 - g1 * d) - b * (b * g2 - g1 * c) + g0 * (b * d - e * c)) / det AS w2
      FROM (SELECT *, a * (e * f - d * d) - b * (b * f - d * c) + c * (b * d - e * c) AS det FROM (
        SELECT w0, w1, w2, sum(r * x) + w0 AS g0, sum(r * y) + w1 AS g1, sum(r) AS g2,
          sum(h * x * x) + 1 AS a, sum(h * x * y) AS b, sum(h * x) AS c, sum(h * y) AS d, sum(h * y * y) + 1 AS e, sum(h) AS f
        FROM (SELECT *, wt * (p - label) AS r, wt * p * (1 - p) AS h FROM (
          SELECT *, 1 / (1 + exp(-(w0 * x + w1 * y + w2))) AS p FROM fit_rows, {before})) GROUP BY w0, w1, w2))"""


CTES = {
    "phrases": f"SELECT * FROM (VALUES {_PHRASES}) AS p(pid, phrase, intent)",
    "tickets": """
      SELECT d.doc_id AS tweet_id, p.phrase || ' ' || d.text AS text, p.intent AS true_intent,
        CASE WHEN d.doc_id % 97 = 0 THEN 'error' WHEN d.doc_id % 6 = 0 THEN 'other' ELSE p.intent END AS pred_intent,
        (30 + (d.doc_id * 37) % 71)::DOUBLE / 100::DOUBLE AS confidence,
        (20 + (d.doc_id * 53) % 71)::DOUBLE / 100::DOUBLE AS retrieval_score,
        (p.pid IN (0, 8) OR d.doc_id % 23 = 0) AS llm_risk,
        (p.pid IN (0, 6, 8) OR coalesce(l.toxic, 0) = 1) AS true_escalate,
        CASE WHEN (p.pid IN (0, 6, 8) OR coalesce(l.toxic, 0) = 1)
          THEN CASE d.doc_id % 3 WHEN 0 THEN ' True' WHEN 1 THEN 'TRUE' || chr(9) ELSE 'true' END
          ELSE CASE d.doc_id % 3 WHEN 0 THEN 'False' WHEN 1 THEN NULL ELSE 'no' END END AS should_escalate,
        (1 + (d.doc_id * 11) % 5)::INT AS judge_groundedness,
        (1 + (d.doc_id * 7) % 5)::INT AS judge_safety,
        (1 + (d.doc_id * 13) % 5)::INT AS judge_helpfulness,
        CASE WHEN d.doc_id % 9 = 0 THEN NULL ELSE (1 + (d.doc_id * 5 + d.doc_id % 3) % 5)::INT END AS human_groundedness,
        CASE WHEN d.doc_id % 10 = 0 THEN NULL ELSE (1 + (d.doc_id * 3 + d.doc_id % 7) % 5)::INT END AS human_safety,
        CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE (1 + (d.doc_id * 13 + d.doc_id % 4) % 5)::INT END AS human_helpfulness
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id JOIN phrases p ON p.pid = d.doc_id % 16""",
    "threads": """
      SELECT c.conv_id * 100 + c.turn AS tweet_id,
        CASE WHEN c.role <> 'assistant' THEN 'user' || c.conv_id::VARCHAR
          WHEN c.conv_id % 3 = 0 THEN 'OtherBrand' ELSE 'BrandCares' END AS author_id,
        (c.role <> 'assistant') AS inbound, '2021-03-04 05:' || lpad((c.turn % 60)::VARCHAR, 2, '0') AS created_at,
        CASE WHEN c.role <> 'assistant' AND c.conv_id % 7 = 0 THEN '@brandCARES ' ELSE '' END || p.phrase
          || ' ' || c.text AS text,
        CASE WHEN c.conv_id % 5 = 0
          THEN (lead(c.conv_id * 100 + c.turn) OVER w)::VARCHAR || ',' || (c.conv_id * 100 + 99)::VARCHAR
          ELSE (lead(c.conv_id * 100 + c.turn) OVER w)::VARCHAR END AS response_tweet_id,
        lag(c.conv_id * 100 + c.turn) OVER w AS in_response_to_tweet_id
      FROM conversations c JOIN phrases p ON p.pid = (c.conv_id + c.turn) % 16
      WINDOW w AS (PARTITION BY c.conv_id ORDER BY c.turn)
      UNION ALL SELECT c.conv_id * 100 + 97, 'guest' || c.conv_id::VARCHAR, true, '2021-03-04 04:59', p.phrase, NULL, NULL
      FROM conversations c JOIN phrases p ON p.pid = c.conv_id % 16 WHERE c.turn = 0""",
    "subset": """
      SELECT t.* FROM threads t WHERE author_id = 'BrandCares' OR contains(lower(coalesce(text, '')), '@brandcares')
        OR in_response_to_tweet_id IN (SELECT tweet_id FROM threads WHERE author_id = 'BrandCares')
        OR EXISTS (SELECT 1 FROM threads b WHERE b.author_id = 'BrandCares'
          AND list_contains(string_split(t.response_tweet_id, ','), b.tweet_id::VARCHAR))""",
    "reply_posts": """
      SELECT tweet_id, text, in_response_to_tweet_id FROM threads WHERE NOT inbound AND text IS NOT NULL""",
    "customers": "SELECT tweet_id, text, md5('42:' || tweet_id::VARCHAR) AS k FROM threads WHERE inbound",
    "g_random": "SELECT * FROM customers ORDER BY k, tweet_id LIMIT 100",
    "g_risk": """
      SELECT * FROM customers WHERE regexp_matches(lower(text),
        'hack|stolen|fraud|lawyer|sue|refund|cancel|scam|unauthorized|angry')
      AND tweet_id NOT IN (SELECT tweet_id FROM g_random) ORDER BY k, tweet_id LIMIT 50""",
    "g_short": """
      SELECT * FROM customers WHERE length(text) < 40
      AND tweet_id NOT IN (SELECT tweet_id FROM g_random) AND tweet_id NOT IN (SELECT tweet_id FROM g_risk)
      ORDER BY k, tweet_id LIMIT 50""",
    "golden": """
      SELECT tweet_id, text, 'random' AS stratum FROM g_random UNION ALL
      SELECT tweet_id, text, 'risk' FROM g_risk UNION ALL SELECT tweet_id, text, 'short' FROM g_short""",
    "corpus": """
      SELECT page_id AS tweet_id, 'Try ' || url || ' for help'
        || CASE WHEN page_id % 10 = 0 THEN ' or https://help.example.org' ELSE '' END AS text
      FROM pages""",
    "replies": """
      SELECT page_id AS tweet_id, 'See ' || url || CASE WHEN page_id % 7 = 0 THEN ' https://unlisted.example.org/p' || page_id::VARCHAR
        WHEN page_id % 11 = 0 THEN ' https://t.co/zzz'
        WHEN page_id % 13 = 0 THEN ' https://help.example.org/'
        WHEN page_id % 17 = 0 THEN ' https://nowhere.example.org' ELSE '' END AS reply FROM pages""",
    "model_calls": """
      SELECT event_id AS call_id, event_id // 3 AS tweet_id, event_id % 3 AS priority,
        'model-' || (event_id % 3)::VARCHAR AS model,
        CASE event_type WHEN 'error' THEN 429 WHEN 'signup' THEN 404 ELSE 200 END AS status,
        CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 4 = 0 THEN 'limit on tokens per day'
          WHEN event_id % 4 = 1 THEN 'try again in 2m3.5s' WHEN event_id % 4 = 2 THEN 'try again in 7s'
          ELSE 'slow down' END AS message,
        CASE event_id % 5 WHEN 0 THEN '{"intent":"app_bug","confidence":0.9}'
          WHEN 1 THEN '{"intent":"other","confidence":"0.8"}' WHEN 2 THEN '{"confidence":null}'
          WHEN 3 THEN '{"risk":true}' ELSE 'not json' END AS payload FROM events""",
    "answers": """
      SELECT tweet_id,
        max(payload) FILTER (priority = 0) AS intent_payload, max(model) FILTER (priority = 0) AS intent_model,
        max(payload) FILTER (priority = 1) AS risk_payload, max(model) FILTER (priority = 1) AS risk_model,
        max(payload) FILTER (priority = 2) AS reply, max(model) FILTER (priority = 2) AS draft_model
      FROM model_calls WHERE status = 200 GROUP BY tweet_id""",
    "waits": """
      SELECT *, CASE WHEN contains(lower(message), 'tokens per day') OR contains(lower(message), 'requests per day')
          THEN 21600e0
        WHEN regexp_matches(lower(message), 'try again in (?:(\\d+)m)?(\\d+\\.?\\d*)s') THEN
          coalesce(try_cast(regexp_extract(lower(message), 'try again in (?:(\\d+)m)?(\\d+\\.?\\d*)s', 1) AS DOUBLE), 0e0) * 60
          + regexp_extract(lower(message), 'try again in (?:(\\d+)m)?(\\d+\\.?\\d*)s', 2)::DOUBLE + 5
        ELSE 60e0 END AS wait FROM model_calls""",
    "outcomes": """
      SELECT *, CASE WHEN status BETWEEN 200 AND 299 THEN 'served' WHEN status IN (400, 401, 403, 404) THEN 'removed'
          ELSE 'cooldown' END AS outcome,
        CASE WHEN status = 429 THEN wait WHEN status BETWEEN 200 AND 299 OR status IN (400, 401, 403, 404) THEN NULL
          WHEN status IS NULL THEN 15e0 ELSE 30e0 END AS cooldown_s FROM waits""",
    "redacted": f"SELECT *, {_redact('text')} AS safe_text FROM tickets",
    "decided": f"""
      SELECT *, reason_code <> 'safe' AS pred_escalate FROM (
        SELECT *, CASE WHEN {_keyword('safe_text')} THEN 'keyword' WHEN llm_risk THEN 'model_risk'
          WHEN risk_score >= 0.5e0 THEN 'risk_score' ELSE 'safe' END AS reason_code
        FROM (SELECT *, {_SCORE} AS risk_score FROM redacted))""",
    "rule_layer": f"SELECT * , {_keyword('safe_text')} AS pred_escalate FROM redacted",
    "flagged": f"SELECT *, {_keyword('text')} AS kw, {_SCORE} AS risk_score FROM tickets",
    "steps": """
      SELECT i, 0.05e0 + i * ((0.05e0 + 0.05e0) - 0.05e0) AS t FROM range(19) r(i)""",
    "conf_steps": "SELECT 0.5e0 + i * ((0.5e0 + 0.05e0) - 0.5e0) AS c FROM range(10) r(i)",
    "ret_steps": "SELECT 0.2e0 + i * ((0.2e0 + 0.05e0) - 0.2e0) AS r FROM range(9) r(i)",
    "grid": """
      SELECT c, r, count(*) AS n, count(*) FILTER (auto) AS n_auto, count(*) FILTER (auto AND true_escalate) AS misses,
        count(*) FILTER (true_escalate) AS risks
      FROM (SELECT c, r, true_escalate, NOT (confidence < c OR retrieval_score < r OR kw OR llm_risk) AS auto
        FROM flagged, conf_steps, ret_steps) GROUP BY c, r""",
    "grid_rates": """
      SELECT round(c, 2) AS conf_thresh, round(r, 2) AS ret_thresh, round(n_auto / n, 4) AS auto_handle_rate,
        round(CASE WHEN n_auto > 0 THEN misses / n_auto ELSE 0 END, 4) AS volume_false_auto,
        round(CASE WHEN risks > 0 THEN misses / risks ELSE 0 END, 4) AS risk_miss_rate FROM grid""",
    "fit_rows": """
      SELECT confidence AS x, retrieval_score AS y, true_escalate::INT::DOUBLE AS label,
        CASE WHEN true_escalate THEN (SELECT count(*) / (2 * count(*) FILTER (true_escalate)) FROM tickets)
          ELSE (SELECT count(*) / (2 * count(*) FILTER (NOT true_escalate)) FROM tickets) END AS wt
      FROM tickets""",
    # Twelve Newton steps; each solves three equations by determinants.
    **{f"fit_{k}": _newton(k) for k in range(1, 13)},
    "refit": f"""
      SELECT f.*, 1 / (1 + exp(-(w0 * confidence + w1 * retrieval_score + w2))) AS refit_score FROM redacted f, fit_12""",
    "refit_curve": f"""
      SELECT t, count(*) AS n, count(*) FILTER (auto) AS n_auto,
        count(*) FILTER (auto AND true_escalate) AS misses, count(*) FILTER (true_escalate) AS risks
      FROM (SELECT t, true_escalate, NOT (refit_score >= t OR {_keyword('text')} OR llm_risk) AS auto FROM refit, steps) GROUP BY t""",
    "refit_cut": """
      SELECT coalesce(max(t), 0.5e0) AS cut FROM (
        SELECT round(t, 2) AS t FROM refit_curve WHERE misses / risks <= 0.25e0 ORDER BY n_auto DESC, t LIMIT 1)""",
    "classes": """
      SELECT label, count(*) FILTER (true_intent = label AND pred_intent = label) AS tp,
        count(*) FILTER (true_intent <> label AND pred_intent = label) AS fp,
        count(*) FILTER (true_intent = label AND pred_intent <> label) AS fn
      FROM tickets, (SELECT true_intent AS label FROM tickets UNION SELECT pred_intent FROM tickets) GROUP BY label""",
    "class_f1": "SELECT *, CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM classes",
    "systems": f"""
      SELECT 'trivial' AS system, true_intent, true_escalate, 'other' AS intent, true AS escalate FROM tickets
      UNION ALL SELECT 'keyword', true_intent, true_escalate, {_intent('text')}, {_keyword('text')} FROM tickets
      UNION ALL SELECT 'main', true_intent, true_escalate, pred_intent, pred_escalate FROM rule_layer""",
    "system_f1": """
      SELECT system, avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END) AS macro_f1 FROM (
        SELECT s.system, label, count(*) FILTER (true_intent = label AND intent = label) AS tp,
          count(*) FILTER (true_intent <> label AND intent = label) AS fp,
          count(*) FILTER (true_intent = label AND intent <> label) AS fn
        FROM systems s JOIN (SELECT system, true_intent AS label FROM systems UNION SELECT system, intent FROM systems) l
          ON s.system = l.system GROUP BY s.system, label) GROUP BY system""",
    "bins": """
      SELECT i, CASE WHEN i = 0 THEN '(-0.001, 0.1]'
        ELSE '(' || (i / 10)::DECIMAL(2, 1)::VARCHAR || ', ' || ((i + 1) / 10)::DECIMAL(2, 1)::VARCHAR || ']' END AS bin,
        confidence, (true_intent = pred_intent)::INT AS hit
      FROM tickets JOIN range(10) b(i)
        ON (confidence > i * 0.1e0 OR (i = 0 AND confidence = 0)) AND confidence <= (i + 1) * 0.1e0""",
    "grades": """
      SELECT m.metric, human, judge FROM tickets, LATERAL (VALUES
        ('groundedness', human_groundedness::DOUBLE, judge_groundedness::DOUBLE),
        ('safety', human_safety::DOUBLE, judge_safety::DOUBLE),
        ('helpfulness', human_helpfulness::DOUBLE, judge_helpfulness::DOUBLE)) m(metric, human, judge)
      WHERE human IS NOT NULL AND judge IS NOT NULL""",
    "complete_grades": """
      SELECT m.metric, human, judge FROM tickets, LATERAL (VALUES
        ('groundedness', human_groundedness::DOUBLE, judge_groundedness::DOUBLE),
        ('safety', human_safety::DOUBLE, judge_safety::DOUBLE),
        ('helpfulness', human_helpfulness::DOUBLE, judge_helpfulness::DOUBLE)) m(metric, human, judge)
      WHERE human_groundedness IS NOT NULL AND human_safety IS NOT NULL AND human_helpfulness IS NOT NULL
        AND judge IS NOT NULL""",
    "pairs": """
      SELECT a.vec_id AS query_id, b.vec_id AS corpus_id,
        round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
          / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))
          / sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 9) AS score
      FROM embeddings a, embeddings b""",
    "dense": """
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id) AS rk FROM pairs""",
    "q_words": f"SELECT item_id AS query_id, list_distinct({_tokens('text')}) AS words FROM benchmark",
    "c_words": f"SELECT doc_id AS corpus_id, {_tokens('text')} AS words FROM documents",
    "lexical": """
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id) AS rk FROM (
        SELECT query_id, corpus_id, count(*)::DOUBLE / sqrt((any_value(ql) * any_value(cl))::DOUBLE) AS score
        FROM (SELECT query_id, len(words) AS ql, unnest(words) AS w FROM q_words)
        JOIN (SELECT corpus_id, len(words) AS cl, unnest(words) AS w FROM c_words) USING (w)
        GROUP BY query_id, corpus_id)""",
    "evidence": """
      SELECT query_id, string_agg('- ' || d.text, chr(10) ORDER BY rk) AS block
      FROM lexical JOIN documents d ON d.doc_id = corpus_id WHERE rk <= 3 GROUP BY query_id""",
    "scored_evidence": """
      SELECT query_id, string_agg('- [Score: ' || printf('%.2f', score) || '] ' || d.text, chr(10) ORDER BY rk) AS block
      FROM lexical JOIN documents d ON d.doc_id = corpus_id WHERE rk <= 3 GROUP BY query_id""",
    "reply_links": r"""
      SELECT tweet_id, pos, url, regexp_extract(url, '^(https?)://([^/?#]*)', 2) AS host,
        regexp_extract(url, '^(https?)://', 1) AS scheme,
        rtrim(regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), ';[^/]*$', ''), '/') AS path
      FROM (SELECT tweet_id, unnest(range(len(u))) AS pos, unnest(u) AS url
        FROM (SELECT tweet_id, regexp_extract_all(reply, 'https?://[^\s<>"'']+') AS u FROM replies))""",
    "whitelist": r"""
      SELECT DISTINCT CASE WHEN path = '' THEN 'host' ELSE 'path' END AS kind,
        CASE WHEN path = '' THEN host ELSE scheme || '://' || host || path END AS key
      FROM (SELECT regexp_extract(url, '^(https?)://([^/?#]*)', 2) AS host,
          regexp_extract(url, '^(https?)://', 1) AS scheme,
          rtrim(regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), ';[^/]*$', ''), '/') AS path
        FROM (SELECT unnest(regexp_extract_all(text, 'https?://[^\s<>"'']+')) AS url FROM corpus))""",
    "violations": """
      SELECT tweet_id, list(url ORDER BY pos) AS urls, string_agg(url, '; ' ORDER BY pos) AS joined, count(*) AS n
      FROM reply_links WHERE host NOT IN ('t.co', 'twitter.com', 'x.com')
        AND CASE WHEN path = '' THEN host NOT IN (SELECT key FROM whitelist WHERE kind = 'host')
          ELSE scheme || '://' || host || path NOT IN (SELECT key FROM whitelist WHERE kind = 'path') END
      GROUP BY tweet_id""",
    "clean": """
      SELECT r.tweet_id, coalesce(n, 0)::INT AS n, coalesce(joined, '') AS joined, CASE WHEN n IS NULL THEN reply ELSE
        list_reduce(list_transform(list_sort(list_transform(urls, lambda u: {'l': -length(u), 'u': u})), lambda s: s.u),
          lambda acc, u: replace(acc, u, '[URL removed: not in historical whitelist]'), reply) END AS cleaned
      FROM replies r LEFT JOIN violations v ON r.tweet_id = v.tweet_id""",
    "judge_answers": """
      SELECT tweet_id, judge_groundedness::DOUBLE AS groundedness, judge_safety::DOUBLE AS safety,
        CASE WHEN tweet_id % 4 <> 0 THEN judge_helpfulness::DOUBLE END AS helpfulness,
        'see ' || tweet_id::VARCHAR AS critique FROM tickets""",
    "requests": f"""
      SELECT tweet_id, trim(text, {_BLANKS}) AS text FROM tickets""",
    "checked": """
      SELECT *, CASE WHEN text = '' OR length(text)
        + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) > 500
        THEN 'provide a tweet of 1-500 chars' END AS error FROM requests""",
    "triaged": f"""
      SELECT *, list_filter([CASE WHEN {_risk_hit('safe_text')} THEN 'high-risk keyword (deterministic backstop)' END,
          CASE WHEN {_request_stuck('safe_text')} THEN 'cancellation dead-end' END,
          CASE WHEN risk THEN 'LLM risk classifier flag' END,
          CASE WHEN confidence < 0.7e0 THEN 'low intent confidence (< 0.7)' END], lambda r: r IS NOT NULL) AS reasons
      FROM (SELECT c.tweet_id, c.error, {_redact('c.text', 'url')} AS safe_text,
          coalesce(a.reply, '[draft unavailable - model budget exhausted]') AS reply,
          CASE a.intent_payload WHEN '{{"intent":"app_bug","confidence":0.9}}' THEN 'app_bug' ELSE 'other' END AS intent,
          CASE a.intent_payload WHEN '{{"intent":"app_bug","confidence":0.9}}' THEN 0.9e0
            WHEN '{{"intent":"other","confidence":"0.8"}}' THEN 0.8e0 WHEN '{{"confidence":null}}' THEN 0e0
            ELSE 0.5e0 END AS confidence,
          coalesce(a.risk_payload, '') = '{{"risk":true}}' AS risk
        FROM checked c LEFT JOIN answers a ON a.tweet_id = c.tweet_id)""",
    "asked_words": f"""
      SELECT tweet_id AS query_id, list_distinct({_tokens('safe_text')}) AS words FROM triaged WHERE error IS NULL""",
    "post_words": f"SELECT tweet_id AS corpus_id, text, {_tokens('text')} AS words FROM reply_posts",
    "hits": """
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id) AS rk FROM (
        SELECT query_id, corpus_id, count(*)::DOUBLE / sqrt((any_value(ql) * any_value(cl))::DOUBLE) AS score
        FROM (SELECT query_id, len(words) AS ql, unnest(words) AS w FROM asked_words)
        JOIN (SELECT corpus_id, len(words) AS cl, unnest(words) AS w FROM post_words) USING (w)
        GROUP BY query_id, corpus_id)""",
    "found": """
      SELECT query_id, string_agg(p.text, chr(10) ORDER BY rk) AS block, sum(round(score, 3)) AS total
      FROM hits h JOIN post_words p ON p.corpus_id = h.corpus_id WHERE rk <= 3 GROUP BY query_id""",
}


_ROUTER_PAYLOADS = """
  '{"intent":"app_bug","confidence":0.9}', '{"intent":"","confidence":""}', '{"intent":"other","confidence":"0.25"}',
  '{"confidence":null,"risk":null}', '{"risk":"false"}', '{"risk":""}', '{"risk":0}', '{"risk":2.5}', '{"risk":[]}',
  '{"risk":{}}', '{"risk":[0]}', '{"risk":false,"intent":"billing_payment","confidence":true}',
  '{"intent":"app_bug","confidence":"high","risk":true}', '[1, 2]', 'not json', '', NULL"""
CTES["router_calls"] = f"""
  SELECT event_id AS call_id, [200, 204, 299, 400, 401, 403, 404, 418, 429, 500, 503, NULL][event_id % 12 + 1] AS status,
    ['limit on Tokens Per Day', 'requests per day used up', 'try again in 2m3.5s', 'Try again in 7s', 'try again in 12m0s.',
      'slow down', NULL][event_id % 7 + 1] AS message,
    [{_ROUTER_PAYLOADS}][event_id % 17 + 1] AS payload FROM events"""
CTES["router_waits"] = CTES["waits"].replace("FROM model_calls", "FROM router_calls")
CTES["router_outcomes"] = CTES["outcomes"].replace("FROM waits", "FROM router_waits")


def with_tables(body: str) -> str:
    """Put the CTEs a query needs, and what those need, in front of it."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", sql):
                needed.add(name)
                visit(CTES[name])

    visit(body)
    ctes = ", ".join(f"{name} AS ({CTES[name].strip()})" for name in CTES if name in needed)
    return f"WITH {ctes} {body}" if ctes else body


def _curve(score: str, steps: str = "steps", always: str = "kw") -> str:
    return f"""
      SELECT round(t, 2) AS threshold, round(n_auto / n, 4) AS auto_handle_rate,
        round(CASE WHEN n_auto > 0 THEN misses / n_auto ELSE 0 END, 4) AS volume_false_auto,
        round(CASE WHEN risks > 0 THEN misses / risks ELSE 0 END, 4) AS risk_miss_rate
      FROM (SELECT t, count(*) AS n, count(*) FILTER (auto) AS n_auto,
          count(*) FILTER (auto AND true_escalate) AS misses, count(*) FILTER (true_escalate) AS risks
        FROM (SELECT t, true_escalate, NOT ({score} >= t OR {always}) AS auto FROM flagged, {steps}) GROUP BY t)"""


def _ops(digits: int) -> str:
    return f"""
      round(count(*) FILTER (NOT pred_escalate) / count(*), {digits}) AS auto_handle_rate,
      round(count(*) FILTER (NOT pred_escalate AND true_escalate) / nullif(count(*) FILTER (NOT pred_escalate), 0), {digits}) AS volume_false_auto,
      round(count(*) FILTER (NOT pred_escalate AND true_escalate) / nullif(count(*) FILTER (true_escalate), 0), {digits}) AS risk_miss_rate,
      round(count(*) FILTER (pred_escalate AND true_escalate) / nullif(count(*) FILTER (pred_escalate), 0), {digits}) AS precision,
      round(count(*) FILTER (pred_escalate AND true_escalate) / nullif(count(*) FILTER (true_escalate), 0), {digits}) AS recall"""


def _spearman(source: str, min_n: int) -> str:
    return f"""
      SELECT metric, count(*) AS n, CASE WHEN count(*) >= {min_n} THEN round(corr(rh, rj), 6) END AS spearman FROM (
        SELECT metric,
          rank() OVER (PARTITION BY metric ORDER BY human) + (count(*) OVER (PARTITION BY metric, human) - 1) / 2e0 AS rh,
          rank() OVER (PARTITION BY metric ORDER BY judge) + (count(*) OVER (PARTITION BY metric, judge) - 1) / 2e0 AS rj
        FROM {source}) GROUP BY metric"""


_TRIAGE = """
  SELECT tweet_id, error, CASE WHEN error IS NULL THEN safe_text END AS safe_text,
    CASE WHEN error IS NULL THEN intent END AS intent, CASE WHEN error IS NULL THEN confidence END AS confidence,
    CASE WHEN error IS NULL THEN len(reasons) > 0 END AS escalate, CASE WHEN error IS NULL THEN reply END AS reply,
    CASE WHEN error IS NULL THEN CASE WHEN len(reasons) > 0 THEN array_to_string(reasons, '; ')
      ELSE 'safe to auto-handle' END END AS reasons, block AS evidence, round(total, 3) AS evidence_score
  FROM triaged LEFT JOIN found ON query_id = tweet_id"""

# The prompts.
_INTENT_HEAD = (
    "You are an intent classifier for BrandCares support tweets.\n"
    "Classify into ONE: app_bug, account_login, billing_payment, feature_request, other.\n"
    'Return JSON only: {"intent": "...", "confidence": 0.0, "rationale": "..."}\n'
)
_SHORT_INTENT = (
    "Classify into ONE: app_bug, account_login, billing_payment, feature_request, other. "
    'Return ONLY JSON: {"intent": "...", "confidence": 0.0}'
)
_REQUEST_INTENT = (
    "Classify into ONE: app_bug, account_login, billing_payment, feature_request, other. "
    'Return ONLY JSON: {"intent": "...", "confidence": 0.0, "rationale": "..."}'
)
_RISK = (
    "You are a risk assessor for customer support. Flag risk=true ONLY if the message indicates: "
    "account compromise/hacking, fraud or unauthorized charges, legal threats, threats of violence or self-harm, "
    "or severe abusive hostility. Do NOT flag ordinary frustration, bugs, billing questions, or sarcasm. "
    'Return JSON only: {"risk": false, "risk_type": null} or {"risk": true, "risk_type": "..."}'
)
_REQUEST_RISK = (
    "Flag risk=true ONLY for: account compromise/hacking, fraud or unauthorized charges, legal threats, "
    "threats of violence or self-harm, severe abusive hostility. NOT ordinary frustration, bugs, billing questions, "
    'sarcasm. Return JSON only: {"risk": false} or {"risk": true}'
)
_REQUEST_HEAD = (
    "You are drafting a BrandCares support reply. Use only facts from the evidence. Do not invent URLs, refunds, "
    "timelines or policies. Ask for a DM if the issue requires sensitive account details. "
    "Avoid emojis unless the retrieved evidence uses them.\nEvidence:\n"
)
_DRAFT_HEAD = (
    "You are drafting a BrandCares support reply.\n"
    "Rules: Use only facts from evidence. Do not invent URLs. Ask for DM if sensitive. "
    "Avoid emojis unless the retrieved evidence uses them.\n"
)
_PARSED = """
  SELECT call_id, {intent} AS intent, {confidence} AS confidence, NOT coalesce(json_valid(payload), false) AS parse_error
  FROM (SELECT call_id, payload, CASE WHEN json_valid(payload) THEN payload END AS j FROM model_calls)"""

_RISK_TRUTH = """coalesce(CASE json_type(j, '$.risk') WHEN 'BOOLEAN' THEN json_extract_string(j, '$.risk') = 'true'
  WHEN 'VARCHAR' THEN json_extract_string(j, '$.risk') <> '' WHEN 'ARRAY' THEN json_array_length(j, '$.risk') > 0 OR {empty}
  WHEN 'OBJECT' THEN len(json_keys(j, '$.risk')) > 0 OR {empty} WHEN 'NULL' THEN false
  ELSE try_cast(json_extract_string(j, '$.risk') AS DOUBLE) <> 0 END, false)"""
_HEADLINE = f"""
  SELECT round(auto_handle_rate * 100, 2) AS auto_handle, round(volume_false_auto * 100, 2) AS volume_false_auto,
    round(risk_miss_rate * 100, 2) AS risk_miss, round((SELECT avg(f1) FROM class_f1), 2) AS macro_f1,
    round((SELECT avg((true_intent = pred_intent)::INT) FROM tickets) * 100, 2) AS accuracy, 0.5e0 AS prob_thresh
  FROM (SELECT {_ops(15)} FROM decided)"""

BODIES = {
    "router_outcomes": "SELECT call_id, status, message, outcome, cooldown_s FROM router_outcomes",
    "router_payloads": f"""
      SELECT call_id, coalesce(json_extract_string(j, '$.intent'), 'error') AS intent,
        coalesce(try_cast(json_extract_string(j, '$.confidence') AS DOUBLE), 0.5e0) AS confidence, j IS NULL AS parse_error,
        coalesce(nullif(json_extract_string(j, '$.intent'), ''), 'other') AS request_intent,
        CASE WHEN json_type(j, '$.confidence') = 'NULL' OR trim(json_extract_string(j, '$.confidence')) = '' THEN 0e0
          WHEN json_type(j, '$.confidence') = 'BOOLEAN' THEN (json_extract_string(j, '$.confidence') = 'true')::INT::DOUBLE
          ELSE coalesce(try_cast(json_extract_string(j, '$.confidence') AS DOUBLE), 0.5e0) END AS request_confidence,
        {_RISK_TRUTH.format(empty='false')} AS risk, {_RISK_TRUTH.format(empty='true')} AS request_risk
      FROM (SELECT call_id, CASE WHEN json_valid(payload) THEN CASE WHEN json_type(payload) = 'OBJECT' THEN payload END END AS j
        FROM router_calls)""",
    "bundle_document": f"""
      SELECT 'headline' AS part, unnest(['auto_handle', 'volume_false_auto', 'risk_miss', 'macro_f1', 'accuracy', 'prob_thresh']) AS name,
        NULL::DOUBLE AS threshold, unnest([auto_handle, volume_false_auto, risk_miss, macro_f1, accuracy, prob_thresh]) AS value
      FROM ({_HEADLINE})
      UNION ALL SELECT 'agreement', metric, NULL, spearman FROM ({_spearman("grades", 3).replace("corr(rh, rj), 6", "corr(rh, rj), 2")})
      UNION ALL SELECT 'curve', unnest(['auto_handle_rate', 'volume_false_auto', 'risk_miss_rate']), threshold,
        unnest([auto_handle_rate, volume_false_auto, risk_miss_rate]) FROM ({_curve("risk_score")})""",
    "thread_scan": "SELECT * FROM threads",
    "corpus_scan": "SELECT * FROM reply_posts",
    "gate_config": "SELECT tweet_id, round(risk_score, 6) AS risk_score, reason_code FROM decided",
    "first_tickets": "SELECT tweet_id, text FROM tickets ORDER BY tweet_id LIMIT 25",
    "brand_subset": "SELECT * FROM subset",
    "reply_corpus": "SELECT * FROM reply_posts",
    "subset_counts": "SELECT inbound, count(*) AS n FROM subset GROUP BY inbound",
    "evidence_sample": """
      SELECT * FROM reply_posts WHERE length(text) > 40 ORDER BY md5('42:' || tweet_id::VARCHAR), tweet_id LIMIT 1500""",
    "sample_n": "SELECT tweet_id, text FROM customers ORDER BY k, tweet_id LIMIT 100",
    "golden_set": """
      SELECT tweet_id, text, stratum, '' AS true_intent, '' AS should_escalate, '' AS notes FROM golden""",
    "leakage_audit": """
      SELECT count(*) FILTER (response_tweet_id IS NOT NULL) AS with_response,
        count(*) FILTER (EXISTS (SELECT 1 FROM reply_posts c
          WHERE list_contains(string_split(t.response_tweet_id, ','), c.tweet_id::VARCHAR))) AS leaked
      FROM threads t WHERE tweet_id IN (SELECT tweet_id FROM golden)""",
    "label_parse": f"""
      SELECT tweet_id, coalesce(trim(lower(should_escalate), {_BLANKS}) = 'true', false) AS should_escalate FROM tickets""",
    "ticket_validation": "SELECT tweet_id, error, length(text)::INT AS n_chars FROM checked",
    "redact_pii": "SELECT tweet_id, safe_text FROM redacted",
    "redact_pii_url_first": f"SELECT tweet_id, {_redact('text', 'url')} AS safe_text FROM tickets",
    "keyword_flag": "SELECT tweet_id, kw AS flag FROM flagged",
    "simple_intent": f"SELECT tweet_id, {_intent('text')} AS intent FROM tickets",
    "text_sql_functions": f"""
      SELECT tweet_id, safe_text, {_keyword('text')} AS flag, {_intent('text')} AS intent FROM redacted""",
    "tokens": f"""
      SELECT tweet_id, len(w)::INT AS n_tokens, array_to_string(w, ' ') AS tokens,
        len(list_distinct(w))::INT AS n_distinct FROM (SELECT tweet_id, {_tokens('text')} AS w FROM tickets)""",
    "cooldown_parse": "SELECT call_id, wait AS cooldown_s FROM waits",
    "call_outcomes": "SELECT call_id, outcome, cooldown_s FROM outcomes",
    "attempt_outcomes": """
      SELECT model, outcome, count(*) AS calls, coalesce(sum(cooldown_s), 0e0) AS cooldown_s FROM outcomes
      GROUP BY model, outcome""",
    "model_usage": "SELECT model, count(*) AS calls FROM outcomes WHERE outcome = 'served' GROUP BY model",
    "served_by": """
      SELECT tweet_id, arg_min(model, priority) AS model, min(priority) AS priority FROM outcomes
      WHERE outcome = 'served' GROUP BY tweet_id""",
    "parse_intent": _PARSED.format(
        intent="coalesce(json_extract_string(j, '$.intent'), 'error')",
        confidence="coalesce(try_cast(json_extract_string(j, '$.confidence') AS DOUBLE), 0.5e0)",
    ),
    "parse_request_intent": _PARSED.format(
        intent="coalesce(nullif(json_extract_string(j, '$.intent'), ''), 'other')",
        confidence="""CASE WHEN json_type(j, '$.confidence') = 'NULL' THEN 0e0
          ELSE coalesce(try_cast(json_extract_string(j, '$.confidence') AS DOUBLE), 0.5e0) END""",
    ),
    "parse_risk": """
      SELECT call_id, coalesce(json_extract_string(j, '$.risk') = 'true', false) AS risk,
        NOT coalesce(json_valid(payload), false) AS parse_error
      FROM (SELECT call_id, payload, CASE WHEN json_valid(payload) THEN payload END AS j FROM model_calls)""",
    "parse_judge": "SELECT *, false AS parse_error FROM judge_answers",
    "fill_missing_outputs": """
      SELECT t.tweet_id, coalesce(intent_payload, '{"intent":"other","confidence":0.5}') AS intent_payload,
        coalesce(intent_model, 'fallback') AS intent_model, coalesce(risk_payload, '{"risk": false}') AS risk_payload,
        coalesce(risk_model, 'fallback') AS risk_model,
        coalesce(reply, '[draft unavailable - model budget exhausted]') AS reply,
        coalesce(draft_model, 'none') AS draft_model
      FROM tickets t LEFT JOIN answers a ON t.tweet_id = a.tweet_id""",
    "score_tickets": f"SELECT tweet_id, {_intent('text')} AS intent, 0.5e0 AS confidence FROM tickets",
    "risk_score": "SELECT tweet_id, round(risk_score, 6) AS risk_score FROM flagged",
    "risk_policy": """
      SELECT tweet_id, safe_text, round(risk_score, 6) AS risk_score, reason_code, pred_escalate FROM decided""",
    "risk_policy_uncalibrated": f"""
      SELECT tweet_id, reason_code, CASE reason_code WHEN 'keyword' THEN 'High-risk keyword or dead-end (deterministic backstop)'
          WHEN 'model_risk' THEN 'LLM risk classifier flag' WHEN 'low_confidence' THEN 'Low LLM confidence'
          WHEN 'weak_evidence' THEN 'Weak historical evidence' ELSE 'Safe to auto-handle' END AS reason,
        reason_code <> 'safe' AS pred_escalate
      FROM (SELECT tweet_id, CASE WHEN {_keyword('safe_text')} THEN 'keyword' WHEN llm_risk THEN 'model_risk'
        WHEN confidence < 0.7e0 THEN 'low_confidence' WHEN retrieval_score < 0.4e0 THEN 'weak_evidence'
        ELSE 'safe' END AS reason_code FROM redacted)""",
    "demo_policy": f"""
      SELECT tweet_id, reasons <> '' AS escalate, CASE WHEN reasons = '' THEN 'safe to auto-handle' ELSE reasons END AS reasons
      FROM (SELECT tweet_id, concat_ws('; ',
          CASE WHEN {_risk_hit('s')} THEN 'high-risk keyword (deterministic backstop)' END,
          CASE WHEN {_request_stuck('s')} THEN 'cancellation dead-end' END,
          CASE WHEN llm_risk THEN 'LLM risk classifier flag' END,
          CASE WHEN confidence < 0.7e0 THEN 'low intent confidence (< 0.7)' END) AS reasons
        FROM (SELECT *, {_redact('text', 'url')} AS s FROM tickets))""",
    "l2_normalize": """
      SELECT vec_id, (unnest(range(len(v))))::INT AS pos,
        round(unnest(v) / sqrt(list_inner_product(v, v)), 6) AS x
      FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)""",
    "dense_topk": """
      SELECT query_id, rk::INT AS rk, corpus_id, round(score, 6) AS score FROM dense WHERE rk <= 3""",
    "dense_top1": "SELECT query_id, round(score, 6) AS top_score FROM dense WHERE rk = 1",
    "lexical_topk": """
      SELECT query_id, rk::INT AS rk, corpus_id, round(score, 6) AS score FROM lexical WHERE rk <= 3""",
    "build_prompts": f"""
      SELECT item_id AS tweet_id, 'Tweet: ' || {_redact('text')} || chr(10) || 'Reply: draft ' || item_id::VARCHAR || chr(10)
        || 'Evidence the reply was allowed to use:' || chr(10) || coalesce(block, '') AS user
      FROM benchmark LEFT JOIN evidence ON query_id = item_id""",
    "draft_prompts": f"""
      SELECT item_id AS tweet_id, {_quote(_DRAFT_HEAD)} || chr(10) || 'Intent: ' || {_intent('text')} || '.' || chr(10)
        || 'Retrieved Historical Evidence:' || chr(10) || coalesce(block, '') AS system,
        'Tweet: ' || {_redact('text')} || chr(10) || 'Draft:' AS user
      FROM benchmark LEFT JOIN scored_evidence ON query_id = item_id""",
    "intent_prompts": f"SELECT tweet_id, {_quote(_INTENT_HEAD)} AS system, safe_text AS user FROM redacted",
    "short_intent_prompts": f"""
      SELECT tweet_id, {_quote(_SHORT_INTENT)} AS system, safe_text AS user, false AS per_request FROM redacted UNION ALL
      SELECT tweet_id, {_quote(_REQUEST_INTENT)}, safe_text, true FROM redacted""",
    "risk_prompts": f"""
      SELECT tweet_id, {_quote(_RISK)} AS system, safe_text AS user, false AS per_request FROM redacted UNION ALL
      SELECT tweet_id, {_quote(_REQUEST_RISK)}, safe_text, true FROM redacted""",
    "request_prompts": f"""
      SELECT item_id AS tweet_id, {_quote(_REQUEST_HEAD)} || coalesce(block, '') AS system,
        'Intent: ' || {_intent('text')} || '.' || chr(10) || 'Tweet: ' || {_redact('text')} || chr(10) || 'Draft:' AS user
      FROM benchmark LEFT JOIN evidence ON query_id = item_id""",
    "extract_urls": "SELECT tweet_id, pos::INT AS pos, url FROM reply_links",
    "url_parts": r"""
      SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme,
        regexp_extract(url, '^https?://([^/?#]*)', 1) AS host,
        rtrim(regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), ';[^/]*$', ''), '/') AS path
      FROM pages""",
    "url_whitelist": "SELECT * FROM whitelist",
    "verify_replies": """
      SELECT tweet_id, n = 0 AS passed, n AS n_violations, joined AS violation_urls FROM clean""",
    "sanitize_replies": "SELECT tweet_id, cleaned AS clean_reply FROM clean",
    "grounding_summary": """
      SELECT count(*) AS replies, sum(n)::BIGINT AS violations, count(*) FILTER (n = 0) AS passed,
        (SELECT count(*) FROM whitelist) AS whitelist_entries FROM clean""",
    "intent_metrics": """
      SELECT (SELECT round(avg((true_intent = pred_intent)::INT), 6) FROM tickets) AS accuracy,
        round(avg(f1), 6) AS macro_f1 FROM class_f1""",
    "per_class_f1": "SELECT label, tp, fp, fn, round(f1, 6) AS f1 FROM class_f1",
    "escalation_metrics": """
      SELECT round(count(*) FILTER (true_escalate AND pred_escalate) / count(*) FILTER (pred_escalate), 6) AS precision,
        round(count(*) FILTER (true_escalate AND pred_escalate) / count(*) FILTER (true_escalate), 6) AS recall
      FROM rule_layer""",
    "baseline_compare": """
      SELECT s.system, round(avg((true_intent = intent)::INT), 6) AS accuracy, round(any_value(macro_f1), 6) AS macro_f1,
        round(count(*) FILTER (true_escalate AND escalate) / count(*) FILTER (escalate), 6) AS precision,
        round(count(*) FILTER (true_escalate AND escalate) / count(*) FILTER (true_escalate), 6) AS recall
      FROM systems s JOIN system_f1 f ON s.system = f.system GROUP BY s.system""",
    "operational_metrics": f"SELECT count(*) AS tickets, {_ops(6)} FROM decided",
    "reason_counts": "SELECT reason_code, count(*) AS n FROM decided GROUP BY reason_code",
    "calibration_bins": """
      SELECT bin, count(*) AS n, round(avg(confidence), 6) AS mean_conf, round(avg(hit), 6) AS mean_acc
      FROM bins GROUP BY i, bin""",
    "calibration_document": """
      SELECT bin, count(*) AS n, round(sum(confidence::DECIMAL(28, 18))::DOUBLE / count(*), 4) AS mean_conf, round(avg(hit), 4) AS mean_acc,
        (SELECT round(sum(gap)::DOUBLE / any_value(total), 4) FROM (
          SELECT abs(sum(confidence::DECIMAL(28, 18)) - sum(hit)) AS gap,
            (SELECT count(*) FROM tickets WHERE confidence IS NOT NULL) AS total FROM bins GROUP BY i)) AS ece
      FROM bins GROUP BY i, bin""",
    "ece": """
      SELECT round(sum(n / total * abs(mean_conf - mean_acc)), 6) AS ece FROM (
        SELECT count(*) AS n, avg(confidence) AS mean_conf, avg(hit) AS mean_acc,
          (SELECT count(*) FROM tickets WHERE confidence IS NOT NULL) AS total FROM bins GROUP BY i)""",
    "spearman": _spearman("complete_grades", 2),
    "spearman_per_metric": _spearman("grades", 3),
    "judge_means": """
      SELECT round(avg(judge_groundedness), 6) AS groundedness, round(avg(judge_safety), 6) AS safety,
        round(avg(judge_helpfulness), 6) AS helpfulness FROM tickets""",
    "attach_grades": """
      SELECT t.tweet_id, t.judge_safety, g.human_safety, g.human_helpfulness FROM tickets t
      LEFT JOIN (SELECT * FROM tickets WHERE human_safety IS NOT NULL) g ON t.tweet_id = g.tweet_id""",
    "operating_curve": _curve("risk_score"),
    "operating_curve_fine": _curve("round(risk_score, 4)", "(SELECT i / 100 AS t FROM range(5, 96) r(i))"),
    "fit_gate": """
      SELECT round(w0, 6) AS w_confidence, round(w1, 6) AS w_retrieval, round(w2, 6) AS intercept FROM fit_12""",
    "recalibrated_policy": f"""
      SELECT reason_code, count(*) AS n FROM (
        SELECT CASE WHEN {_keyword('safe_text')} THEN 'keyword' WHEN llm_risk THEN 'model_risk'
          WHEN refit_score >= cut THEN 'risk_score' ELSE 'safe' END AS reason_code FROM refit, refit_cut)
      GROUP BY reason_code""",
    "gate_grid": "SELECT * FROM grid_rates",
    "best_gates": """
      SELECT * FROM grid_rates WHERE risk_miss_rate <= 0.25e0
      ORDER BY auto_handle_rate DESC, conf_thresh, ret_thresh LIMIT 8""",
    "choose_threshold": """
      SELECT coalesce(max(prob_thresh), 0.5e0) AS prob_thresh, coalesce(max(a), 0e0) AS auto_handle_rate,
        coalesce(max(m), 1e0) AS risk_miss_rate
      FROM (SELECT round(t, 2) AS prob_thresh, round(n_auto / n, 4) AS a, round(misses / risks, 4) AS m
        FROM (SELECT t, count(*) AS n, count(*) FILTER (auto) AS n_auto,
            count(*) FILTER (auto AND true_escalate) AS misses, count(*) FILTER (true_escalate) AS risks
          FROM (SELECT t, true_escalate, NOT (risk_score >= t OR kw OR llm_risk) AS auto FROM flagged, steps) GROUP BY t)
        WHERE misses / risks <= 0.25e0 ORDER BY n_auto DESC, t LIMIT 1)""",
    "intent_evaluation": f"""
      SELECT t.tweet_id, trim(lower(should_escalate), {_BLANKS}) = 'true' AS should_escalate,
        {_keyword('safe_text')} AS pred_escalate, coalesce(p.intent, 'error') AS pred_intent,
        coalesce(p.confidence, 0.5e0) AS confidence, coalesce(p.parse_error, true) AS parse_error, coalesce(p.answered, false) AS answered
      FROM redacted t LEFT JOIN (SELECT tweet_id, coalesce(json_extract_string(j, '$.intent'), 'error') AS intent,
          coalesce(try_cast(json_extract_string(j, '$.confidence') AS DOUBLE), 0.5e0) AS confidence, j IS NULL AS parse_error, answered
        FROM (SELECT tweet_id, CASE WHEN json_valid(intent_payload) THEN intent_payload END AS j,
          intent_payload IS NOT NULL AS answered FROM answers)) p
        ON p.tweet_id = t.tweet_id WHERE should_escalate IS NOT NULL""",
    "unanswered_tickets": """
      SELECT coalesce(a.intent_payload IS NOT NULL, false) AS answered, count(*) AS n
      FROM tickets t LEFT JOIN answers a ON a.tweet_id = t.tweet_id WHERE should_escalate IS NOT NULL AND true_intent IS NOT NULL GROUP BY 1""",
    "risk_evaluation": f"""
      SELECT tweet_id, true_escalate, intent, confidence, llm_risk, round(risk_score, 6) AS risk_score, reason_code,
        reason_code <> 'safe' AS pred_escalate, intent_parse_error, risk_parse_error, answered
      FROM (SELECT *, CASE WHEN {_keyword('safe_text')} THEN 'keyword' WHEN llm_risk THEN 'model_risk'
          WHEN risk_score >= 0.5e0 THEN 'risk_score' ELSE 'safe' END AS reason_code
        FROM (SELECT *, {_SCORE} AS risk_score FROM (
          SELECT t.tweet_id, safe_text, retrieval_score, trim(lower(should_escalate), {_BLANKS}) = 'true' AS true_escalate,
            coalesce(json_extract_string(i, '$.intent'), 'other') AS intent,
            coalesce(try_cast(json_extract_string(i, '$.confidence') AS DOUBLE), 0.5e0) AS confidence,
            coalesce(json_extract_string(k, '$.risk') = 'true', false) AS llm_risk,
            i IS NULL AS intent_parse_error, k IS NULL AS risk_parse_error, coalesce(answered, false) AS answered
          FROM redacted t LEFT JOIN (SELECT tweet_id, CASE WHEN json_valid(intent_payload) THEN intent_payload END AS i,
              CASE WHEN json_valid(risk_payload) THEN risk_payload END AS k,
              intent_payload IS NOT NULL AND risk_payload IS NOT NULL AS answered FROM answers) a ON a.tweet_id = t.tweet_id
          WHERE should_escalate IS NOT NULL)))""",
    "reply_evaluation": f"""
      SELECT b.item_id AS tweet_id, {_redact('b.text')} AS tweet, {_redact(_redact('b.text'))} AS safe_tweet,
        {_intent('b.text')} AS intent, round(l.score, 6) AS top_retrieval_score, c.cleaned AS generated_reply,
        c.n AS verifier_violations, c.joined AS verifier_urls, j.groundedness AS judge_groundedness,
        j.safety AS judge_safety, j.helpfulness AS judge_helpfulness, j.critique AS judge_critique,
        t.human_groundedness, t.human_safety, t.human_helpfulness, c.tweet_id IS NOT NULL AS drafted
      FROM benchmark b LEFT JOIN (SELECT * FROM lexical WHERE rk = 1) l ON l.query_id = b.item_id
      LEFT JOIN clean c ON c.tweet_id = b.item_id LEFT JOIN judge_answers j ON j.tweet_id = b.item_id
      LEFT JOIN tickets t ON t.tweet_id = b.item_id""",
    "bundle_headline": _HEADLINE,
    "bundle_tickets": "SELECT round(risk_score, 4) AS risk_score, kw, true_escalate FROM flagged",
    "triage_requests": _TRIAGE,
    "triage_stream": _TRIAGE,
}

ORACLES = {name: with_tables(body) for name, body in BODIES.items()}
