"""DuckDB SQL for the queries that SQL can express."""

ORACLES: dict[str, str] = {}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op8_exact_dedup"] = f"""
WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
 doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""

ORACLES["op9_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(w[i:i + 34], ' ')) AS c FROM s),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 35)))) AS g FROM h WHERE c > 1 GROUP BY doc_id),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
q AS (SELECT p.doc_id, p.i, p.word FROM p LEFT JOIN (SELECT doc_id, unnest(g) AS i FROM gone) x ON p.doc_id = x.doc_id AND p.i = x.i WHERE x.i IS NULL),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM q GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, CAST(coalesce(len(gone.g), 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""

ORACLES["op6_chat_format"] = r"""
WITH c AS (
 SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#') AS esc,
 CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
  ELSE '=' || replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#'), ':', '\:') END AS title FROM c),
g AS (SELECT conv_id, count(*) AS n_turns,
 string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS spoken,
 coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '') AS loss,
 string_agg(role, ',' ORDER BY turn NULLS LAST, role, text) AS roles,
 CAST(sum(length('### ' || title || ': ' || esc || '</turn>') + 1) AS BIGINT) AS formatted_chars
 FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(spoken) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
 regexp_full_match(roles, '(system,)?user,assistant(,user,assistant)*') AS valid
FROM g
"""

ORACLES["op2_near_dedup"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(g, ' ') AS g FROM (
 SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w] ELSE list_transform(range(1, len(w)), lambda i: w[i:i + 1]) END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS met FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.met),
m AS (SELECT doc_id, min(met) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, m.doc_id = m.component_id AS kept FROM m LEFT JOIN n ON n.doc_id = m.doc_id
"""
