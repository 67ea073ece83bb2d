"""DuckDB SQL for the queries that SQL can express, on the same tables."""

from __future__ import annotations

from isohyet.llm import chat, decontaminate, near_dedup, passages, quality, secrets

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE_WORD = r"[^\x20\x09-\x0D]+"

NEAR = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{SPACE_WORD}') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {near_dedup.SHINGLE} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {near_dedup.SHINGLE - 2}), lambda i: array_to_string(ws[i:i + {near_dedup.SHINGLE - 1}], ' ')) END) AS sh FROM w
), size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * common.n >= {near_dedup.LINK_PERCENT} * (x.n + y.n - common.n)
), sides AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, sides.b FROM reach JOIN sides ON sides.a = reach.b),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN size USING (doc_id) JOIN comp USING (doc_id)
"""

_user, _assistant, _system = (chat.MARKS[r] for r in ("user", "assistant", "system"))


def _written(begin: str, end: str) -> str:
    plain = f"strpos(text || '{end}', '{end}') > length(text) AND NOT regexp_matches(text || '{end}', '\\\\[\\\\<\\[]')"
    return f"{len(begin) + len(end)} + length(CASE WHEN {plain} THEN text ELSE regexp_replace(text, '([\\\\<\\[])', '\\\\\\1', 'g') END)"


CHAT = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, ['user', 'assistant'][i + 1], '</s>[INST] ok [/INST]' FROM range(2) r(i)
), sized AS (
  SELECT *, CASE role WHEN 'user' THEN {_written(*_user)} WHEN 'assistant' THEN {_written(*_assistant)} WHEN 'system' THEN {_written(*_system)}
    ELSE {len(chat.OTHER[0] + chat.OTHER[1])} + length(regexp_replace(role, '([\\\\<\\[])', '\\\\\\1', 'g')) + {_written('', chat.OTHER[2])} END AS written
  FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(written) + {len(chat.BEGIN)} AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

LEAKS = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(ws), {decontaminate.WINDOW}) AS n,
    unnest(list_transform(range(1, len(ws) - least(len(ws), {decontaminate.WINDOW}) + 2), lambda k: array_to_string(ws[k:k + least(len(ws), {decontaminate.WINDOW}) - 1], ' '))) AS win
  FROM i WHERE len(ws) > 0
), dw AS (
  SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS k, unnest(list_transform(range(1, len(ws) - n + 2), lambda k: array_to_string(ws[k:k + n - 1], ' '))) AS win
  FROM d CROSS JOIN (SELECT DISTINCT n FROM iw)
), hit AS (SELECT doc_id, k, dw.n, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)
"""

QUALITY = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{SPACE_WORD}') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{SPACE_WORD}')) AS lines FROM documents
), win AS (
  SELECT doc_id, unnest(range(1, len(ws) - 1)) AS k, unnest(list_transform(range(1, len(ws) - 1), lambda k: ws[k:k + 2])) AS w3 FROM d
), rep AS (SELECT doc_id, k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w3) AS c FROM win) WHERE c > 1),
repw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS p FROM rep) GROUP BY doc_id),
line AS (
  SELECT doc_id, host, regexp_replace(lower(array_to_string(regexp_extract_all(x, '{SPACE_WORD}'), ' ')), '[0-9]', '0', 'g') AS line, len(regexp_extract_all(x, '{SPACE_WORD}')) AS n
  FROM (SELECT doc_id, host, unnest(lines) AS x FROM d)
), hosts AS (SELECT host, count(*) AS hd FROM d GROUP BY host),
often AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT doc_id) AS c FROM line GROUP BY ALL) JOIN hosts USING (host)
  WHERE c > {quality.MIN_LINE_DOCUMENTS} AND c > hd * CAST({quality.MAX_LINE_SHARE} AS DOUBLE)
), removed AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS common_words FROM line JOIN often USING (host, line) GROUP BY doc_id),
base AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(repw.n, 0) AS n_repeat_words, coalesce(common_words, 0) AS common_words
  FROM d LEFT JOIN repw USING (doc_id) LEFT JOIN removed USING (doc_id)
)
SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words)
    AND NOT 100 * (n_words - common_words) < {quality.MIN_KEPT_PERCENT} * n_words AS kept
FROM base
"""


def _found(kind: str) -> str:
    p = secrets.PATTERNS[kind].replace("'", "''")
    group = 2 if kind == "assign" else 0
    mixed = "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')" if kind == "bare" else "true"
    least = f"length(v) >= {secrets.LEAST_ASSIGNED}" if kind == "assign" else f"length(m) >= {secrets.LEAST[kind]}"
    return f"""
  SELECT doc_id, '{kind}' AS kind, {secrets.KINDS.index(kind) + 1} AS rank, e - length(m) AS b, e FROM (
    SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY nth) AS e FROM (
      SELECT doc_id, unnest(range(1, len(ms) + 1)) AS nth, unnest(ms) AS m, unnest(vs) AS v, unnest(gaps[1:len(ms)]) AS gap FROM (
        SELECT doc_id, regexp_extract_all(text, '{p}') AS ms, regexp_extract_all(text, '{p}', {group}) AS vs, string_split_regex(text, '{p}') AS gaps
        FROM documents WHERE regexp_matches(text, '{p}'))))
  WHERE {least} AND {mixed}"""


SECRETS = f"""
WITH part AS ({" UNION ALL ".join(map(_found, secrets.KINDS))}),
base AS (SELECT * FROM part WHERE rank <= 3),
weak AS (
  SELECT * FROM part w WHERE rank > 3 AND EXISTS (
    SELECT 1 FROM part s WHERE s.doc_id = w.doc_id AND s.b - w.e <= {secrets.SCOPE} AND w.b - s.e <= {secrets.SCOPE}
      AND (w.kind = 'bare' AND s.kind IN ('access', 'endpoint') OR w.kind = 'endpoint' AND s.kind IN ('access', 'assign', 'bare')))
    AND NOT EXISTS (SELECT 1 FROM base s WHERE s.doc_id = w.doc_id AND w.b < s.e AND s.b < w.e)
), named AS (SELECT doc_id, rank, kind, b, concat(kind, ':', CAST(b AS BIGINT), ':', CAST(e AS BIGINT)) AS s FROM (FROM base UNION ALL FROM weak))
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(s, ',' ORDER BY b, rank) FILTER (rank <= 3), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY b, rank), '') AS spans
FROM documents d LEFT JOIN named n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

PASSAGES = f"""
WITH piece AS (
  SELECT doc_id, unnest(p) AS x, unnest(range(1, len(p) + 1)) AS k FROM (
    SELECT doc_id, regexp_extract_all(text, '[^\\n.!?]+[.!?]*|[.!?]+|\\n') AS p FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
), placed AS (SELECT *, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM piece),
unit AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS unit, CAST(e - length(x) AS BIGINT) AS b, CAST(e AS BIGINT) AS e, ws, len(ws) AS words
  FROM (SELECT *, regexp_extract_all({LOWER.format("x")}, '{SPACE_WORD}') AS ws FROM placed) WHERE len(ws) > 0
), ranked AS (
  SELECT *, first_value(doc_id) OVER w AS first_doc_id, row_number() OVER w AS nth FROM unit WINDOW w AS (PARTITION BY ws ORDER BY doc_id, unit)
), again AS (SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS run FROM ranked WHERE nth > 1)
SELECT doc_id, min(b) AS "begin", max(e) AS "end", count(*) AS n_units, CAST(sum(words) AS BIGINT) AS n_words,
  (max(struct_pack(words := words, first_doc_id := first_doc_id))).first_doc_id AS first_doc_id
FROM again GROUP BY doc_id, run HAVING sum(words) >= {passages.MIN_WORDS}
"""

COPIES = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

# an automaton over the states of the grammar (0 nothing yet, 1 after s, 2 after u, 3 after a), one row of the conversation at a time
REPAIR = """
WITH RECURSIVE entry AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
), named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS id
  FROM conversations
), kinds AS (
  SELECT n.*, xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(id, ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS kind
  FROM named n, entry
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS i,
    regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS last
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM damaged)
), rows AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    role[1] AS initial, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
), ins(p, m, cost, edits, said) AS (
  VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']),
    (2, 3, 2, 'I', ['assistant:']), (3, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])
), op(m, q, cost, edit, initial, role) AS (
  VALUES (0, 0, 3, 'D', '', ''), (1, 1, 3, 'D', '', ''), (2, 2, 3, 'D', '', ''), (3, 3, 3, 'D', '', ''),
    (0, 1, 0, 'K', 's', ''), (0, 2, 0, 'K', 'u', ''), (1, 2, 0, 'K', 'u', ''), (3, 2, 0, 'K', 'u', ''), (2, 3, 0, 'K', 'a', ''),
    (0, 2, 2, 'R', '', 'user'), (1, 2, 2, 'R', '', 'user'), (3, 2, 2, 'R', '', 'user'), (2, 3, 2, 'R', '', 'assistant')
), step AS (
  SELECT p, q, ins.cost + op.cost AS cost, edits || edit AS edits, said, edit, initial, role FROM ins JOIN op USING (m)
), dp AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS st, {'cost': 0, 'audit': '', 'said': CAST([] AS VARCHAR[])} AS best FROM conversations
  UNION ALL
  SELECT dp.conv_id, r.i, step.q, min({
    'cost': best.cost + step.cost + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END, 'audit': best.audit || edits,
    'said': list_concat(best.said, CAST(step.said AS VARCHAR[]), CASE edit WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || text] ELSE [step.role || ':' || text] END)})
  FROM dp JOIN rows r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1
  JOIN step ON step.p = st AND (edit = 'D' OR fault NOT IN ('blank', 'duplicate')) AND (edit <> 'K' OR step.initial = r.initial)
  GROUP BY dp.conv_id, r.i, step.q
), done AS (
  SELECT conv_id, i, min({'cost': best.cost + ins.cost, 'audit': best.audit || ins.edits, 'said': list_concat(best.said, CAST(ins.said AS VARCHAR[]))}) AS best
  FROM dp JOIN ins ON ins.p = st AND ins.m IN (0, 3) GROUP BY conv_id, i
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id
)
SELECT done.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(best.cost AS BIGINT) AS cost, best.audit AS audit, sha256(array_to_string(best.said, chr(10))) AS repaired_sha256
FROM done LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM done.conv_id WHERE done.i = coalesce(n, 0)
"""

SQL = {
    "op1_minhash_near_dedup": NEAR,
    "op2_chat_formatting": CHAT,
    "op3_benchmark_decontamination": LEAKS,
    "op4_quality_rules": QUALITY,
    "op7_secret_scans": SECRETS,
    "op9_substring_dedup": PASSAGES,
    "op12_exact_dedup": COPIES,
    "op13_structure_repair": REPAIR,
}
