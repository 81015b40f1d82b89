"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .common import LOWER, UPPER
from .quality import BOILERPLATE, SYMBOLS
from .secret_scan import BASE_RULES, MORE_RULES

#: A word is a run of anything but these; the same class as in ``common.SPACES``.
SPACE = r"[\x20\x09-\x0D]"

_LINES = rf"list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{SPACE[1:]}'))"
_N = f"len(regexp_extract_all(x, '[^{SPACE[1:]}+'))"
_COUNT = "length(regexp_replace(x, '[^{0}]', '', 'g'))"
_END = "[.!?:;,…。！？\"''”’»)\\]]" + SPACE + "*$"  # SQL writes an apostrophe twice
_FAILS = (
    f"({_COUNT.format(SYMBOLS)} > 0.5 * {_N} OR NOT regexp_matches(x, '\\p{{L}}')"
    f" OR ({_N} <= 4 AND NOT regexp_matches(x, '{_END}'))"
    f" OR {_COUNT.format('|»›•')} * 3 > {_N}"
    f" OR ({_N} <= 30 AND regexp_matches(x, '(?i){'|'.join(BOILERPLATE)}')))"
)

#: The rows that quality rules keep or reject, with every figure; ``docs`` is the table to judge.
QUALITY_CTES = f"""
base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM docs
), split AS (
  SELECT *, list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda x: x <> '') AS words, {_LINES} AS lines FROM base
), good AS (
  SELECT *, list_filter(lines, lambda x: NOT {_FAILS}) AS good FROM split
), word AS (
  SELECT r, unnest(words) AS w, unnest(range(len(words))) AS p FROM good
), win AS (
  SELECT r, p, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM word WINDOW o AS (PARTITION BY r ORDER BY p)
), twice AS (
  SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, w, w2, w3) AS n FROM win WHERE w3 IS NOT NULL) WHERE n > 1
), again AS (
  SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY r
), figures AS (
  SELECT r, doc_id, text, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words,
         length(array_to_string(lines, '')) AS n_all, length(array_to_string(good, '')) AS n_good,
         len(list_filter(good, lambda x: true)) > 0 AS any_good
  FROM good LEFT JOIN again USING (r)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM figures
), quality AS (
  SELECT *, NOT base_failed AND n_all > 0 AND any_good AND 1 - n_good / n_all::DOUBLE <= 0.5 AS kept FROM judged
)"""

QUALITY_SQL = f"""
WITH docs AS (SELECT * FROM documents), {QUALITY_CTES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM quality
"""


_CRC = """list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)"""

#: Every pair of equal words within a text is a row; stretches of them at one distance are runs.
RUNS_SQL = f"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}+'), lambda x: x <> '') AS words,
         CASE WHEN doc_id IS NOT NULL THEN xor({_CRC}, 4294967295) END AS h
  FROM documents
), places AS (
  SELECT *, len(words) AS n, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN h // 10 % len(words) END AS a FROM base
), periods AS (
  SELECT *, 1 + (n - a) // (3 + h // 10 % 8) AS p FROM places
), word AS (
  SELECT r, i, CASE WHEN i >= a THEN words[1 + a + (i - a) % p] ELSE words[1 + i] END AS w FROM (SELECT *, unnest(range(n)) AS i FROM periods)
), pair AS (
  SELECT x.r, y.i - x.i AS q, x.i AS i FROM word x JOIN word y ON x.r = y.r AND x.w = y.w AND y.i > x.i
), stretch AS (
  SELECT r, q, min(i) AS s, count(*) + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pair) GROUP BY r, q, island
), run AS (
  SELECT r, s, len, min(q) AS q FROM stretch WHERE len >= 24 AND len >= 3 * q GROUP BY r, s, len
), listed AS (
  SELECT r, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM run GROUP BY r
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY CAST(len AS DOUBLE) / q DESC, s, q) AS k FROM run) WHERE k = 1
), dropped AS (
  SELECT DISTINCT r, unnest(range(s + q, s + len)) AS i FROM run
), kept AS (
  SELECT r, string_agg(w, ' ' ORDER BY i) AS text FROM word ANTI JOIN dropped USING (r, i) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.len AS length, best.q AS period, 1000 * best.len // best.q AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM base LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""

#: Every anchor against every row.
NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER o AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positive JOIN scored s USING (anchor_id)
WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW o AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER o <= 3
"""

_SAID = r"'\### Assistant: </turn> ok'"
_ESCAPED = r"replace(replace(replace({0}, '\', '\\'), '</', '<\/'), '##', '#\#')"

CHAT_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {_SAID} UNION ALL SELECT -7, 1, 'assistant', {_SAID}
), marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM turns
), sized AS (
  SELECT *, length({_ESCAPED.format("text")}) + 7 + CASE WHEN before IS DISTINCT FROM role THEN 6 + length(replace({_ESCAPED.format("role")}, ': ', ':\\ ')) ELSE 0 END AS chars FROM marked
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def _spans_sql(number: int) -> str:
    """(r, s, e, kind, number) of one rule: what lies between matches tells where each starts."""
    rule = (BASE_RULES + MORE_RULES)[number]
    pattern = rule.pattern.replace("'", "''")
    lengths = lambda c: f"coalesce(list_sum(list_transform({c}, lambda x: length(x))), 0)"
    found = f"SELECT r, regexp_extract_all(text, '{pattern}') AS hits, regexp_extract_all(text, '{pattern}', {rule.group}) AS vals, regexp_split_to_array(text, '{pattern}') AS gaps FROM base WHERE regexp_matches(text, '{pattern}')"
    each = f"SELECT r, CAST({lengths('gaps[1:i]')} + {lengths('hits[1:i - 1]')} AS BIGINT) AS s, length(hits[i]) AS n, length(vals[i]) AS v FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM ({found}))"
    return f"SELECT r, s, s + n AS e, '{rule.kind}' AS kind, {number} AS number FROM ({each}) WHERE v >= {rule.least}"


_LISTED = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, number)"

SECRETS_SQL = f"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), span AS (
  {" UNION ALL ".join(_spans_sql(n) for n in range(len(BASE_RULES + MORE_RULES)))}
), told AS (
  SELECT r, {", ".join(f"count(*) FILTER (WHERE kind = '{b.kind}') AS n_{b.kind}" for b in BASE_RULES)},
         {_LISTED} FILTER (WHERE number < {len(BASE_RULES)}) AS base_spans, {_LISTED} AS spans
  FROM span GROUP BY r
)
SELECT doc_id, {", ".join(f"coalesce(n_{b.kind}, 0) AS n_{b.kind}" for b in BASE_RULES)}, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM base LEFT JOIN told USING (r)
"""


def jaccard_sql(n: int, num: int, den: int) -> str:
    """Every pair of documents that share a shingle, and what those that link reach."""
    return f"""
WITH RECURSIVE base AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPACE}+'), lambda x: x <> '') AS words FROM documents
), shingle AS (
  SELECT DISTINCT r, array_to_string(words[i:i + {n - 1}], ' ') AS g FROM (SELECT r, words, unnest(range(1, greatest(2, len(words) - {n - 2}))) AS i FROM base WHERE len(words) > 0)
), sized AS (
  SELECT r, count(*) AS n FROM shingle GROUP BY r
), pair AS (
  SELECT a.r AS a, b.r AS b, count(*) AS shared FROM shingle a JOIN shingle b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r
), link AS (
  SELECT a, b FROM pair JOIN sized x ON x.r = a JOIN sized y ON y.r = b WHERE {den} * shared >= {num} * (x.n + y.n - shared)
), edge AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT r AS a, r AS b FROM base UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b
), least AS (
  SELECT reach.a AS r, min(doc_id) AS component_id FROM reach JOIN base ON base.r = reach.b GROUP BY reach.a
)
SELECT doc_id, coalesce(sized.n, 0) AS n_shingles, component_id FROM base JOIN least USING (r) LEFT JOIN sized USING (r)
"""


JACCARD_SQL = jaccard_sql(4, 85, 100)
