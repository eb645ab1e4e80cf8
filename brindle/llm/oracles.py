"""DuckDB SQL for the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

from . import quality
from .chat import Template
from .linededup import MIN_CHARS, MIN_DOCS
from .queries import HOSTILE

_OP1 = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"


def _escaped(column: str, template: Template) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in template.control:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


_T = Template()
_OP2 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{HOSTILE}'), (-1, 1, 'assistant', '{HOSTILE}')
), chats AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    string_agg('{_T.turn_start}' || {_escaped("role", _T)} || '{_T.role_end}' || {_escaped("text", _T)} || '{_T.turn_end}' || chr(10), '' ORDER BY turn, role, text) AS formatted,
    string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text) AS roles
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  length(formatted) AS formatted_chars, regexp_full_match(roles, 's?(ua)+') AS valid_order
FROM chats
"""

_OP5 = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), spread AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), judged AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id < s.last AS dropped FROM keyed k LEFT JOIN spread s USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_HAS_WORD = r"regexp_matches(line, '[^\x20\x09-\x0D]')"
_OP9 = f"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents
), windows AS (
  SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
  FROM (SELECT doc_id, pos, w[pos] AS a, w[pos + 1] AS b, w[pos + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS pos FROM words))
), repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS p FROM windows WHERE n > 1) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_text_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words) WHERE {_HAS_WORD} GROUP BY doc_id
), counts AS (
  SELECT doc_id, source, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_text_lines, 0) AS n_text_lines
  FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)
), ruled AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
    n_symbols > {quality.MAX_SYMBOLS_PER_WORD}::DOUBLE * n_words OR n_dup_lines > {quality.MAX_DUP_LINE_SHARE}::DOUBLE * n_text_lines AS further_failed
  FROM counts
), hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed OR further_failed) AS failed FROM ruled GROUP BY source
), sums AS (
  SELECT count(*)::DOUBLE AS h, sum(n)::DOUBLE AS n, sum(failed)::DOUBLE / sum(n) AS mean, sum(n::DOUBLE * n) AS squares FROM hosts
), spread AS (
  SELECT sum(hosts.n * (failed::DOUBLE / hosts.n - mean) ** 2) AS around FROM hosts, sums
), correlation AS (
  SELECT mean, CASE WHEN mean * (1 - mean) > 0 AND n - h + 1 - squares / n > 0 THEN (around / (mean * (1 - mean)) - (h - 1)) / (n - h + 1 - squares / n) ELSE 0 END AS r FROM sums, spread
), prior AS (
  SELECT mean, CASE WHEN r > 0 THEN least({quality.PRIOR_MOST}, greatest({quality.PRIOR_LEAST}, 1 / r - 1)) ELSE {quality.PRIOR_MOST} END AS strength FROM correlation
), rates AS (
  SELECT source, (failed + mean * strength) / (n + strength) AS rate FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (rate <= {quality.WATCH} OR (rate <= {quality.BAD} AND NOT further_failed)) AS kept
FROM ruled LEFT JOIN rates ON ruled.source IS NOT DISTINCT FROM rates.source
"""

ORACLES = {"op1_sharding": _OP1, "op2_chat": _OP2, "op5_linededup": _OP5, "op9_quality": _OP9}
