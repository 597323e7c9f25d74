"""DuckDB SQL with the rows of the corpus queries that SQL can express."""

from __future__ import annotations

from riskloom.llm.quality import ALPHA, DELTA, GRID, MAX_STRATA, PRICE, RULES

_SPACE = r"[\x20\x09-\x0D]"
_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
_CHARS = "length(text) - length(translate(text, '{0}', ''))"
_RATE = ALPHA / len(RULES)
#: P(Binomial(n, rate) <= k), or 1 beyond the mean.
_TAIL = f"""CASE WHEN n_good <= 0 OR k > n_good * {_RATE!r}::DOUBLE THEN 1.0 ELSE least(1.0::DOUBLE, list_sum(list_transform(range(0, k + 1),
  lambda j: exp(lgamma(n_good + 1) - lgamma(j + 1) - lgamma(n_good - j + 1) + j * ln({_RATE!r}::DOUBLE) + (n_good - j) * ln(1 - {_RATE!r}::DOUBLE))))) END"""

QUALITY_SQL = f"""WITH docs AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT doc_id, {_WORDS} AS words FROM docs),
windows AS MATERIALIZED (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win FROM w, LATERAL (SELECT unnest(range(1, len(words) - 6)) AS i)),
again AS (SELECT doc_id, win FROM windows GROUP BY doc_id, win HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM windows SEMI JOIN again USING (doc_id, win)) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(DISTINCT line) AS d FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
counts AS MATERIALIZED (SELECT doc_id, lang, len(words) AS n_words, length(regexp_replace(text, '{_SPACE}', '', 'g')) AS word_chars, {_CHARS.format("#*$%&|<>")} AS n_symbols,
  coalesce(lines.n - lines.d, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines,
  {_CHARS.format("ABCDEFGHIJKLMNOPQRSTUVWXYZ")} AS upper_, {_CHARS.format("!")} AS bangs, {_CHARS.format("|")} AS bars
  FROM docs JOIN w USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)),
signals AS MATERIALIZED (SELECT *, n_symbols::DOUBLE / greatest(word_chars, 1) AS symbol_ratio, upper_::DOUBLE / greatest(word_chars, 1) AS upper_ratio, bangs::DOUBLE / greatest(n_words, 1) AS bang_ratio,
  bars::DOUBLE / greatest(n_words, 1) AS bar_ratio, n_dup_lines::DOUBLE / greatest(n_lines, 1) AS dup_line_ratio, n_repeat_words::DOUBLE / greatest(n_words, 1) AS repeat_ratio,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts),
common AS (SELECT lang FROM signals JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT {MAX_STRATA}),
placed AS MATERIALIZED (SELECT s.*, coalesce('=' || c.lang, '') AS stratum FROM signals s LEFT JOIN common c ON s.lang = c.lang),
grid AS (SELECT unnest(range({len(GRID)})) AS step, unnest({GRID}::DOUBLE[]) AS cutoff),
marked AS (UNPIVOT (SELECT stratum, quality, {", ".join(RULES)} FROM placed JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND NOT base_failed) ON {", ".join(RULES)} INTO NAME rule VALUE x),
totals AS MATERIALIZED (SELECT stratum, rule, step, cutoff, count(*) FILTER (quality = 1) AS n_good, count(*) FILTER (quality = 1 AND x > cutoff) AS k, count(*) FILTER (quality = 0 AND x > cutoff) AS bad
  FROM marked, grid GROUP BY ALL),
tested AS (SELECT *, bad - {PRICE} * k AS gain, min(CASE WHEN {_TAIL} <= {DELTA!r}::DOUBLE / ({len(RULES)} * (SELECT count(DISTINCT stratum) FROM totals)) THEN 1 ELSE 0 END) OVER (PARTITION BY stratum, rule ORDER BY step) AS passed FROM totals),
cuts AS (SELECT stratum, rule, cutoff FROM (SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, step) AS place FROM tested WHERE passed = 1) WHERE place = 1 AND gain > 0),
hit AS (SELECT DISTINCT doc_id FROM (UNPIVOT (SELECT doc_id, stratum, {", ".join(RULES)} FROM placed) ON {", ".join(RULES)} INTO NAME rule VALUE x) JOIN cuts USING (stratum, rule) WHERE x > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM hit) AS kept FROM placed"""

_ESCAPED = "replace({0}, '&', '&amp;')"
for _mark in ("<|start|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"):
    _ESCAPED = f"replace({_ESCAPED}, '{_mark}', '{'&lt;' if _mark[0] == '<' else '&lb;'}{_mark[1:]}')"
_ROLE, _TEXT = "replace(" + _ESCAPED.format("role") + ", chr(10), '&nl;')", _ESCAPED.format("text")
CHAT_SQL = f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
whole AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS body,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, string_agg(role, ',' ORDER BY turn, role, text) AS roles,
  sum(length('<|start|>' || {_ROLE} || chr(10) || {_TEXT} || '<|end|>' || chr(10)))::BIGINT AS formatted_chars FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(body) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
  regexp_matches(roles, '^(system,)?user,assistant(,user,assistant)*$') AS valid FROM whole"""
