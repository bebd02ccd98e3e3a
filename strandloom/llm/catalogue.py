"""The numbered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import queries as q

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_simhash": q.op1_simhash,
    "op2_media_webp": q.op2_media_webp,
    "op3_passages": q.op3_passages,
    "op4_decontaminate": q.op4_decontaminate,
    "op5_quality": q.op5_quality,
    "op6_shards": q.op6_shards,
    "op7_mixture": q.op7_mixture,
    "op8_line_dedup": q.op8_line_dedup,
    "op9_warc": q.op9_warc,
    "op10_chat": q.op10_chat,
    "op11_phrases": q.op11_phrases,
    "op12_likelihood": q.op12_likelihood,
    "op13_runs": q.op13_runs,
}

#: op7 is left out: its draw is a hash that DuckDB hasn't got.
ORACLES: dict[str, str] = {}

ORACLES["op4_decontaminate"] = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM item_words, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT k FROM windows),
doc_words AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w
  FROM documents),
starts AS (
  SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM doc_words, lengths, unnest(range(1, len(w) - k + 2)) AS t(i)),
found AS (SELECT r, s.k, i, item_id FROM starts s JOIN windows USING (k, win)),
marks AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM found, unnest(range(0, k)) AS t(j) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN marks USING (r) LEFT JOIN items USING (r)
"""

ORACLES["op8_line_dedup"] = r"""
WITH lines AS (
  SELECT r, doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
        FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
owners AS (SELECT key, min(doc_id) AS owner FROM lines WHERE length(key) >= 10 GROUP BY key),
marked AS (SELECT r, doc_id, pos, line, coalesce(doc_id > owner, false) AS gone FROM lines LEFT JOIN owners USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""

ORACLES["op10_chat"] = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
told AS (
  SELECT conv_id, count(*) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss
  FROM turns GROUP BY conv_id),
{windows}
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM told JOIN sized USING (conv_id)
""".replace("{windows}", r"""
sized_turns AS (
  SELECT *, CAST(ceil(length(text) / 4) + 4 AS BIGINT) AS tokens,
         CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 14 + length(role) END
         + length(text) + 2 * (length(text) - length(translate(text, '%[<]', ''))) AS chars FROM turns),
placed AS (
  SELECT *, CAST(floor(coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1024) AS BIGINT) AS span
  FROM sized_turns),
ended AS (
  SELECT *, sum(tokens) OVER (PARTITION BY conv_id, span ORDER BY turn DESC, role DESC, text DESC ROWS UNBOUNDED PRECEDING) AS to_end,
         max(span) OVER (PARTITION BY conv_id) AS last_span FROM placed),
first_system AS (SELECT conv_id, arg_min(chars, (turn, role, text)) AS chars, arg_min(span, (turn, role, text)) AS span FROM placed WHERE role = 'system' GROUP BY conv_id),
ahead AS (SELECT p.conv_id, s.chars FROM (SELECT DISTINCT conv_id, span FROM placed) p JOIN first_system s ON p.conv_id = s.conv_id AND p.span > s.span),
sized AS (
  SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM (
    SELECT conv_id, chars FROM placed
    UNION ALL SELECT conv_id, chars FROM ended WHERE to_end <= 256 AND span < last_span AND role <> 'system'
    UNION ALL SELECT conv_id, chars FROM ahead) GROUP BY conv_id)""")

ORACLES["op11_phrases"] = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM pieces, (VALUES (1), (2), (3)) AS s(k), unnest(range(1, len(w) - k + 2)) AS t(i)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 10),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
cuts AS (
  SELECT c.lang, c.phrase, c.a, j, x.f AS l, y.f AS r, 1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates) c
  JOIN f x ON x.lang = c.lang AND x.k = j AND x.phrase = array_to_string(w[1 : j], ' ')
  JOIN f y ON y.lang = c.lang AND y.k = c.k - j AND y.phrase = array_to_string(w[j + 1 :], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
within AS (
  SELECT lang, array_to_string(w[i : i + 1], ' ') AS phrase, max(a) AS longer
  FROM candidates, unnest(range(1, 3)) AS t(i) WHERE k = 3 GROUP BY ALL)
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
  FROM lowest LEFT JOIN within USING (lang, phrase) JOIN totals USING (lang)
  WHERE longer IS NULL OR 100 * longer < 50 * a)
WHERE rank <= 2000
"""
