"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

OP7 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) = 1 AS kept,
       text_sha256
FROM d
"""

# the control strings and how they are broken, as in the formatter's rule
_CONTROL = (
    r"(<)(\||s>|/s>|<SYS>>|</SYS>>|bos>|eos>|pad>|unk>|start_of_turn>|end_of_turn>)"
    r"|(\[)(INST\]|/INST\]|SYSTEM_PROMPT\]|/SYSTEM_PROMPT\]|AVAILABLE_TOOLS\]|/AVAILABLE_TOOLS\]"
    r"|TOOL_CALLS\]|TOOL_RESULTS\]|/TOOL_RESULTS\])"
)


def _escaped_chars(text: str) -> str:
    return rf"length(regexp_replace({text}, '{_CONTROL}', '\1\3\\\2\4', 'g'))"


OP4 = rf"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
         {_escaped_chars(r"replace(replace(role, '\', '\\'), chr(10), '\' || chr(10))")} AS role_chars,
         {_escaped_chars(r"replace(text, '\', '\\')")} AS text_chars
  FROM rows_)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(length(loss))::BIGINT AS loss_chars,
       sha256(string_agg(loss, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
       sum(12 + role_chars + 1 + text_chars + 11)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

OP5 = r"""
WITH d AS (
  SELECT *, greatest(length(coalesce(text, '')), 1) AS size,
         (CAST('0x' || substr(md5('20240229:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13)
               AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
sizes AS (SELECT source, sum(size)::DOUBLE AS size FROM d GROUP BY source),
rates AS (
  SELECT source, pow(size, 0.5) / sum(pow(size, 0.5)) OVER () * sum(size) OVER () / size AS rate FROM sizes),
cells AS (
  SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1.0))) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM rates, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT) + 1)) AS r(k)),
counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(*) FILTER (WHERE cdf < u) AS n
  FROM d JOIN cells ON d.source IS NOT DISTINCT FROM cells.source GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, copy FROM counted, unnest(range(1, n + 1)) AS r(copy)
"""

OP10 = r"""
WITH page AS (
  SELECT page_id, url, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host,
         nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '') AS path,
         DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INT) AS fetched_at
  FROM pages),
entries AS (
  SELECT DISTINCT entry FROM (
    SELECT unnest([host, regexp_extract(host, '^[^.]+\.([^.]+\..+)$', 1),
                   host || regexp_extract(url, '^[a-z]+://[^/]+(/[^/?#]+/)', 1)]) AS entry FROM page)
  WHERE entry <> ''),
h AS (SELECT entry, CAST('0x' || substr(md5(entry), 1, 8) AS BIGINT) AS h FROM entries),
dated AS (
  SELECT entry, h, (h // 4) % 300 AS start, 1 + (h // 1200) % 90 AS stay FROM h WHERE h % 4 = 0),
events AS (
  SELECT entry, 'add' AS action, DATE '2024-01-01' + CAST(start AS INT) AS listed_at FROM dated
  UNION ALL SELECT entry, 'remove', DATE '2024-01-01' + CAST(start + stay AS INT) FROM dated WHERE h % 3 > 0
  UNION ALL SELECT entry, 'add', DATE '2024-01-01' + CAST(start + stay + 14 AS INT) FROM dated WHERE h % 3 > 1),
daily AS (SELECT entry, listed_at, max(action) AS action FROM events GROUP BY ALL),
spans AS (
  SELECT entry, action, listed_at AS valid_from, lead(listed_at) OVER (PARTITION BY entry ORDER BY listed_at) AS valid_to
  FROM daily),
cut AS (
  SELECT page_id, fetched_at, host, string_split(host, '.') AS labels,
         list_filter(string_split(coalesce(path, ''), '/'), lambda x: x <> '') AS parts
  FROM page WHERE host IS NOT NULL),
keyed AS (
  SELECT page_id, fetched_at, array_to_string(labels[i:], '.') AS entry
  FROM cut, unnest(range(1, 1 + greatest(len(labels) - 1, 1))) AS r(i)
  UNION
  SELECT page_id, fetched_at, host || '/' || array_to_string(parts[:i], '/') || '/'
  FROM cut, unnest(range(1, 1 + len(parts))) AS r(i)),
active AS (
  SELECT page_id, k.entry, valid_from FROM keyed k JOIN spans s
  ON k.entry = s.entry AND s.action = 'add' AND fetched_at >= valid_from AND (valid_to IS NULL OR fetched_at < valid_to)),
verdict AS (
  SELECT page_id, count(*) AS n_active, arg_max({'entry': entry, 'valid_from': valid_from}, (length(entry), entry)) AS best
  FROM active GROUP BY page_id)
SELECT p.page_id, url, host, fetched_at, n_active IS NOT NULL AS blocked, coalesce(n_active, 0) AS n_active,
       best.entry AS entry, best.valid_from AS listed_at
FROM page p LEFT JOIN verdict USING (page_id)
"""

_TERMS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

OP11 = rf"""
WITH postings AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM postings GROUP BY doc_id),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
asked AS (
  SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM postings, whole GROUP BY term, n_docs),
norms AS (SELECT doc_id, 100 - 25 + (25 * n * n_docs) // n_terms AS m FROM lengths, whole),
scored AS (
  SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN norms USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""

ORACLE_SQL = {
    "op11_search": OP11,
    "op4_chat": OP4,
    "op5_mixing": OP5,
    "op10_url_filter": OP10,
    "op7_exact_dedup": OP7,
}
