"""DuckDB SQL for the opN_ queries that SQL can express."""

_WORD = r"[^\x20\x09-\x0D]+"

OP2 = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, payload_bytes, d.payload_digest,
       CASE WHEN first_id IS DISTINCT FROM d.page_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS DISTINCT FROM d.page_id THEN first_id END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
"""

OP3 = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT rid, i, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
c AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n_repeat_words FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM r) GROUP BY 1),
s AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
         length(text) - length(regexp_replace(text, '\p{Lu}+', '', 'g')) AS up, length(text) - length(regexp_replace(text, '!+', '', 'g')) AS marks,
         length(text) - length(regexp_replace(text, '\p{L}+', '', 'g')) AS letters
  FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 4 * n_symbols > n_words OR 10 * n_dup_lines > 5 * n_lines OR 10 * up > 4 * letters
            OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 10 * marks > 3 * n_words OR 10 * letters < 4 * word_chars) AS kept
FROM b
"""

OP4 = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS h, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY 1),
k AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::BIGINT AS w, [-0.5, 0.0, 0.5][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS slope FROM s),
f AS (SELECT *, 3 * n / w AS lvl, sum(n) OVER ()::BIGINT AS total, sum(w) OVER ()::BIGINT AS all_w,
             coalesce(sum(3 * n) OVER o, 0)::BIGINT AS full_n, coalesce(sum(w) OVER o, 0)::BIGINT AS full_w
      FROM k WINDOW o AS (ORDER BY 3 * n / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT total - full_n AS words, all_w - full_w AS weight FROM f WHERE (total - full_n) * w <= 3 * n * (all_w - full_w) ORDER BY lvl, source IS NULL, source LIMIT 1),
g AS (SELECT source, n, slope, coalesce(least((words * w)::DOUBLE / weight::DOUBLE, (3 * n)::DOUBLE), 0.0) AS target FROM f, e),
p AS (SELECT d.doc_id, d.size, g.n AS source_size, g.target, g.slope,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id, d.size, d.text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, (CASE WHEN size = 0 THEN 1 WHEN target - place - size / 2.0 < 0 THEN 0 ELSE least(3, floor((target - place - size / 2.0) / source_size) + 1) END)::BIGINT AS copies FROM p),
u AS (SELECT *, least(1.0, CASE WHEN target > 0 THEN (place + size / 2.0) / target ELSE 0 END)::DOUBLE AS a, least(1.0, CASE WHEN target > 0 THEN (place + (copies - 1) * source_size + size / 2.0) / target ELSE 0 END)::DOUBLE AS z FROM c)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies,
       CASE WHEN copies > 0 THEN round(CASE WHEN slope = 0 THEN a ELSE 2 * a / (1 - slope + sqrt(greatest(0.0, (1 - slope) * (1 - slope) + 4 * slope * a))) END, 9) END AS first_position,
       CASE WHEN copies > 0 THEN round(CASE WHEN slope = 0 THEN z ELSE 2 * z / (1 - slope + sqrt(greatest(0.0, (1 - slope) * (1 - slope) + 4 * slope * z))) END, 9) END AS last_position
FROM u
"""

_NORMAL = r"translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP5 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_NORMAL.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all({_NORMAL.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT rid, i, m, array_to_string(w[i:i + m - 1], ' ') AS g
      FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
hit AS (SELECT rid, i, g.m, item_id FROM g JOIN p ON g.g = p.g AND g.m = p.m),
c AS (SELECT rid, count(DISTINCT k)::BIGINT AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS k FROM hit) GROUP BY 1),
n AS (SELECT rid, count(*)::BIGINT AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN n USING (rid)
"""

_LENGTH = r"length(regexp_replace(regexp_replace(replace({}, '\', '\e'), '<\||</?s>|<</?SYS>>', '\0#', 'g'), '\[/?INST\]', '\0#', 'g'))"
OP6 = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(12 + length(role) + 1 + {_LENGTH.format("text")} + 11)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

ORACLES: dict[str, str] = {"op2_warc_zip": OP2, "op3_quality": OP3, "op4_mixture": OP4, "op5_decontaminate": OP5, "op6_chat": OP6}
