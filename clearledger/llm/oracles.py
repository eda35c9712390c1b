"""SQL for the queries that SQL can express."""

from __future__ import annotations

QUALITY = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), cut AS (
  SELECT doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda line: regexp_matches(line, '[^\x20\x09-\x0D]')) AS lines
  FROM docs
), one AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM cut
), three AS (
  SELECT doc_id, i, word, lead(word, 1) OVER line AS second, lead(word, 2) OVER line AS third
  FROM one WINDOW line AS (PARTITION BY doc_id ORDER BY i)
), counted AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, second, third) AS n FROM three WHERE third IS NOT NULL
), gaps AS (
  SELECT doc_id, least(3, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 3)) AS gap
  FROM counted WHERE n > 1
), repeated AS (
  SELECT doc_id, sum(gap) AS n_repeat_words FROM gaps GROUP BY doc_id
), measured AS (
  SELECT doc_id, host, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM cut LEFT JOIN repeated USING (doc_id)
), flagged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         10 * n_symbols > n_words AS symbols, 5 * n_dup_lines > n_words AS dup_lines,
         word_chars < 3 * n_words OR word_chars > 12 * n_words AS word_length
  FROM measured
), long_form AS (
  SELECT host, rule, failed
  FROM (UNPIVOT (SELECT host, base_failed::INT AS base_failed, symbols::INT AS symbols, dup_lines::INT AS dup_lines,
                        word_length::INT AS word_length FROM flagged)
        ON base_failed, symbols, dup_lines, word_length INTO NAME rule VALUE failed)
), hosts AS (
  SELECT host, rule, count(*) AS n, sum(failed) AS k FROM long_form GROUP BY host, rule
), priors AS (
  SELECT rule, avg(k / n) AS mean, var_samp(k / n) AS spread, avg(1 / n) AS inverse FROM hosts GROUP BY rule
), compared AS (
  SELECT rule, mean, CASE WHEN mean * (1 - mean) > 0 AND inverse < 1
                          THEN (spread / (mean * (1 - mean)) - inverse) / (1 - inverse) END AS alike
  FROM priors
), weighed AS (
  SELECT rule, mean, CASE WHEN alike > 0 THEN least(100, greatest(4, (1 - alike) / alike)) ELSE 100 END AS weight
  FROM compared
), bad AS (
  SELECT DISTINCT host FROM hosts JOIN weighed USING (rule) WHERE (k + weight * mean) / (n + weight) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND host NOT IN (SELECT host FROM bad) AS kept
FROM flagged
"""

CHAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), sized AS (
  SELECT *, (strlen(text) + 3) // 4 + 4 AS tokens,
         12 + length(role) + 1 + length(text) + len(regexp_extract_all(text, '<\\*\|')) + 11 AS chars
  FROM rows
), summed AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn, role, text
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begun
  FROM sized
), headed AS (
  SELECT *, begun = 0 AND role = 'system' AS head,
         coalesce(max(CASE WHEN begun = 0 AND role = 'system' THEN tokens END) OVER (PARTITION BY conv_id), 0) AS room,
         max(CASE WHEN begun = 0 AND role = 'system' THEN chars END) OVER (PARTITION BY conv_id) AS head_chars
  FROM summed
), strided AS (
  SELECT *, greatest(128, (1024 - 128 - room) // 2) AS stride,
         CASE WHEN head THEN -1 ELSE begun - room END AS b,
         CASE WHEN head THEN 0 ELSE begun - room + tokens END AS e
  FROM headed
), stepped AS (
  SELECT *, CASE WHEN head THEN 0 ELSE b // stride END AS step, NOT head AND tokens > stride AS long FROM strided
), placed AS (
  SELECT *, step * 2 + long::BIGINT AS win,
         coalesce(min(CASE WHEN long THEN b END) OVER (PARTITION BY conv_id, step),
                  max(e) OVER (PARTITION BY conv_id, step)) AS next
  FROM stepped
), windows AS (
  SELECT conv_id, win, min(b) AS opened, sum(chars) AS chars, bool_or(head) AS own_head, any_value(head_chars) AS head_chars
  FROM placed GROUP BY conv_id, win
), again AS (
  SELECT p.conv_id, sum(p.chars) AS chars
  FROM placed p JOIN windows w ON p.conv_id = w.conv_id AND w.opened = p.next AND w.win <> p.win
  WHERE NOT p.head AND NOT p.long AND p.b >= p.next - 128
  GROUP BY p.conv_id
), totals AS (
  SELECT conv_id, sum(chars) + sum(CASE WHEN own_head THEN 0 ELSE coalesce(head_chars, 0) END) AS chars
  FROM windows GROUP BY conv_id
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (any_value(t.chars) + coalesce(any_value(a.chars), 0))::BIGINT AS formatted_chars
FROM rows JOIN totals t USING (conv_id) LEFT JOIN again a USING (conv_id)
GROUP BY conv_id
"""

LINES = """
WITH cut AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM cut
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.*, s.keeper IS NOT NULL AND s.keeper <> k.doc_id AS dropped FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

NEGATIVES = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         list_inner_product(a.v, c.v)::BIGINT AS score
  FROM rows a JOIN rows c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM positives JOIN scored USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""

# The checksum of a decimal number: SQL has no crc32, so its shift steps are spelled out.
_STEP = "list_reduce(list_prepend({}, range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
_CRC = f"""
xor(list_reduce(list_prepend(4294967295, [ascii(d)::BIGINT FOR d IN string_split(conv_id::VARCHAR, '')]),
                lambda crc, byte: {_STEP.format("xor(crc, byte)")}), 4294967295)
"""

TRIE = f"""
WITH ordered AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
                       ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), heads AS (
  SELECT conv_id, turns, {_CRC} % 6 AS h FROM ordered
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
  FROM heads c LEFT JOIN ordered b ON b.conv_id = c.conv_id - c.conv_id % 100
), prefixes AS (
  SELECT conv_id, unnest(range(len(turns) + 1)) AS depth, turns FROM rebuilt
), members AS (
  SELECT conv_id, depth, len(turns) = depth AS ends, turns[1:depth] AS node FROM prefixes
), nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, bool_and(ends) AS leaf,
         CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * length(node[depth].text) END AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY node, depth
), children AS (
  SELECT node[1:depth - 1] AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), spread AS (
  SELECT node, leaf, saved, unnest(range(depth + 1)) AS top FROM nodes
), totals AS (
  SELECT node[1:top] AS node, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens FROM spread GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, t.n_leaves,
       t.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN totals t ON n.node = t.node LEFT JOIN children c ON n.node = c.node
LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.node[1:n.depth - 1]
"""
