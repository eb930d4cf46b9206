"""DuckDB SQL for the queries of this subpackage that SQL can express."""

OP9 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
esc AS (
  SELECT *, replace(replace(replace(text, '\', '\0'), '###', '\1'), '</turn>', '\2') AS text_e,
    replace(replace(replace(replace(role, '\', '\0'), '###', '\1'), '</turn>', '\2'), chr(10), '\n') AS role_e,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
  FROM turns),
ok AS (
  SELECT *, CASE WHEN role = 'system' THEN k = 1
                 WHEN role = 'user' THEN k = 1 OR before = 'assistant' OR before = 'system' AND k = 2
                 WHEN role = 'assistant' THEN k > 1 AND before = 'user' ELSE false END AS moves
  FROM esc)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(role_e) + 1 + length(text_e) + 9) AS BIGINT) AS formatted_chars,
  bool_and(moves) AND arg_max(role, k) = 'assistant' AS valid,
  min(k) FILTER (WHERE NOT moves) - 1 AS first_bad_turn
FROM ok GROUP BY conv_id
"""

OP10 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS weight FROM per),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source_size * 1.0 / weight, source NULLS LAST) AS rank, sum(source_size) OVER () AS total,
    sum(weight) OVER () AS weights FROM weighed),
rest AS (
  SELECT *, 3 * total - 4 * coalesce(sum(source_size) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words,
    weights - coalesce(sum(weight) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM ranked),
level AS (SELECT words, open, rank FROM rest WHERE words * weight <= 4 * source_size * open ORDER BY rank LIMIT 1),
goal AS (
  SELECT r.source, r.source_size,
    CASE WHEN r.rank < coalesce(l.rank, r.rank + 1) THEN CAST(2 * r.source_size AS DOUBLE)
         ELSE CAST(l.words * r.weight AS DOUBLE) / CAST(2 * l.open AS DOUBLE) END AS target
  FROM rest r LEFT JOIN level l ON true),
plan AS (
  SELECT *, CAST(floor(target) AS BIGINT) AS budget,
    CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM goal),
summed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.epochs, p.budget - p.epochs * p.source_size AS left_over,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS before
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, left_over - before)) AS BIGINT) AS taken
FROM summed
"""

OP3 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
win AS (
  SELECT r, i, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (
  SELECT r, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY r, word, w2, w3) >= 2 AS t, length(word) AS chars FROM win),
covered AS (
  SELECT r, chars, t OR coalesce(lag(t, 1) OVER o, false) OR coalesce(lag(t, 2) OVER o, false) AS c FROM twice WINDOW o AS (PARTITION BY r ORDER BY i)),
words AS (SELECT r, count(*) AS n_words, sum(chars) AS word_chars, count(*) FILTER (WHERE c) AS n_repeat_words FROM covered GROUP BY r),
lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
s AS (
  SELECT d.doc_id, d.lang, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper
  FROM d LEFT JOIN words USING (r) LEFT JOIN lines USING (r)),
b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    [CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END, CASE WHEN word_chars > 0 THEN 1000 * n_upper // word_chars ELSE 0 END,
     CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END, CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END] AS scores
  FROM s),
q AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
held AS (
  SELECT lang, rule, scores[rule] AS score, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality = 0) AS bad
  FROM b JOIN q USING (doc_id), range(1, 5) t(rule) WHERE NOT base_failed GROUP BY 1, 2, 3),
tried AS (
  SELECT *, sum(good) OVER g AS n_good, sum(bad) OVER g AS n_bad, sum(good) OVER u - good AS k, sum(bad) OVER u - bad AS j, lag(score) OVER u AS above,
    (SELECT count(*) FROM (SELECT DISTINCT lang, rule FROM held)) AS tests
  FROM held WINDOW g AS (PARTITION BY lang, rule), u AS (PARTITION BY lang, rule ORDER BY score DESC)),
gains AS (
  SELECT *, j * n_good - 10 * k * n_bad AS gain,
    list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1), lambda i: exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln(0.0125) + (n_good - i) * ln(1 - 0.0125)))) AS tail
  FROM tried WHERE above IS NOT NULL AND n_good > 0),
best AS (SELECT *, max(gain) OVER (PARTITION BY lang, rule) AS top FROM gains WHERE gain > 0 AND tail <= 0.05 / tests),
cutoffs AS (SELECT lang, rule, (min(score) + max(above) - 1) // 2 AS cutoff FROM best WHERE gain = top GROUP BY 1, 2),
numbered AS (SELECT * FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM cutoffs c WHERE numbered.lang IS NOT DISTINCT FROM c.lang AND numbered.scores[c.rule] > c.cutoff) AS kept
FROM numbered
"""

OP2 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND vec_id IS NOT NULL),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM (SELECT DISTINCT ON (vec_id) * FROM v WHERE vec_id % 50 = 0) a JOIN v b ON a.vec_id <> b.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

OP6 = r"""
WITH base AS (
  SELECT page_id AS p, url, coalesce(html, '') AS h, regexp_replace(url, '#.*$', '') || '#again' AS spelt,
    to_timestamp(1700000000 + page_id * 7919 % 2592000) AS t FROM pages),
records AS (
  SELECT p * 4 AS id, p, true AS whole, url, t, h AS body, 0 AS v FROM base
  UNION ALL SELECT p * 4 + 1, p, true, spelt, t + INTERVAL 10 DAY, h || '<!-- 2 -->', 1 FROM base WHERE p % 3 = 0
  UNION ALL SELECT p * 4 + 2, p, false, spelt, t + (p % 5 * 4 - 1) * INTERVAL 1 DAY, h, 0 FROM base),
parts AS (
  SELECT *, regexp_extract(url, '^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$', ['host', 'path', 'query']) AS u FROM records),
canon AS (
  SELECT *, regexp_replace(regexp_replace(lower(u.host), ':(80|443)?$', ''), '^www\.', '') AS host,
    array_to_string(list_sort(list_filter(string_split(u.query, '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&') AS query FROM parts),
keyed AS (
  SELECT *, CASE WHEN host <> '' THEN host || regexp_replace(u.path, '/+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END ELSE trim(url) END AS canonical,
    '"' || substr(md5(body), 1, 16) || '"' AS tag FROM canon),
linked AS (
  SELECT r.id AS record_id, r.canonical, r.p, r.tag AS own_tag, s.id AS source_id, s.p AS sp, s.v AS sv, s.tag, s.body
  FROM (SELECT * FROM keyed WHERE NOT whole) r LEFT JOIN (SELECT * FROM keyed WHERE whole) s
    ON s.canonical = r.canonical AND s.t < r.t
  QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY s.t DESC NULLS LAST, s.id DESC) = 1),
judged AS (
  SELECT *, CASE WHEN source_id IS NULL THEN 'no_earlier'
    WHEN p % 4 <> 2 THEN CASE WHEN p % 4 < 2 AND own_tag = tag THEN 'merged' ELSE 'mismatch' END
    WHEN p % 3 <> 1 THEN CASE WHEN p % 97 + p % 2 = sp % 97 + sv THEN 'merged' ELSE 'mismatch' END
    ELSE 'unverified' END AS outcome FROM linked)
SELECT record_id, canonical, outcome, source_id,
  CASE WHEN outcome = 'merged' THEN 'cache-control: no-cache' || chr(10) || 'content-length: ' || CAST(strlen(body) AS VARCHAR) || chr(10) || 'content-type: text/html' || chr(10)
    || 'etag: ' || CASE p % 4 WHEN 1 THEN 'W/' || own_tag ELSE tag END || chr(10)
    || 'last-modified: ' || CAST(sp % 97 + sv AS VARCHAR) || chr(10) || 'x-seen: ' || CAST(p % 10 AS VARCHAR) END AS headers,
  CASE WHEN outcome = 'merged' THEN sha256(body) END AS payload_sha256
FROM judged
"""

_ROUND = """
near{i} AS (
  SELECT vec_id, q, arg_min(c.k, d * 16 + c.k) AS cluster, min(d) AS distance
  FROM (SELECT v.r, v.vec_id, v.q, c.k, CAST(list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{i} c) c
  GROUP BY r, vec_id, q)"""
_MOVE = """,
sums{i} AS (
  SELECT cluster, place, CAST(sum(x) AS BIGINT) AS total, count(*) AS n
  FROM (SELECT cluster, unnest(q) AS x, generate_subscripts(q, 1) AS place FROM near{i}) GROUP BY 1, 2),
moved{i} AS (SELECT cluster AS k, list((total - ((total % n) + n) % n) // n ORDER BY place) AS q FROM sums{i} GROUP BY 1),
c{j} AS (SELECT c{i}.k, coalesce(m.q, c{i}.q) AS q FROM c{i} LEFT JOIN moved{i} m USING (k)),"""
OP11 = (
    r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY h, q) - 1 AS k, q
  FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, q FROM v ORDER BY h, q LIMIT 16)),"""
    + "".join(_ROUND.format(i=i) + (_MOVE.format(i=i, j=i + 1) if i < 3 else "") for i in range(4))
    + """
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.q, ',')) AS centroid_sha256
FROM near3 JOIN c3 ON cluster = c3.k
"""
)

OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
each AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM each GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
sized AS (SELECT lang, count(*) AS v, CAST(sum(total) AS BIGINT) AS n FROM kept GROUP BY 1),
n AS (SELECT lang, source, term, count(*) AS n FROM each JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
g AS (
  SELECT lang, source, coalesce(any_value(v), 0) AS v, CAST(coalesce(any_value(own), 0) AS BIGINT) AS own, coalesce(any_value(sized.n), 0) AS lang_n
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS own FROM n GROUP BY 1, 2) USING (lang, source) LEFT JOIN sized USING (lang) GROUP BY 1, 2),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(n.n, 0) + 2) // (own + 2 * v) AS BIGINT) AS p,
    CAST(1 + CAST(1000000000 AS HUGEINT) * (k.total + 2) // (lang_n + 2 * v) AS BIGINT) AS q
  FROM g JOIN kept k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(CAST(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS BIGINT), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY 1, 2, 3),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
both_parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts) WHERE part = 'pair' OR rank <= 10
"""

SQL = {"op11_centroid_clusters": OP11, "op13_source_divergence": OP13, "op6_warc_revisits": OP6, "op2_bit_sliced_top_k": OP2, "op3_quality_rules": OP3, "op9_chat_format": OP9, "op10_mix": OP10}
