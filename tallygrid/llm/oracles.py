"""SQL for the queries of this folder that SQL can express on whole tables."""

NEAR_DEDUP = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id < y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b),
least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least_of ON a = d.doc_id
"""

SUBSTRING_DEDUP = r"""
WITH p AS (
  SELECT doc_id, text, list_filter(string_split(regexp_replace(coalesce(text, ''), '([^.!?][.!?][ \t\n\r]+|\n[ \t\n\r]*)', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS p
  FROM documents),
s AS (SELECT doc_id, list_transform(p, lambda x: rtrim(x, ' ' || chr(9) || chr(10) || chr(13))) AS s FROM p),
runs AS (
  SELECT doc_id, i, 3 AS n, s[i+1] || chr(2) || s[i+2] || chr(2) || s[i+3] AS run
  FROM (SELECT doc_id, unnest(range(0, len(s) - 2)) AS i, s FROM s WHERE len(s) >= 3)
  UNION ALL
  SELECT doc_id, i, 2 AS n, s[i+1] || chr(2) || s[i+2] AS run
  FROM (SELECT doc_id, unnest(range(0, len(s) - 1)) AS i, s FROM s WHERE len(s) >= 2) WHERE length(s[i+1]) + length(s[i+2]) >= 200),
again AS (
  SELECT doc_id, i, n FROM (SELECT doc_id, i, n, row_number() OVER (PARTITION BY n, run ORDER BY doc_id, i) AS k FROM runs) WHERE k > 1),
gone AS (SELECT doc_id, list(DISTINCT j ORDER BY j) AS gone FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM again) GROUP BY doc_id)
SELECT doc_id, len(p)::INT AS n_sentences, coalesce(len(gone), 0)::INT AS n_removed, coalesce(array_to_string(gone, ','), '') AS removed,
  sha256(CASE WHEN gone IS NULL THEN coalesce(text, '') ELSE coalesce(array_to_string(list_filter(p, lambda x, k: NOT list_contains(gone, k-1)), ''), '') END) AS kept_sha256
FROM p LEFT JOIN gone USING (doc_id)
"""

SUFFIX_ARRAY_DEDUP = r"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (SELECT doc_id, p, md5_number(substr(h, 2*p+1, 200)) AS w FROM (SELECT doc_id, h, unnest(range(0, n-99)) AS p FROM t WHERE n >= 100)),
again AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS k FROM windows) WHERE k > 1),
steps AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM again),
runs AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM steps),
spans AS (SELECT doc_id, r, min(p) AS a, max(p) + 100 AS b FROM runs GROUP BY doc_id, r),
kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS removed, max(b) AS last,
    string_agg(substr(h, 2*before+1, 2*(a-before)), '' ORDER BY a) AS head
  FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans) JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2*coalesce(last, 0)+1))) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""

#: The CRC of each distinct word is taken byte by byte with the table of its polynomial.
TARGET_RESAMPLING = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
q AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
raw AS (SELECT doc_id, unnest(w) AS w FROM d),
aim AS (SELECT unnest(w) AS w FROM q),
vocabulary AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM raw UNION SELECT w FROM aim)),
bytes AS (SELECT w, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b FROM vocabulary),
bucket AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM bytes, crc),
s AS (SELECT bucket, count(*) AS n FROM raw JOIN bucket USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM aim JOIN bucket USING (w) GROUP BY bucket),
gain AS (
  SELECT s.bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM raw) + 10000)::DOUBLE)
    / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM aim) + 10000)::DOUBLE)))::BIGINT AS g
  FROM s LEFT JOIN t USING (bucket)),
mean AS (SELECT doc_id, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM raw JOIN bucket USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN mean USING (doc_id)),
able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20),
drawn AS (SELECT * FROM able WHERE rank <= (SELECT 10 * count(*) // 100 FROM able))
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN drawn USING (doc_id)
"""
