"""SQL twins of the operators that SQL can express."""

from __future__ import annotations

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

OP2 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
d AS (
  SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32),
    lambda i: substr('{BASE32}', ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest
  FROM h),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM w
"""

OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: crc32 over the UTF-8 bytes: eight shifts make the table, a fold runs over the bytes.
CRC = """
crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
codes AS (
  SELECT *, flatten(list_transform(CASE WHEN length(body) = 0 THEN [] ELSE string_split(body, '') END, lambda ch: CASE
    WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT]
    WHEN unicode(ch) < 2048 THEN [192 | (unicode(ch) >> 6)::BIGINT, 128 | (unicode(ch) & 63)::BIGINT]
    WHEN unicode(ch) < 65536 THEN [224 | (unicode(ch) >> 12)::BIGINT, 128 | ((unicode(ch) >> 6) & 63)::BIGINT, 128 | (unicode(ch) & 63)::BIGINT]
    ELSE [240 | (unicode(ch) >> 18)::BIGINT, 128 | ((unicode(ch) >> 12) & 63)::BIGINT, 128 | ((unicode(ch) >> 6) & 63)::BIGINT, 128 | (unicode(ch) & 63)::BIGINT] END)) AS bytes FROM body),
sums AS (
  SELECT codes.* EXCLUDE (body, bytes), xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM codes, crc_table)
"""

OP6 = f"""
WITH body AS (SELECT doc_id, coalesce('s' || source, 'n') AS src, octet_length(encode(coalesce(text, '')))::BIGINT + 8 AS size, coalesce(text, '') AS body FROM documents),
{CRC},
h AS (SELECT *, ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null') || ':' || text_crc32), 1, 15))::BIGINT AS hash FROM sums),
r AS (
  SELECT *, (row_number() OVER (PARTITION BY src ORDER BY hash, doc_id, size) - 1 + ('0x' || substr(md5('0:' || src), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE)
    / count(*) OVER (PARTITION BY src)::DOUBLE AS place FROM h),
o AS (SELECT *, row_number() OVER (ORDER BY place, src, hash, doc_id, size) - 1 AS pos, count(*) OVER () AS n FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, (pos * 24 // n)::INT AS shard, (pos - ((pos * 24 // n) * n + 23) // 24)::BIGINT AS slot, NULL::INT AS grown_shard FROM o
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP7 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 85 * (na + nb - c) UNION ALL SELECT b, a FROM pairs WHERE 100 * c >= 85 * (na + nb - c)),
reach AS (SELECT doc_id, doc_id AS r FROM s UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r),
least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN least USING (doc_id)
"""

OP11 = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
x AS (SELECT r, s, array_to_string(w[s + 1:s + 35], ' ') AS win FROM (SELECT r, w, unnest(range(len(w) - 34)) AS s FROM w WHERE len(w) >= 35)),
again AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY win) AS c FROM x) WHERE c > 1),
gone AS (SELECT r, list(DISTINCT p) AS g FROM (SELECT r, unnest(range(s, s + 35)) AS p FROM again) GROUP BY r),
k AS (SELECT doc_id, w, coalesce(len(g), 0) AS n, CASE WHEN g IS NULL THEN w ELSE list_transform(list_filter(range(len(w)), lambda i: NOT list_contains(g, i)), lambda i: w[i + 1]) END AS kept
  FROM w LEFT JOIN gone USING (r))
SELECT doc_id, len(w)::BIGINT AS n_words, n::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""

OP12 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
dw AS (SELECT r, unnest(w) AS body FROM d),
tw AS (SELECT unnest(list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS body FROM benchmark),
body AS (SELECT body, body AS word FROM (SELECT body FROM dw UNION SELECT body FROM tw)),
{CRC},
b AS (SELECT word, text_crc32 % 10000 AS b FROM sums),
s AS (SELECT b, count(*) AS s FROM dw JOIN b ON body = word GROUP BY b),
t AS (SELECT b, count(*) AS t FROM tw JOIN b ON body = word GROUP BY b),
n AS (SELECT (SELECT count(*) FROM dw)::DOUBLE AS s_all, (SELECT count(*) FROM tw)::DOUBLE AS t_all),
g AS (
  SELECT s.b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM s LEFT JOIN t ON s.b = t.b, n),
e AS (SELECT r, sum(gain)::BIGINT AS weight FROM dw JOIN b ON body = word JOIN g USING (b) GROUP BY r),
h AS (
  SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT::DOUBLE AS h
  FROM d LEFT JOIN e USING (r)),
c AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id, n_features) AS pos, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND pos <= 10 * n // 100 THEN pos END AS rank FROM o
"""

OP13 = """
WITH v AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, list_dot_product(a.v, c.v)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

ORACLE: dict[str, str] = {"op2_warc": OP2, "op5_pivots": OP5, "op6_interleave": OP6, "op7_chosen_path": OP7, "op11_block_anchors": OP11, "op12_importance": OP12, "op13_packed_negatives": OP13}
