"""DuckDB SQL for the training-data queries that SQL can express, on its own terms."""

OP4 = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
     g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)
"""

# The level of the water-filling rises from round to round; 64 rounds are more
# than the number of sources, which bounds them.
OP2 = """
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5(doc_id::VARCHAR || '-42') AS h FROM documents),
s AS MATERIALIZED (
  SELECT source, source_size, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
lv(i, level) AS (
  SELECT 0, sum(source_size)::DOUBLE / sum(weight) FROM s
  UNION ALL
  SELECT i + 1, (SELECT ((SELECT sum(source_size) FROM s)
                         - coalesce(sum(CASE WHEN weight * level > 3 * source_size THEN 3 * source_size END), 0))::DOUBLE
                        / sum(CASE WHEN weight * level > 3 * source_size THEN 0 ELSE weight END) FROM s)
  FROM lv WHERE i < 64),
t AS (SELECT s.*, least(weight * (SELECT level FROM lv WHERE i = 64), (3 * source_size)::DOUBLE) AS target FROM s),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
r AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.whole, e.target - e.whole * e.source_size AS want,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (whole + CASE WHEN upto - size / 2.0 < want THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""

OP6 = """
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
h AS (SELECT *, '.' || host AS dotted, CASE WHEN path = '' THEN '/' ELSE path END AS p1 FROM p),
v AS (SELECT *,
  CASE WHEN ends_with(dotted, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN ends_with(dotted, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN ends_with(dotted, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN ends_with(dotted, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
  starts_with(p1, '/') AND regexp_matches(dotted, '\\.(adult-x|casino-win)\\.example\\.(com|net|org)$') AS listed FROM h)
SELECT page_id, host, path, rule,
       CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block'
                 ELSE CASE WHEN listed THEN 'block' ELSE 'allow' END END AS verdict, listed FROM v
"""

# CRC-32 by its table of bytes; near words by what is left without one code point.
OP11 = """
WITH RECURSIVE step(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS of FROM step WHERE k = 8),
occ AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)
  GROUP BY ALL),
bytes AS (SELECT doc_id, run, n, hex(encode(doc_id::VARCHAR || ':' || run)) AS x FROM occ),
h AS MATERIALIZED (
  SELECT run, n, xor(list_reduce(list_transform(range(length(x) // 2), lambda j: ('0x' || substr(x, 2 * j + 1, 2))::BIGINT),
                    lambda c, b: xor(c >> 8, crc.of[xor(c & 255, b) + 1]), 4294967295), 4294967295) AS h FROM bytes CROSS JOIN crc),
changed AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3)
,cut AS (SELECT word, n, unnest(range(length(word) + 1)) AS i FROM w),
less AS (SELECT word, n, i, CASE WHEN i = 0 THEN word ELSE substr(word, 1, i - 1) || substr(word, i + 1) END AS less FROM cut),
pair AS MATERIALIZED (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM less a JOIN less b USING (less)
                      WHERE a.word <> b.word AND (a.i = b.i OR (a.i = 0) <> (b.i = 0))),
near AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, encode(other))) AS other, max(other_n) AS other_n FROM pair GROUP BY word),
form AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form,
                             CASE WHEN other_n >= 2 * n THEN other_n END AS form_n FROM w LEFT JOIN near USING (word)),
chain(word, now) AS (SELECT word, word FROM w UNION ALL SELECT chain.word, form.form FROM chain JOIN form ON chain.now = form.word WHERE form.form IS NOT NULL)
SELECT f.word, form, chain.now AS root, n, n_near, form_n FROM form f JOIN chain USING (word) JOIN (SELECT word FROM form WHERE form IS NULL) last ON last.word = chain.now
"""

OP13 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""

ORACLE = {"op2_source_mix": OP2, "op4_exact_dedup": OP4, "op6_url_filter": OP6, "op11_spelling": OP11, "op13_topk": OP13}
