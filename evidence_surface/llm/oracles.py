"""DuckDB SQL of the queries that SQL can express over whole tables."""

ORACLES = {
    "op3_line_dedup": r"""
WITH p AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), l AS (
  SELECT doc_id, i, parts[i] || CASE WHEN i < len(parts) THEN chr(10) ELSE '' END AS line
  FROM p, unnest(range(1, len(parts) + 1)) t(i)
), m AS (  -- sentences of a line, joined until they have 8 words; chr(1) stands between
  SELECT doc_id, i, string_split(list_reduce(
    string_split(regexp_replace(line, '([.!?][\x20\x09\x0B-\x0D]+)', '\1' || chr(1), 'g'), chr(1)),
    lambda a, x: a || CASE WHEN len(regexp_extract_all(split_part(a, chr(1), -1), '[^\x20\x09-\x0D]+')) >= 8
      THEN chr(1) ELSE '' END || x), chr(1)) AS s FROM l
), n AS (  -- fewer words at the line's end belong to the unit before
  SELECT doc_id, i, CASE WHEN len(s) > 1 AND len(regexp_extract_all(s[-1], '[^\x20\x09-\x0D]+')) < 8
    THEN list_append(s[:-3], s[-2] || s[-1]) ELSE s END AS s FROM m
), o AS (
  SELECT doc_id, i, j, s[j] AS unit FROM n, unnest(range(1, len(s) + 1)) t(j)
), w AS (
  SELECT *, trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm,
    CAST(coalesce(sum(strlen(unit)) OVER (PARTITION BY doc_id ORDER BY i, j
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM o
), r AS (
  SELECT *, norm <> ''
    AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, start) > 1 AS gone FROM w
)
SELECT doc_id, count(*) FILTER (gone) AS n_spans,
  CAST(coalesce(sum(strlen(unit)) FILTER (gone), 0) AS BIGINT) AS n_removed,
  '[' || coalesce(string_agg('{"start":' || start || ',"stop":' || (start + strlen(unit)) || '}', ',' ORDER BY i, j)
    FILTER (gone), '') || ']' AS spans,
  sha256(coalesce(string_agg(unit, '' ORDER BY i, j) FILTER (NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id
""",
    "op5_warc": """
WITH t AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), g AS (
  SELECT h, max(page_id) AS first FROM t GROUP BY h
), b AS (  -- ten hexadecimal digits are eight of base 32
  SELECT h, list_transform(range(4), lambda i: CAST('0x' || substr(h, 1 + 10 * i, 10) AS BIGINT)) AS v FROM g
), d AS (
  SELECT h, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((v[1 + i // 8] >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest FROM b
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM t JOIN g USING (h) JOIN d USING (h)
""",
    "op9_suffix_dedup": """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), b AS (  -- a row per byte: its string of 50 bytes, if there are so many
  SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS byte, CASE WHEN i + 50 <= n THEN md5(substr(h, 2 * i + 1, 100)) END AS s
  FROM d, unnest(range(n)) t(i)
), m AS (
  SELECT s, min(doc_id) AS first FROM b WHERE s IS NOT NULL GROUP BY s HAVING min(doc_id) < max(doc_id)
), c AS (
  SELECT doc_id, i, byte, coalesce(max(CASE WHEN m.first < doc_id THEN 1 END) OVER (PARTITION BY doc_id ORDER BY i
    ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM b LEFT JOIN m USING (s)
), g AS (
  SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS begins FROM c
), r AS (
  SELECT doc_id, count(*) FILTER (gone = 1) AS n_removed, count(*) FILTER (begins) AS n_spans,
    string_agg(byte, '' ORDER BY i) FILTER (gone = 0) AS kept FROM g GROUP BY doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
""",
    "op7_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM t JOIN g USING (text_sha256)
""",
    "op12_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
  FROM documents
), o AS (
  SELECT doc, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), c AS (
  SELECT doc, lang, source, term, count(*) AS n FROM o GROUP BY ALL
), k AS (
  SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY ALL HAVING count(*) >= 3
), v AS (
  SELECT lang, count(term) AS v, coalesce(sum(n), 0) AS n FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY lang
), s AS (
  SELECT lang, source, term, CAST(sum(c.n) AS HUGEINT) AS n FROM c JOIN k USING (lang, term) GROUP BY ALL
), g AS (
  SELECT lang, source, coalesce(sum(n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN s USING (lang, source)
  GROUP BY ALL
), p AS (  -- every group and kept term
  SELECT g.lang, g.source, k.term, coalesce(s.n, 0) AS n, 1 + 1000000000 * (coalesce(s.n, 0) + 1) // (g.n + v.v) AS p,
    1 + 1000000000 * (k.n + 1) // (v.n + v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  JOIN v ON v.lang = a.lang WHERE v.v = 0
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
), w AS (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
    CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r
)
SELECT * FROM w WHERE part = 'pair' OR rank <= 200
""",
    "op13_exact_top_k": """
WITH e AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.r, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.r <> c.r WHERE q.vec_id % 50 = 0
), k AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM k WHERE rank <= 5
""",
}
