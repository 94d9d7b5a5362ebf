"""DuckDB SQL of the operators that SQL can say."""

# base32 of 20 bytes: 32 digits of 5 bits, each read from two hexadecimal digits
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex,
             min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
           ((('0x' || substr(hex, 1 + (i * 5) // 4, 2) || CASE WHEN (i * 5) // 4 = 39 THEN '0' ELSE '' END)::BIGINT)
            >> (8 - 5 - ((i * 5) % 4))) & 31)::INTEGER, 1) FOR i IN range(32)],
           'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d
"""

DECONTAMINATION = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n,
         array_to_string(w[b:b + least(13, len(w)) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS b
        FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
runs AS (
  SELECT doc_id, n, b, array_to_string(w[b:b + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS b
        FROM words, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, b, r.n, item_id FROM runs r JOIN windows USING (n, words)),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit
            FROM (SELECT DISTINCT doc_id, unnest(range(b, b + n)) AS place FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text <> '')),
units AS (
  SELECT *, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w,
         sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS place
  FROM lines),
repeats AS (
  SELECT *, row_number() OVER (PARTITION BY array_to_string(w, ' ') ORDER BY doc_id, i) > 1 AS again
  FROM units WHERE len(w) > 0),
runs AS (
  SELECT *, sum((NOT again)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM repeats),
taken AS (
  SELECT doc_id, i, again AND sum(CASE WHEN again THEN len(w) ELSE 0 END)
                              OVER (PARTITION BY doc_id, run) >= 25 AS gone FROM runs),
ranked AS (
  SELECT units.*, coalesce(gone, false) AS gone FROM units LEFT JOIN taken USING (doc_id, i)),
made AS (
  SELECT doc_id, count(*) AS n_units, count(*) FILTER (gone) AS n_removed,
         string_agg(place::BIGINT || ':' || (place + length(line))::BIGINT, ',' ORDER BY i)
             FILTER (gone) AS removed,
         string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS kept
  FROM ranked GROUP BY doc_id)
SELECT doc_id, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(removed, '') AS removed, coalesce(kept, '') AS text
FROM documents LEFT JOIN made USING (doc_id)
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
runs AS (
  SELECT lang, size, w[b:b + size - 1] AS names
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS b
        FROM words, (VALUES (1), (2), (3)) AS sizes(size) WHERE len(w) >= size)),
counts AS (SELECT lang, size, names, count(*) AS f FROM runs GROUP BY ALL),
candidates AS (SELECT lang, size, names, f AS a FROM counts WHERE size > 1 AND f >= 10),
cuts AS (
  SELECT c.*, k, c.names[1:k] AS lhs, c.names[k + 1:] AS rhs
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c),
scored AS (
  SELECT c.lang, c.size, c.names, a, k, x.f AS l, y.f AS r,
         (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.names = c.lhs
       JOIN counts y ON y.lang = c.lang AND y.names = c.rhs),
lowest AS (
  SELECT * FROM scored
  QUALIFY row_number() OVER (PARTITION BY lang, names ORDER BY score, k) = 1),
longer AS (
  SELECT lang, part, max(a) AS a
  FROM (SELECT lang, a, unnest([names[1:2], names[2:3]]) AS part FROM candidates WHERE size = 3)
  GROUP BY lang, part),
kept AS (
  SELECT s.lang, array_to_string(s.names, ' ') AS phrase, s.a, s.l, s.r, s.score
  FROM lowest s LEFT JOIN longer b ON b.lang = s.lang AND b.part = s.names
  WHERE b.a IS NULL OR 100 * b.a < 50 * s.a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
  FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n,
       score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
