"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = f"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, {_WORDS.format(text=f"coalesce({_LOWER}, '')")} AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM tokens
), items AS (SELECT doc_id, unnest(s) AS item FROM sets),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM items x JOIN items y ON x.item = y.item AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 100 * n >= 80 * (len(p.s) + len(q.s) - n)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.other
), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)
"""

OP8 = f"""
WITH tokens AS (
  SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents
), windows AS (
  SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM tokens)
), late AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY t ORDER BY doc_id, p) AS n FROM windows) WHERE n > 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM late),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM tokens),
kept AS (
  SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY words.p) AS t
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p WHERE gone.p IS NULL GROUP BY words.doc_id
)
SELECT tokens.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM tokens LEFT JOIN kept ON kept.doc_id = tokens.doc_id
"""


OP11 = """
WITH own AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM own a JOIN own b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM scores WHERE same) WHERE n <= 5
), found AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
  FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 10
"""

# The CRC-32 of a word goes byte by byte through a table that the polynomial gives.
OP13 = f"""
WITH RECURSIVE steps AS (
  SELECT i AS byte, i AS c, 0 AS n FROM range(256) t(i)
  UNION ALL SELECT byte, CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, n + 1 FROM steps WHERE n < 8
), step AS (SELECT list(c ORDER BY byte) AS step FROM steps WHERE n = 8),
docs AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
wanted AS (SELECT unnest(regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
words AS (SELECT doc_id, unnest(w) AS word FROM docs),
hashed AS (
  SELECT word, xor(4294967295, list_reduce(
    list_transform(range(1, 1 + 2 * octet_length(encode(word)), 2), lambda i: ('0x' || substr(hex(encode(word)), i, 2))::BIGINT),
    lambda c, b: xor(c >> 8, step[CAST(xor(c, b) & 255 AS INTEGER) + 1]), 4294967295::BIGINT)) % 10000 AS bucket
  FROM (SELECT word FROM words UNION SELECT word FROM wanted), step
), s AS (SELECT bucket, count(*) AS n FROM words JOIN hashed USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM wanted JOIN hashed USING (word) GROUP BY 1),
totals AS (SELECT (SELECT count(*) FROM words)::DOUBLE AS s, (SELECT count(*) FROM wanted)::DOUBLE AS t),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (totals.s + 10000) / ((s.n + 1)::DOUBLE * (totals.t + 10000)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), totals
), sums AS (
  SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS g FROM words JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY 1
), scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (g - (g % n + n) % n) // n END AS weight,
    CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise
  FROM docs LEFT JOIN sums USING (doc_id)
), ranked AS (
  SELECT doc_id, n_features >= 20 AS fit, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS r,
    count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored
)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN fit AND r <= 10 * n // 100 THEN r END AS rank
FROM scored JOIN ranked USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_minhash_near_duplicates": OP5, "op8_suffix_tree_dedup": OP8, "op11_hard_negatives": OP11, "op13_target_resampling": OP13}
