from __future__ import annotations

from . import importance
from .common import read
from .registry import register

# crc32 over the bytes of each different word, with the table of its 256 steps made by shifts
SQL = r"""
WITH RECURSIVE steps(i, k, v) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END FROM steps WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(v ORDER BY i) AS tab FROM steps WHERE k = 8),
doc_words AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM documents),
aim_words AS (
  SELECT unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')) AS word
  FROM benchmark),
each AS MATERIALIZED (SELECT doc_id, unnest(words) AS word FROM doc_words),
distinct_words AS (SELECT word FROM each UNION SELECT word FROM aim_words),
slot AS MATERIALIZED (
  SELECT word, xor(list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(0, (length(hex(encode(word))) // 2)::BIGINT), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)),
           lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS s
  FROM distinct_words, crc_table),
every AS (SELECT s, count(*) AS n FROM each JOIN slot USING (word) GROUP BY s),
aim AS (SELECT s, count(*) AS n FROM aim_words JOIN slot USING (word) GROUP BY s),
sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM every)::DOUBLE AS s_all, (SELECT coalesce(sum(n), 0) FROM aim)::DOUBLE AS t_all),
gain AS (
  SELECT e.s, floor(1000 * ln((coalesce(a.n, 0) + 1)::DOUBLE * (s_all + 10000) / ((e.n + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS g
  FROM every e LEFT JOIN aim a ON a.s = e.s CROSS JOIN sums),
weights AS (SELECT doc_id, sum(g)::BIGINT AS weight FROM each JOIN slot USING (word) JOIN gain USING (s) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, len(d.words)::BIGINT AS n_features, coalesce(w.weight, 0)::BIGINT AS weight,
         (coalesce(w.weight, 0) + floor(-1000.0 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM doc_words d LEFT JOIN weights w ON w.doc_id = d.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END::BIGINT AS rank
FROM ranked
"""


@register("op13_importance_resampling", SQL)
def op13_importance_resampling(spark, sf_dir):
    """Weight, score and rank of every document, drawn towards the benchmark texts."""
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
