from __future__ import annotations

from . import mixing
from .common import read
from .registry import register

SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS hash
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
         (row_number() OVER (ORDER BY source IS NULL, source::VARCHAR::BLOB) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
fill(step, source, source_size, cap, weight, capped) AS (
  SELECT 0, source, source_size, cap, weight, FALSE FROM per
  UNION ALL
  SELECT step + 1, source, source_size, cap, weight,
         capped OR cap <= ((SELECT sum(source_size) FROM per) - coalesce(sum(cap) FILTER (capped) OVER (), 0))::DOUBLE * weight / (sum(weight) FILTER (NOT capped) OVER ())
  FROM fill WHERE step < 60),
last AS (SELECT * FROM fill WHERE step = 60),
goal AS (
  SELECT source, source_size,
         CASE WHEN capped THEN cap::DOUBLE ELSE ((SELECT sum(source_size) FROM per) - coalesce(sum(cap) FILTER (capped) OVER (), 0))::DOUBLE * weight / (sum(weight) FILTER (NOT capped) OVER ()) END AS target
  FROM last),
plan AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies,
         round(target - (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END) * source_size)::BIGINT AS budget
  FROM goal),
hashes AS (SELECT source, hash, sum(size)::BIGINT AS words FROM sized GROUP BY ALL),
runs AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY hash ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM hashes),
edge AS (
  SELECT p.source, arg_min(struct_pack(hash := r.hash, words := r.words, upto := r.upto), r.hash) AS e
  FROM plan p JOIN runs r ON r.source IS NOT DISTINCT FROM p.source WHERE r.upto > p.budget GROUP BY p.source),
rule AS (
  SELECT p.*, CASE WHEN e.e IS NULL THEN 9223372036854775807
                   WHEN (p.budget - (e.e.upto - e.e.words)) * 2 >= e.e.words THEN e.e.hash + 1 ELSE e.e.hash END AS below
  FROM plan p LEFT JOIN edge e ON e.source IS NOT DISTINCT FROM p.source)
SELECT s.doc_id, s.source, s.size, r.source_size, r.target, s.size * (r.copies + (s.hash < r.below)::BIGINT) AS taken
FROM sized s JOIN rule r ON r.source IS NOT DISTINCT FROM s.source
"""


@register("op7_mix_sources", SQL)
def op7_mix_sources(spark, sf_dir):
    """Hash-threshold mix of all documents: doc_id, source, size, source_size, target, taken."""
    return mixing.mix(read(spark, sf_dir, "documents"))
