from __future__ import annotations

from . import infill
from .common import read
from .registry import register

SQL = """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS sha FROM documents),
numbered AS (
  SELECT doc_id, text, length(text)::BIGINT AS n, ('0x' || substr(sha, 1, 8))::BIGINT AS h1, ('0x' || substr(sha, 9, 8))::BIGINT AS h2,
         ('0x' || substr(sha, 17, 8))::BIGINT AS h3, ('0x' || substr(sha, 25, 8))::BIGINT AS h4
  FROM hashed),
formed AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                 WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbered),
cut AS (
  SELECT *, CASE WHEN form <> 'plain' THEN least(h1 % (n + 1), h2 % (n + 1)) END AS a,
         CASE WHEN form <> 'plain' THEN greatest(h1 % (n + 1), h2 % (n + 1)) END AS b
  FROM formed),
parts AS (
  SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM cut)
SELECT doc_id, n, form, a AS prefix_chars, b - a AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


@register("op12_fill_in_middle", SQL)
def op12_fill_in_middle(spark, sf_dir):
    """Every document's form, cuts, and checksums of its output and of the text restored from it."""
    return infill.digests(read(spark, sf_dir, "documents"))
