"""Query op7: near-duplicate components of all documents over two-word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm.common import table
from pagewright.llm.minhash import near_duplicates


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), k=2)


ORACLE = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), shingled AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM worded
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id
), numbered AS (
  SELECT doc_id, hash(s) AS s FROM shingled
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM numbered x JOIN numbered y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached(origin, reach) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.origin, e.b FROM reached r JOIN both_ways e ON e.a = r.reach
)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id
JOIN (SELECT origin, min(reach) AS component_id FROM reached GROUP BY origin) r ON r.origin = d.doc_id
"""

QUERIES = {"op7_near_dedup": op7_near_dedup}
ORACLES = {"op7_near_dedup": ORACLE}
