"""Query op8: every page, written to WARC archives and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm.common import table
from pagewright.llm.warc import archive_and_read


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archive_and_read(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH hashed AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), spelled AS (
  SELECT page_id, payload_bytes, h,
    list_aggregate(list_transform(range(0, 8), lambda g: list_aggregate(list_transform(range(0, 4), lambda c:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST((CAST(('0x' || substr(h, CAST(g * 5 + 1 AS INT), 5)) AS BIGINT) >> CAST(15 - 5 * c AS BIGINT)) & 31 AS INT) + 1, 1)),
      'string_agg', '')), 'string_agg', '') AS payload_digest
  FROM hashed
), firsts AS (
  SELECT h, min(page_id) AS first_id FROM hashed GROUP BY h
)
SELECT s.page_id, s.payload_bytes, s.payload_digest,
  CASE WHEN s.page_id = f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN s.page_id = f.first_id THEN NULL ELSE f.first_id END AS refers_to
FROM spelled s JOIN firsts f ON s.h = f.h
"""

QUERIES = {"op8_warc": op8_warc}
ORACLES = {"op8_warc": ORACLE}
