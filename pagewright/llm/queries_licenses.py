"""Query op6: licence places and labels of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm.common import table
from pagewright.llm.licenses import scan_licenses


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text")).drop("spans")


QUERIES = {"op6_license_scan": op6_license_scan}
ORACLES: dict[str, str] = {}
