"""Query op4: every page's URL, judged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm.common import table
from pagewright.llm.urls import judge_urls


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages", "page_id", "url"))


QUERIES = {"op4_url_filter": op4_url_filter}
ORACLES: dict[str, str] = {}
