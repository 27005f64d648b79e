"""Query op10: the main text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm.common import table
from pagewright.llm.html import extract_main_text


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


QUERIES = {"op10_html_text": op10_html_text}
ORACLES: dict[str, str] = {}
