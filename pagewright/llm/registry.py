"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import queries_ann, queries_chat, queries_decontamination, queries_html, queries_licenses, queries_minhash, queries_packing, queries_quality, queries_urls, queries_warc

_MODULES = (
    queries_packing,
    queries_ann,
    queries_quality,
    queries_urls,
    queries_chat,
    queries_licenses,
    queries_minhash,
    queries_warc,
    queries_decontamination,
    queries_html,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
