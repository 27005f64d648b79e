"""Query op9: documents that hold benchmark items, also with other numbers or names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import table
from pagewright.llm.decontamination import find_leaks


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contaminated document; ``items`` lists its benchmark items as text."""
    leaks = find_leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    items = F.array_join(F.transform(F.array_sort(F.collect_set("item_id")), lambda i: i.cast("string")), ",")
    return leaks.groupBy("doc_id").agg(items.alias("items"), F.max("coverage").alias("coverage"), F.sum("n_windows").alias("n_windows"))


QUERIES = {"op9_decontamination": op9_decontamination}
ORACLES: dict[str, str] = {}
