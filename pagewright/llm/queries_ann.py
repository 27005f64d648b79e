"""Query op2: the five nearest vectors of every fiftieth vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.ann import nearest_neighbours
from pagewright.llm.common import table


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0, k=5)


QUERIES = {"op2_neighbours": op2_neighbours}
ORACLES: dict[str, str] = {}
