"""Query op1: all documents, packed into sequences of at most 1024 tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagewright.llm.common import table
from pagewright.llm.packing import pack_documents


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op1_packing": op1_packing}
ORACLES: dict[str, str] = {}
