"""Corpus pipeline: quality, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
``run`` writes every stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagewright.llm.common import release, stored, table
from pagewright.llm.decontamination import remove_leaks
from pagewright.llm.minhash import remove_near_duplicates
from pagewright.llm.packing import pack_documents
from pagewright.llm.quality import accepted

#: Documents that score less are rejected.
QUALITY_THRESHOLD = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts, with all columns.

    Null, empty and very long texts are scored as a whole like any other; each of repeated rows, and each row
    without a doc_id, is judged by its own text; a score equal to the threshold is accepted; without labels of both
    classes, and for an empty table, nothing is rejected. Columns of any names pass through.
    """
    return accepted(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), QUALITY_THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, similarity 0.8 or more), with all columns.

    Rows without words all stay. Of a group the smallest doc_id stays, null ids come last, of one doc_id the text with the
    smallest hash, of equal rows any one. Very long texts are compared whole; an empty table gives none.
    """
    return remove_near_duplicates(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, re-parameterised ones included, with all columns.

    Null and empty texts hold none; very long texts are searched whole; each of repeated rows, and each row without a
    doc_id, is judged by its own text; an empty benchmark removes nothing.
    """
    return remove_leaks(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows that are left, packed into sequences.

    A null or empty text is the closing id alone; repeated rows are packed one by one, null ids pass through; very long
    texts are cut into windows; an empty table gives none; other columns are not read.
    """
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Models, sketches and token ids are beyond SQL; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(before)
    return docs
