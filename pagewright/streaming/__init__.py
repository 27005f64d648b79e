"""Structured Streaming ingest: pages that arrive are repaired once (an extension of the batch engine)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright.operators.repair import normalise_lists, reflow

PAGES = "doc_id string, page_num int, text string"


def read_page_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Page texts as JSON lines from files that arrive in a folder."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger).json(path)


def clean_pages(pages: DataFrame) -> DataFrame:
    """Paragraph and list repair of each page; needs no state, so batches and streams share it."""
    return pages.withColumn("markdown", normalise_lists(reflow(F.col("text"))))


def write_page_stream(pages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append cleaned pages to Parquet, each once, until what is there now is done."""
    return clean_pages(pages).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()


def latest_per_key(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """The newest entry of each (doc_id, page_num) of a state stream (ts, doc_id, page_num, entry), within a watermark."""
    return events.withWatermark("ts", watermark).groupBy("doc_id", "page_num").agg(F.max_by("entry", "ts").alias("entry"), F.max("ts").alias("ts"))
