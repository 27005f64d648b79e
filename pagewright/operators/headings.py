"""Heading levels from font sizes: weighted modes per line and document, and the ranking above body size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.functions.lines import DEEPEST_LEVEL, HEADING_RATIO


def visible_spans(spans: DataFrame) -> DataFrame:
    """Spans with visible text; ``weight`` is the length of the trimmed text, ``place`` the reading position."""
    rows = spans.withColumn("weight", F.length(T.bare(F.col("text"))).cast("long")).filter("weight > 0")
    return rows.withColumn("place", F.struct("page_num", "block_no", "line_no", "span_no"))


def font_histogram(spans: DataFrame) -> DataFrame:
    """Characters per font size of each document, and where the size is seen first."""
    return visible_spans(spans).groupBy("doc_id", "size").agg(F.sum("weight").alias("chars"), F.min("place").alias("first_place"))


def body_size(spans: DataFrame) -> DataFrame:
    """The size of most characters; of equals the one seen first."""
    return font_histogram(spans).groupBy("doc_id").agg(_most_and_first().alias("body_size"))


def _most_and_first() -> Column:
    """The size with most characters, of equals the one seen first."""
    return F.max_by("size", F.struct("chars", *(-F.col(f"first_place.{c}") for c in ("page_num", "block_no", "line_no", "span_no"))))


def heading_scale(spans: DataFrame) -> DataFrame:
    """doc_id, size, level: sizes clearly above the body's, largest first, levels 1 to 6.

    Body size and ranking are windows over one partitioning of the histogram, so it is shuffled once.
    """
    document = W.partitionBy("doc_id")
    sizes = font_histogram(spans).withColumn("body_size", _most_and_first().over(document)).filter(F.col("size") >= F.lit(HEADING_RATIO) * F.col("body_size"))
    rank = F.dense_rank().over(document.orderBy(F.desc("size")))
    return sizes.select("doc_id", "size", F.least(rank, F.lit(DEEPEST_LEVEL)).alias("level"))


def dominant_sizes(spans: DataFrame) -> DataFrame:
    """Each text line's size and text: the size of most of its characters, of equals the first.

    A line's spans meet in one row by one shuffle; what follows are array functions.
    """
    weight = F.length(T.bare(F.col("text"))).cast("long")
    line = ["doc_id", "page_num", "block_no", "line_no"]
    rows = spans.select(*line, F.struct("span_no", "text", "size", weight.alias("weight")).alias("span"))
    grouped = rows.groupBy(*line).agg(F.array_sort(F.collect_list("span")).alias("s")).filter(F.exists("s", lambda x: x["weight"] > 0))
    visible = F.filter("s", lambda x: x["weight"] > 0)
    seen = F.array_distinct(F.transform(visible, lambda x: x["size"]))  # in order of appearance
    held = lambda size: F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + F.when(x["size"] == size, x["weight"]).otherwise(0))
    best = F.array_max(F.transform(seen, lambda size, i: F.struct(held(size).alias("w"), (-i).alias("first"), size.alias("size"))))
    return grouped.select(*line, best["size"].alias("size"), F.array_join(F.transform("s", lambda x: x["text"]), "").alias("text"))


def page_headings(spans: DataFrame) -> DataFrame:
    """Each page's headings in reading order, as (norm, level), and whether the document has a scale."""
    scale = heading_scale(spans)
    lines = dominant_sizes(spans).withColumn("norm", T.norm_heading(F.col("text"))).filter("norm <> ''")
    found = lines.join(scale, ["doc_id", "size"])
    grouped = found.groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list(F.struct("block_no", "line_no", "norm", "level"))).alias("h"))
    return grouped.select("doc_id", "page_num", F.transform("h", lambda h: F.struct(h["norm"].alias("norm"), h["level"].alias("level"))).alias("headings"))
