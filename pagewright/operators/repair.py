"""Repair of recognised page text: line folds as Arrow UDFs, and the fixed order of a page's assembly.

The order is part of the meaning: headings first, while each is still alone on its line;
then paragraphs, lists, tables, and links if asked for.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagewright.functions import lines as L
from pagewright.functions import text as T
from pagewright.operators import facts as facts_of
from pagewright.operators import headings as headings_of
from pagewright.operators import pages as pages_of


def _map(function: Callable[[str], str]):
    @F.arrow_udf(StringType())
    def mapped(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else function(t) for t in texts.to_pylist()], pa.string())

    return mapped


reflow = _map(L.reflow)
normalise_lists = _map(L.normalise_lists)
split_index_runs = _map(lambda t: "\n".join(x for line in t.split("\n") for x in L.split_run(line)))


@F.arrow_udf(StringType())
def fix_headings(texts: pa.Array, headings: pa.Array, has_scale: pa.Array) -> pa.Array:
    rows = zip(texts.to_pylist(), headings.to_pylist(), has_scale.to_pylist())
    return pa.array([None if t is None else L.fix_headings(t, [(h["norm"], h["level"]) for h in hs or []], bool(s)) for t, hs, s in rows], pa.string())


@F.arrow_udf(StringType())
def splice_tables(texts: pa.Array, tables: pa.Array) -> pa.Array:
    return pa.array([None if t is None else L.splice_tables(t, md or []) for t, md in zip(texts.to_pylist(), tables.to_pylist())], pa.string())


@F.arrow_udf(StringType())
def splice_links(texts: pa.Array, links: pa.Array) -> pa.Array:
    rows = zip(texts.to_pylist(), links.to_pylist())
    return pa.array([None if t is None else L.splice_links(t, [(x["anchor"], x["uri"]) for x in ls or []]) for t, ls in rows], pa.string())


@F.arrow_udf(StringType())
def _repair(texts: pa.Array, headings: pa.Array, has_scale: pa.Array, tables: pa.Array, links: pa.Array) -> pa.Array:
    """All folds in one crossing into Python."""
    out = []
    for text, hs, scale, md, ls in zip(*(c.to_pylist() for c in (texts, headings, has_scale, tables, links))):
        if text is None:
            out.append(None)
            continue
        text = L.fix_headings(text, [(h["norm"], h["level"]) for h in hs or []], bool(scale))
        text = L.splice_tables(L.normalise_lists(L.reflow(text)), md or [])
        out.append(L.splice_links(text, [(x["anchor"], x["uri"]) for x in ls or []]))
    return pa.array(out, pa.string())


def splice_tables_by_position(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """The k-th table block of each page replaced by its k-th table, by joins and windows only.

    ``pages``: doc_id, page_num, text. ``tables``: doc_id, page_num, tables. Gives the same text as the
    fold; of use where tables are many and pages long.
    """
    split = pages.select("doc_id", "page_num", F.split("text", "\n").alias("lines"))
    joined = split.join(tables, ["doc_id", "page_num"], "left").withColumn("tables", F.coalesce("tables", F.array().cast("array<string>")))
    marked = joined.withColumn("piped", F.transform("lines", T.is_table_row))
    # The number of blocks up to each line, from the places where a run of piped lines starts.
    starts = F.transform("piped", lambda p, i: F.when(p & ((i == 0) | ~F.get("piped", i - 1)), i + 1).otherwise(0))
    marked = marked.withColumn("starts", F.filter(starts, lambda x: x > 0))
    block = lambda i: F.size(F.filter("starts", lambda s: s <= i + 1))
    line = lambda x, i: (
        F.when(~F.get("piped", i) | (block(i) > F.size("tables")), x)
        .when(F.array_contains("starts", i + 1), F.get("tables", block(i) - 1))
        .otherwise(F.lit(None).cast("string"))
    )
    body = F.array_join(F.filter(F.transform("lines", line), lambda x: x.isNotNull()), "\n")
    extra = F.slice("tables", F.size("starts") + 1, F.greatest(F.size("tables") - F.size("starts"), F.lit(0)))
    return marked.select("doc_id", "page_num", F.array_join(F.concat(F.array(body), extra), "\n\n").alias("text"))


def repair_pages(
    replies: DataFrame,
    spans: DataFrame,
    tables: DataFrame,
    links: DataFrame,
    annots: DataFrame,
    image_rects: DataFrame,
    include_links: bool = False,
    include_comments: bool = False,
) -> DataFrame:
    """doc_id, page_num, markdown, crops, from_source for each recognised page.

    ``replies``: doc_id, page_num, page_count, text, boxes, is_blank. Facts are reduced to
    one row per page before they meet the text; a blank page gets its marker without repair.
    """
    key = ["doc_id", "page_num"]
    scaled = headings_of.heading_scale(spans).select("doc_id").distinct().withColumn("has_scale", F.lit(True))
    flags = replies.select(*key).distinct().join(scaled, "doc_id")  # by keys alone: texts are only ever dealt by page
    rows = replies.join(headings_of.page_headings(spans), key, "left").join(flags, key, "left")
    rows = rows.join(facts_of.page_tables(tables), key, "left").join(facts_of.page_image_rects(image_rects), key, "left")
    no_links = F.lit(None).cast("array<struct<anchor:string,uri:string>>")
    rows = rows.join(facts_of.page_links(links), key, "left") if include_links else rows.withColumn("links", no_links)
    rows = rows.join(facts_of.page_comments(annots), key, "left") if include_comments else rows.withColumn("comments", F.lit(None).cast("string"))
    rows = pages_of.diagrams(rows)
    repaired = _repair("text", "headings", F.coalesce("has_scale", F.lit(False)), "tables", "links")
    rows = rows.withColumn("repaired", F.when(~F.col("is_blank"), repaired))
    none = F.array().cast("array<string>")
    whole = F.when(F.col("is_blank"), pages_of.page_markdown(F.lit(pages_of.BLANK_MARKER), none, F.col("comments"))).otherwise(
        pages_of.page_markdown(F.col("repaired"), F.col("references"), F.col("comments"))
    )
    return rows.select(*key, whole.alias("markdown"), "crops", "from_source")


def register(spark: SparkSession) -> None:
    """Make the folds callable from SQL."""
    for name, function in (
        ("md_reflow", reflow),
        ("md_normalise_lists", normalise_lists),
        ("md_split_index_runs", split_index_runs),
        ("md_fix_headings", fix_headings),
        ("md_splice_tables", splice_tables),
        ("md_splice_links", splice_links),
    ):
        spark.udf.register(name, function)


def as_column(name: str, *arguments: Column) -> Column:
    """A registered fold as a column."""
    return F.call_function(name, *arguments)
