"""Scans of page facts: what tables, links, annotations and images give to a page.

Schemas (all keyed by doc_id, page_num): ``spans`` block_no, line_no, span_no, text,
size; ``tables`` table_no, x0, y0, rows; ``links`` link_no, kind, uri, x0, y0, anchor; ``annots``
annot_no, type, title, content; ``image_rects`` rect_no, x0, y0, x1, y1. Reading order is by
coordinates rounded half to even, then by source order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T


def enumerate_pages(documents: DataFrame) -> DataFrame:
    """A row per page from 1 to page_count, with its file stem; a document without pages gives none."""
    rows = documents.filter(F.col("page_count") > 0)
    pages = rows.select("doc_id", "page_count", F.explode(F.sequence(F.lit(1), F.col("page_count").cast("int"))).alias("page_num"))
    return pages.withColumn("stem", T.page_stem(F.col("page_num"), F.col("page_count")))


def _ordered(keep: Column) -> Column:
    """The third and later fields of collected structs, in order of the first two."""
    return F.array_sort(F.collect_list(keep))


def _position(ordinal: str) -> list[Column]:
    return [F.rint("y0").alias("y"), F.rint("x0").alias("x"), F.col(ordinal).alias("o")]


def page_tables(tables: DataFrame) -> DataFrame:
    """Each page's tables as Markdown, in reading order; tables without rows are left out."""
    rows = tables.filter(F.size("rows") > 0)
    grouped = rows.groupBy("doc_id", "page_num").agg(_ordered(F.struct(*_position("table_no"), T.render_table(F.col("rows")).alias("md"))).alias("t"))
    return grouped.select("doc_id", "page_num", F.transform("t", lambda t: t["md"]).alias("tables"))


def usable_links(links: DataFrame) -> DataFrame:
    """Web links that have an address and a visible anchor."""
    anchor = T.collapse(F.col("anchor"))
    return links.filter((F.col("kind") == "uri") & (F.coalesce("uri", F.lit("")) != "") & (anchor != "") & F.col("x0").isNotNull() & F.col("y0").isNotNull()).withColumn("anchor", anchor)


def page_links(links: DataFrame) -> DataFrame:
    """Each page's (anchor, uri) pairs in reading order."""
    grouped = usable_links(links).groupBy("doc_id", "page_num").agg(_ordered(F.struct(*_position("link_no"), "anchor", "uri")).alias("l"))
    return grouped.select("doc_id", "page_num", F.transform("l", lambda x: F.struct(x["anchor"].alias("anchor"), x["uri"].alias("uri"))).alias("links"))


def page_comments(annots: DataFrame) -> DataFrame:
    """Each page's comments section: text-bearing annotations in source order."""
    content, author = T.collapse(F.col("content")), T.collapse(F.col("title"))
    line = F.concat(F.lit("- **"), F.when(author == "", "Unknown").otherwise(author), F.lit("** ("), F.col("type"), F.lit("): "), content)
    rows = annots.filter(F.col("type").isin(*T.COMMENT_TYPES) & (content != ""))
    grouped = rows.groupBy("doc_id", "page_num").agg(_ordered(F.struct("annot_no", line.alias("line"))).alias("a"))
    return grouped.select("doc_id", "page_num", F.concat(F.lit("## Comments\n\n"), F.array_join(F.transform("a", lambda a: a["line"]), "\n")).alias("comments"))


def page_image_rects(image_rects: DataFrame) -> DataFrame:
    """Each page's image placements in reading order."""
    grouped = image_rects.groupBy("doc_id", "page_num").agg(_ordered(F.struct(*_position("rect_no"), "x0", "y0", "x1", "y1")).alias("r"))
    box = lambda r: F.struct(*(r[c].alias(c) for c in ("x0", "y0", "x1", "y1")))
    return grouped.select("doc_id", "page_num", F.transform("r", box).alias("rects"))


def blank_pages(page_facts: DataFrame, white: float = 0.999) -> Column:
    """A page without text and drawings whose image is white; where the facts can't be read only the image counts."""
    bare = ~F.coalesce(F.col("has_text"), F.lit(False)) & ~F.coalesce(F.col("has_drawings"), F.lit(False))
    return bare & (F.coalesce("white_ratio", F.lit(0.0)) >= white)
