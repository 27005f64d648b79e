"""Page state, page choice and assembly of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T

FLAGS = ("image_done", "image_failed", "ocr_done", "ocr_failed")
BLANK_MARKER = "<!-- blank page -->"


def latest_state(log: DataFrame) -> DataFrame:
    """The state log's last entry of each page; ``version`` orders the entries. A null entry is a reset."""
    values = F.struct(*FLAGS, "diagram_count", "ocr_response")
    last = log.groupBy("doc_id", "page_num").agg(F.max_by(values, "version").alias("s"))
    flags = [F.coalesce(f"s.{f}", F.lit(False)).alias(f) for f in FLAGS]
    return last.select("doc_id", "page_num", *flags, F.coalesce("s.diagram_count", F.lit(0)).alias("diagram_count"), F.col("s.ocr_response").alias("ocr_response"))


def pending_render(state: DataFrame) -> DataFrame:
    return state.filter("NOT image_done AND NOT image_failed")


def pending_recognition(state: DataFrame) -> DataFrame:
    return state.filter("image_done AND NOT ocr_done AND NOT ocr_failed")


def with_state(pages: DataFrame, state: DataFrame) -> DataFrame:
    """Pages with their state; a page without one has done nothing."""
    joined = pages.join(state, ["doc_id", "page_num"], "left")
    return joined.fillna(False, list(FLAGS)).fillna(0, ["diagram_count"])


def run_summary(state: DataFrame, *keys: str) -> DataFrame:
    """Counts of the four flags, and of pages."""
    return state.groupBy(*keys).agg(F.count(F.lit(1)).alias("pages"), *(F.count_if(f).alias(f) for f in FLAGS))


def run_status(state: DataFrame, documents: DataFrame) -> DataFrame:
    """complete, partial or not_started for each document (doc_id, combined_done)."""
    touched = state.groupBy("doc_id").agg(F.bool_or(F.greatest(*FLAGS)).alias("touched"))
    status = F.when(F.col("combined_done"), "complete").when(F.col("touched"), "partial").otherwise("not_started")
    return documents.join(touched, "doc_id", "left").select("doc_id", status.alias("status"))


def failure_gates(state: DataFrame, documents: DataFrame) -> DataFrame:
    """Whether all pages failed to render, and whether all rendered ones failed recognition.

    A document without pages counts as all failed, as nothing of it succeeded.
    """
    rendered = F.col("image_done")
    counts = state.groupBy("doc_id").agg(
        F.count_if(~F.col("image_failed")).alias("unfailed"), F.count_if(rendered & ~F.col("ocr_failed")).alias("recognised"), F.count_if(rendered).alias("rendered")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return documents.join(counts, "doc_id", "left").select(
        "doc_id",
        (zero("unfailed") == 0).alias("all_renders_failed"),
        ((zero("rendered") > 0) & (zero("recognised") == 0)).alias("all_recognition_failed"),
    )


def choose_pages(pages: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requested pages that exist, and those that don't."""
    on = [c for c in ("doc_id", "page_num") if c in wanted.columns]
    return pages.join(wanted, on, "left_semi"), wanted.join(pages, on, "left_anti")


def diagrams(page: DataFrame) -> DataFrame:
    """Boxes to crop and references to add: image placements if the model saw any diagram, else its own boxes.

    Input: doc_id, page_num, page_count, boxes (of x, y, width, height), rects (of x0, y0, x1, y1).
    """
    boxes = F.coalesce("boxes", F.array().cast("array<struct<x:double,y:double,width:double,height:double>>"))
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("long").cast("double")
    model = F.transform(
        boxes,
        lambda b: F.struct(
            whole(b["x"]).alias("x0"),
            whole(b["y"]).alias("y0"),
            (whole(b["x"]) + T.trim_extent(b["width"])).alias("x1"),
            (whole(b["y"]) + T.trim_extent(b["height"])).alias("y1"),
        ),
    )
    crops = F.when(F.size(boxes) == 0, F.slice(model, 1, 0)).when(F.coalesce(F.size("rects"), F.lit(0)) > 0, F.col("rects")).otherwise(model)
    stem = T.page_stem(F.col("page_num"), F.col("page_count"))
    chosen = page.select("*", crops.alias("crops"), (F.coalesce(F.size("rects"), F.lit(0)) > 0).alias("from_source"))
    return chosen.withColumn("references", F.transform("crops", lambda c, i: T.diagram_reference(stem, i + 1)))


def page_markdown(text: Column, references: Column, comments: Column) -> Column:
    """A page's file: text, then references and comments, each behind an empty line."""
    some = F.when(F.size(references) > 0, F.concat(F.array(F.lit("")), references)).otherwise(F.array().cast("array<string>"))
    said = F.when(F.coalesce(comments, F.lit("")) != "", F.array(F.lit(""), comments)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(text), some, said), "\n")


def combine(pages: DataFrame, folder: Column) -> DataFrame:
    """One Markdown text per document, of its recognised pages in order.

    Input: doc_id, page_num, ocr_done, markdown (null: no file, empty). ``folder`` names the
    document's folder, to which diagram references are rebased.
    """
    section = F.concat(F.lit("--- PAGE "), F.col("page_num").cast("string"), F.lit(" ---\n"), T.rebase_references(F.coalesce("markdown", F.lit("")), folder))
    rows = pages.filter("ocr_done").select("doc_id", "page_num", section.alias("section"))
    grouped = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_num", "section"))).alias("s"))
    return grouped.select("doc_id", F.array_join(F.transform("s", lambda s: s["section"]), "\n\n").alias("markdown"))


def next_archive(names: DataFrame) -> DataFrame:
    """One more than the largest number of folders named v<number>."""
    number = F.when(F.col("name").rlike("^v[0-9]+$"), F.expr("try_cast(substring(name, 2) AS bigint)"))
    return names.agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("version"))
