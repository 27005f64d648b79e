"""The document pipeline: facts, recognition, repair, combination; resumable by the state log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import facts as facts_of
from pagewright.operators import pages as pages_of
from pagewright.operators.repair import repair_pages
from pagewright.sources import pdf
from pagewright.sources.config import Config
from pagewright.sources.images import white_ratio
from pagewright.sources.recognition import Transport, http_transport, parse_replies, recognise
from pagewright.sources.state import StateStore


@dataclass(frozen=True)
class Options:
    dpi_scale: float = pdf.RENDER_SCALE
    include_comments: bool = False
    include_links: bool = False


class DocumentPipeline:
    """Runs over all documents of a facts table (schema ``sources.pdf.FACTS``).

    Everything is kept below ``folder``: state, images, raw replies, pages, combined
    Markdown. Each phase handles only what the state says is pending and appends its results, so an
    interrupted run goes on where it stopped.
    """

    def __init__(self, spark: SparkSession, folder: str, config: Config | None = None, options: Options | None = None, transport: Transport = http_transport):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.config, self.options, self.transport = config or Config(), options or Options(), transport
        self.state = StateStore(spark, f"{self.folder}/state")

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def begin(self, facts: DataFrame) -> None:
        """Note new documents and their pages."""
        pages = facts.filter("page_num > 0").select("doc_id", "page_num", "page_count")
        known = self.state.pages().select("doc_id", "page_num")
        self.state.append(pages.select("doc_id", "page_num").join(known, ["doc_id", "page_num"], "left_anti").withColumn("image_done", F.lit(False)))
        documents = facts.groupBy("doc_id").agg(F.max("page_count").alias("page_count"))
        self.state.mark_combined(documents.join(self.state.documents().select("doc_id"), "doc_id", "left_anti"), False)

    def add_images(self, images: DataFrame) -> None:
        """Phase 1: store page images (doc_id, page_num, content, error) and note which failed."""
        images.write.mode("append").parquet(self._path("images"))
        stored = self.spark.read.parquet(self._path("images"))
        pending = pages_of.pending_render(self.state.pages()).select("doc_id", "page_num")
        done = stored.join(pending, ["doc_id", "page_num"], "left_semi").groupBy("doc_id", "page_num").agg(F.max(F.col("content").isNotNull()).alias("image_done"))
        self.state.append(done.withColumn("image_failed", ~F.col("image_done")))

    def images(self) -> DataFrame:
        """doc_id, page_num, content of the stored page images."""
        return self.spark.read.parquet(self._path("images")).filter("content IS NOT NULL").dropDuplicates(["doc_id", "page_num"])

    def recognise(self, facts: DataFrame, ratios: DataFrame | None = None) -> None:
        """Phase 2: ask the model for all pending pages that are not blank, store raw replies, note the outcome.

        ``ratios``: doc_id, page_num, white_ratio. Blank pages never reach the model.
        """
        pending = pages_of.pending_recognition(self.state.pages()).select("doc_id", "page_num")
        flags = facts.select("doc_id", "page_num", "has_text", "has_drawings")
        flags = flags.join(ratios, ["doc_id", "page_num"], "left") if ratios is not None else flags.withColumn("white_ratio", F.lit(0.0))
        rows = pending.join(flags, ["doc_id", "page_num"], "left").withColumn("is_blank", facts_of.blank_pages(flags))
        asked = rows.filter("NOT is_blank").join(self.images(), ["doc_id", "page_num"])
        replies = recognise(asked, self.config.instances, self.config.timeout, self.transport)
        blank = rows.filter("is_blank").select("doc_id", "page_num", F.lit(None).cast("string").alias("raw"), F.lit(None).cast("string").alias("error"), F.lit(True).alias("is_blank"))
        replies.select("doc_id", "page_num", "raw", "error", F.lit(False).alias("is_blank")).unionByName(blank).write.mode("append").parquet(self._path("replies"))
        stored = self.spark.read.parquet(self._path("replies")).join(pending, ["doc_id", "page_num"], "left_semi")
        outcome = stored.groupBy("doc_id", "page_num").agg(F.max(F.col("error").isNull()).alias("ocr_done"), F.max("raw").alias("ocr_response"))
        self.state.append(outcome.withColumn("ocr_failed", ~F.col("ocr_done")))

    def repair(self, facts: DataFrame) -> DataFrame:
        """Phase 3: page Markdown of all stored replies; never calls the model."""
        replies = self.spark.read.parquet(self._path("replies")).filter("error IS NULL")
        latest = replies.dropDuplicates(["doc_id", "page_num"])
        parsed = parse_replies(latest.filter("NOT is_blank")).filter("error IS NULL").select("doc_id", "page_num", "text", "boxes")
        counts = facts.select("doc_id", "page_num", "page_count")
        rows = latest.select("doc_id", "page_num", "is_blank").join(parsed, ["doc_id", "page_num"], "left").join(counts, ["doc_id", "page_num"])
        tables = {name: pdf.fact_table(facts, name) for name in pdf.FACT_TABLES}
        return repair_pages(rows, **tables, include_links=self.options.include_links, include_comments=self.options.include_comments)

    def combine(self, facts: DataFrame, pages: DataFrame) -> DataFrame:
        """Phase 4: one Markdown text per document; notes that it is done."""
        state = self.state.pages().select("doc_id", "page_num", "ocr_done")
        stem = F.regexp_replace(F.substring_index("doc_id", "/", -1), r"\.[^.]*$", "")
        out = pages_of.combine(state.join(pages.select("doc_id", "page_num", "markdown"), ["doc_id", "page_num"], "left"), stem)
        out.write.mode("overwrite").parquet(self._path("combined"))
        self.state.mark_combined(out.select("doc_id"))
        return self.spark.read.parquet(self._path("combined"))

    def rerun(self, chosen: DataFrame) -> None:
        """Forget chosen pages (doc_id, page_num), so that the next run handles them again; their old replies are archived."""
        self.state.reset(chosen)
        names = [(x,) for x in _children(self.spark, self._path("_archive"))]
        version = pages_of.next_archive(self.spark.createDataFrame(names, "name string")).first()[0]
        for name in ("images", "replies"):
            if name in _children(self.spark, self.folder):
                stored = self.spark.read.parquet(self._path(name))
                stored.join(chosen, ["doc_id", "page_num"], "left_semi").write.parquet(self._path(f"_archive/v{version}/{name}"))
                stored.join(chosen, ["doc_id", "page_num"], "left_anti").write.parquet(self._path(f"{name}.next"))
                _replace(self.spark, self._path(f"{name}.next"), self._path(name))


def white_ratios(images: DataFrame) -> DataFrame:
    """doc_id, page_num, white_ratio of decoded images (doc_id, page_num, data, width, height, nChannels)."""
    return images.select("doc_id", "page_num", white_ratio(F.col("data"), F.col("width"), F.col("height"), F.col("nChannels")).alias("white_ratio"))


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _children(spark: SparkSession, path: str) -> list[str]:
    target, fs = _file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def _replace(spark: SparkSession, source: str, target: str) -> None:
    """Put a finished folder in another's place."""
    new, fs = _file_system(spark, source)
    old, _ = _file_system(spark, target)
    fs.delete(old, True)
    fs.rename(new, old)
