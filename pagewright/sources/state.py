"""The state log: appended entries per page, latest wins; JSON documents for exchange.

Appending keeps updates cheap (one row per page and run, instead of a whole file per
page) and safe under retries. ``StateStore`` keeps the log as Parquet below a folder.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators.pages import FLAGS, latest_state

LOG = "doc_id string, page_num int, version long, image_done boolean, image_failed boolean, ocr_done boolean, ocr_failed boolean, diagram_count int, ocr_response string"
DOCUMENTS = "doc_id string, page_count int, version long, combined_done boolean"


class StateMismatch(ValueError):
    """The stored state belongs to another document or page count."""


@dataclass
class PageState:
    image_done: bool = False
    image_failed: bool = False
    ocr_done: bool = False
    ocr_failed: bool = False
    diagram_count: int = 0
    ocr_response: str | None = None


@dataclass
class DocumentState:
    pdf_path: str
    page_count: int
    combined_done: bool = False
    pages: dict[str, PageState] = field(default_factory=dict)

    @classmethod
    def fresh(cls, path: str, page_count: int) -> DocumentState:
        return cls(path, page_count, False, {str(n): PageState() for n in range(1, page_count + 1)})

    @classmethod
    def from_json(cls, text: str) -> DocumentState:
        """Unknown page keys raise TypeError, missing ones take their defaults."""
        data = json.loads(text)
        pages = {k: PageState(**v) for k, v in data.pop("pages").items()}
        return cls(pages=pages, **data)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, ensure_ascii=False)

    def check(self, path: str, page_count: int) -> None:
        if self.pdf_path != path or self.page_count != page_count:
            raise StateMismatch(f"the state is that of {self.pdf_path} with {self.page_count} pages")

    @property
    def status(self) -> str:
        if self.combined_done:
            return "complete"
        return "partial" if any(getattr(p, f) for p in self.pages.values() for f in FLAGS) else "not_started"

    def reset(self, numbers: set[int]) -> None:
        """Forget what was done for some pages."""
        self.combined_done = False
        self.pages.update({str(n): PageState() for n in numbers})


class StateStore:
    """The log of many documents in a folder that Spark can write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def _next(self, name: str, schema: str) -> int:
        return (self._read(name, schema).agg(F.max("version")).first()[0] or 0) + 1

    def pages(self) -> DataFrame:
        return latest_state(self._read("pages", LOG))

    def documents(self) -> DataFrame:
        rows = self._read("documents", DOCUMENTS).groupBy("doc_id").agg(F.max_by(F.struct("page_count", "combined_done"), "version").alias("d"))
        return rows.select("doc_id", "d.page_count", "d.combined_done")

    def append(self, entries: DataFrame) -> None:
        """Add entries (doc_id, page_num and any of the state columns); columns left out keep their last value."""
        last = self.pages()
        state = (*FLAGS, "diagram_count", "ocr_response")
        given = [c for c in state if c in entries.columns]
        new = entries.select("doc_id", "page_num", *(F.col(c).alias(f"new_{c}") for c in given)).join(last, ["doc_id", "page_num"], "left")
        values = [F.coalesce(f"new_{c}", c).alias(c) if c in given else F.col(c) for c in state]
        version = self._next("pages", LOG)
        new.select("doc_id", F.col("page_num").cast("int").alias("page_num"), F.lit(version).cast("long").alias("version"), *values).write.mode("append").parquet(f"{self.path}/pages")

    def reset(self, chosen: DataFrame) -> None:
        """Forget pages (doc_id, page_num), and that their documents are combined."""
        version = self._next("pages", LOG)
        kinds = [x.strip().split(" ") for x in LOG.split(",")][3:]
        empty = [F.lit(False if k == "boolean" else 0 if k == "int" else None).cast(k).alias(n) for n, k in kinds]
        chosen.select("doc_id", F.col("page_num").cast("int"), F.lit(version).cast("long").alias("version"), *empty).write.mode("append").parquet(f"{self.path}/pages")
        self.mark_combined(chosen.select("doc_id").distinct(), False)

    def mark_combined(self, documents: DataFrame, done: bool = True) -> None:
        """Set whether documents (doc_id, and page_count if new) are combined."""
        version = self._next("documents", DOCUMENTS)
        known = self.documents().select("doc_id", F.col("page_count").alias("known"))
        count = F.coalesce("page_count", "known") if "page_count" in documents.columns else F.col("known")
        rows = documents.join(known, "doc_id", "left")
        rows.select("doc_id", count.cast("int").alias("page_count"), F.lit(version).cast("long").alias("version"), F.lit(done).alias("combined_done")).write.mode("append").parquet(f"{self.path}/documents")
