"""The file layout of one document: ``<stem>.md`` beside the PDF; state, pages, diagrams and archives in ``<stem>/``.

Many documents stay in tables; this layout is for one document at a time and for exchange. A file is written
aside and renamed, so a reader never sees half of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.sources.state import DocumentState, PageState


def write_text(path: Path, text: str) -> None:
    write_bytes(path, text.encode("utf-8"))


def write_bytes(path: Path, content: bytes) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    partial = path.with_name(path.name + ".partial")
    partial.write_bytes(content)
    partial.replace(path)


def page_name(page: int, page_count: int) -> str:
    return f"page_{page:0{len(str(page_count))}d}"


def export_pages(pages: DataFrame, folder: Path, page_count: int) -> int:
    """Write one document's page Markdown (page_num, markdown), one page in memory at a time; returns their number."""
    written = 0
    for row in pages.select("page_num", "markdown").toLocalIterator():
        write_text(folder / "pages" / f"{page_name(row['page_num'], page_count)}.md", row["markdown"])
        written += 1
    return written


def export_images(images: DataFrame, folder: Path, page_count: int) -> None:
    """Write one document's page images (page_num, content), one in memory at a time."""
    for row in images.select("page_num", "content").toLocalIterator():
        write_bytes(folder / "pages" / f"{page_name(row['page_num'], page_count)}.jpg", bytes(row["content"]))


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(page_num, markdown) of the page files below a document's folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "page_*.md").load(f"{folder}/pages")
    number = F.regexp_extract("path", r"page_(\d+)\.md$", 1).cast("int")
    return files.select(number.alias("page_num"), F.decode("content", "UTF-8").alias("markdown"))


def export_state(state: DataFrame, path: Path, document: str, page_count: int, combined: bool) -> None:
    """Write one document's state (columns of ``latest_state``) as its JSON document."""
    out = DocumentState.fresh(document, page_count)
    out.combined_done = combined
    for row in state.toLocalIterator():
        values = {k: v for k, v in row.asDict().items() if k in PageState.__dataclass_fields__}
        out.pages[str(row["page_num"])] = PageState(**values)
    write_text(path, out.to_json())


def load_state(path: Path, document: str, page_count: int) -> DocumentState:
    """A stored state, checked, or a fresh one."""
    if not path.is_file():
        return DocumentState.fresh(document, page_count)
    state = DocumentState.from_json(path.read_text(encoding="utf-8"))
    state.check(document, page_count)
    return state


def archive_pages(folder: Path, numbers: Iterable[int], page_count: int) -> Path | None:
    """Move the files of some pages, and the combined file, to the next ``_archive/v<n>``; None if there is none of them."""
    archive = folder / "_archive"
    known = [int(m[1]) for p in archive.glob("v*") if (m := re.fullmatch(r"v(\d+)", p.name))]
    target = archive / f"v{max(known, default=0) + 1}"
    chosen = [folder.with_suffix(".md")]
    for number in sorted(numbers):
        name = page_name(number, page_count)
        chosen += [folder / "pages" / f"{name}.jpg", folder / "pages" / f"{name}.md", *sorted((folder / "diagrams").glob(f"{name}_diagram_*.jpg"))]
    moved = [p for p in chosen if p.is_file()]
    for path in moved:
        place = target / (path.relative_to(folder) if path.is_relative_to(folder) else Path(path.name))
        place.parent.mkdir(parents=True, exist_ok=True)
        path.rename(place)
    return target if moved else None
