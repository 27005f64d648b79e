"""Facts of PDF files through PyMuPDF, which is imported when a file is read.

Where the library is missing, a clear error says so; all other parts of the engine work on
fact tables from any source. A page whose facts can't be read gives none and an error
column, and never fails its document.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FACTS = (
    "doc_id string, page_count int, page_num int, has_text boolean, has_drawings boolean, error string, "
    "spans array<struct<block_no:int,line_no:int,span_no:int,text:string,size:double>>, "
    "tables array<struct<table_no:int,x0:double,y0:double,rows:array<array<string>>>>, "
    "links array<struct<link_no:int,kind:string,uri:string,x0:double,y0:double,anchor:string>>, "
    "annots array<struct<annot_no:int,type:string,title:string,content:string>>, "
    "image_rects array<struct<rect_no:int,x0:double,y0:double,x1:double,y1:double>>"
)
FACT_TABLES = ("spans", "tables", "links", "annots", "image_rects")
RENDER_SCALE = 2.0


class PdfLibraryMissing(RuntimeError):
    """PyMuPDF is not installed."""


def _library():
    try:
        import fitz
    except ModuleNotFoundError as error:
        raise PdfLibraryMissing("reading PDF files needs PyMuPDF (module 'fitz')") from error
    return fitz


def _page(fitz, page) -> dict:
    """All facts of an open page."""
    spans = [
        {"block_no": b, "line_no": k, "span_no": s, "text": span["text"], "size": round(span["size"], 1)}
        for b, block in enumerate(page.get_text("dict")["blocks"])
        for k, line in enumerate(block.get("lines", ()))
        for s, span in enumerate(line["spans"])
    ]
    tables = [{"table_no": i, "x0": t.bbox[0], "y0": t.bbox[1], "rows": t.extract()} for i, t in enumerate(page.find_tables().tables) if t.row_count]
    links = []
    for i, link in enumerate(page.get_links()):
        rect = link.get("from")
        web = link.get("kind") == fitz.LINK_URI
        place = {"x0": rect.x0, "y0": rect.y0, "anchor": page.get_textbox(rect)} if rect else {"x0": None, "y0": None, "anchor": None}
        links.append({"link_no": i, "kind": "uri" if web else str(link.get("kind")), "uri": link.get("uri"), **place})
    annots = [{"annot_no": i, "type": a.type[1], "title": a.info.get("title"), "content": a.info.get("content")} for i, a in enumerate(page.annots() or ())]
    placed = [r for image in page.get_images(full=True) for r in page.get_image_rects(image[0])]
    rects = [{"rect_no": i, "x0": r.x0, "y0": r.y0, "x1": r.x1, "y1": r.y1} for i, r in enumerate(placed)]
    return {"has_text": bool(page.get_text().strip()), "has_drawings": bool(page.get_drawings()), "spans": spans, "tables": tables, "links": links, "annots": annots, "image_rects": rects}


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """One row per page of every PDF below a path, by one scan of each file.

    A file that can't be opened gives one row with page_count 0 and its error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)

    def scan(batches: Iterator) -> Iterator:
        import pandas as pd

        fitz = _library()
        empty = {"has_text": None, "has_drawings": None, **{t: [] for t in FACT_TABLES}}
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows = []
                try:
                    with fitz.open(stream=content, filetype="pdf") as document:
                        for n in range(document.page_count):
                            try:
                                found = _page(fitz, document[n]) | {"error": None}
                            except Exception as error:  # any library error: the page stays, without facts
                                found = empty | {"error": str(error)}
                            rows.append({"doc_id": name, "page_count": document.page_count, "page_num": n + 1, **found})
                except Exception as error:  # the file is unreadable
                    rows.append({"doc_id": name, "page_count": 0, "page_num": 0, "error": str(error), **empty})
                yield pd.DataFrame(rows)

    return files.select("path", "content").mapInPandas(scan, FACTS)


def fact_table(facts: DataFrame, name: str) -> DataFrame:
    """One of the fact tables, a row per fact."""
    return facts.select("doc_id", "page_num", F.inline(name))


def render(spark: SparkSession, path: str, pages: DataFrame, scale: float = RENDER_SCALE) -> DataFrame:
    """doc_id, page_num, content (JPEG), error for the wanted pages (doc_id, page_num); each file is opened once."""
    wanted = pages.groupBy("doc_id").agg(F.sort_array(F.collect_set("page_num")).alias("wanted"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)

    def draw(batches: Iterator) -> Iterator:
        import pandas as pd

        fitz = _library()
        for batch in batches:
            for name, content, numbers in zip(batch["doc_id"], batch["content"], batch["wanted"]):
                for number in numbers:
                    image = error = None
                    try:
                        with fitz.open(stream=content, filetype="pdf") as document:
                            image = document[int(number) - 1].get_pixmap(matrix=fitz.Matrix(scale, scale)).tobytes("jpeg")
                    except Exception as failure:  # captured as a row
                        error = str(failure)
                    yield pd.DataFrame([{"doc_id": name, "page_num": int(number), "content": image, "error": error}])

    rows = files.select(F.col("path").alias("doc_id"), "content").join(wanted, "doc_id")
    return rows.mapInPandas(draw, "doc_id string, page_num int, content binary, error string")


def crop_regions(spark: SparkSession, path: str, boxes: DataFrame, scale: float = RENDER_SCALE) -> DataFrame:
    """doc_id, page_num, number, content (JPEG), error for regions (doc_id, page_num, number, x0, y0, x1, y1) in points."""
    wanted = boxes.groupBy("doc_id").agg(F.collect_list(F.struct("page_num", "number", "x0", "y0", "x1", "y1")).alias("wanted"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)

    def draw(batches: Iterator) -> Iterator:
        import pandas as pd

        fitz = _library()
        for batch in batches:
            for name, content, regions in zip(batch["doc_id"], batch["content"], batch["wanted"]):
                for r in regions:
                    image = error = None
                    try:
                        with fitz.open(stream=content, filetype="pdf") as document:
                            clip = fitz.Rect(r["x0"], r["y0"], r["x1"], r["y1"])
                            image = document[int(r["page_num"]) - 1].get_pixmap(matrix=fitz.Matrix(scale, scale), clip=clip).tobytes("jpeg")
                    except Exception as failure:  # a diagram never fails its page
                        error = str(failure)
                    yield pd.DataFrame([{"doc_id": name, "page_num": int(r["page_num"]), "number": int(r["number"]), "content": image, "error": error}])

    rows = files.select(F.col("path").alias("doc_id"), "content").join(wanted, "doc_id")
    return rows.mapInPandas(draw, "doc_id string, page_num int, number int, content binary, error string")
