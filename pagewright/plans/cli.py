"""Command line: one PDF in, one Markdown file beside it.

Exit codes: 0 done or already complete, 1 bad arguments or nothing to rerun, 2 file missing,
3 file unreadable, 4 bad configuration or no instance, 5 all renders failed, 6 all
recognitions failed, 7 output not writable, 8 state of another document.
"""

from __future__ import annotations

import argparse
import math
import os
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import pages as pages_of
from pagewright.plans.pipeline import DocumentPipeline, Options, white_ratios
from pagewright.sources import files, images, pdf
from pagewright.sources.config import ConfigError, load_config, parse_page_spec
from pagewright.sources.recognition import probe

OK, BAD_ARGUMENTS, MISSING, UNREADABLE, BAD_CONFIG, NO_RENDER, NO_RECOGNITION, NOT_WRITTEN, MISMATCH = range(9)


class Exit(Exception):
    """Ends a run with a code and a message."""

    def __init__(self, code: int, message: str = ""):
        super().__init__(message)
        self.code = code


def _scale(text: str) -> float:
    value = float(text)
    if not math.isfinite(value) or value <= 0:
        raise argparse.ArgumentTypeError("must be a positive number")
    return value


def _pages(text: str) -> set[int]:
    try:
        return parse_page_spec(text)
    except ValueError as error:
        raise argparse.ArgumentTypeError(str(error)) from error


def parse_arguments(arguments: Sequence[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="pagewright", description=__doc__.splitlines()[0], exit_on_error=False, allow_abbrev=False)
    parser.add_argument("pdf_path", type=Path)
    parser.add_argument("--dpi-scale", type=_scale, default=pdf.RENDER_SCALE, metavar="N")
    parser.add_argument("--include-comments", action="store_true")
    parser.add_argument("--include-links", action="store_true")
    parser.add_argument("--rerun-pages", type=_pages, metavar="SPEC")
    try:
        return parser.parse_args(list(arguments))
    except (argparse.ArgumentError, SystemExit) as error:
        if isinstance(error, SystemExit) and error.code == 0:
            raise Exit(OK) from error
        raise Exit(BAD_ARGUMENTS, str(error)) from error


def _ratios(spark: SparkSession, folder: Path, name: str) -> DataFrame:
    """doc_id, page_num, white_ratio of the page images below a document's folder."""
    read = images.read_images(spark, f"{folder.resolve().as_uri()}/pages/*.jpg")
    number = F.regexp_extract("origin", r"page_(\d+)\.jpg$", 1).cast("int")
    return white_ratios(read.withColumn("doc_id", F.lit(name)).withColumn("page_num", number))


def _export_diagrams(spark: SparkSession, path: Path, repaired: DataFrame, folder: Path, count: int, scale: float) -> tuple[dict[int, int], dict[int, list[int]]]:
    """Write the diagrams of all pages: image placements from the PDF, the model's boxes from the page image.

    Returns how many each page has, and the numbers of those that could not be cropped, which never fail their page.
    """
    rows = repaired.select("doc_id", "page_num", "from_source", F.posexplode("crops").alias("i", "c"))
    rows = rows.select("doc_id", "page_num", "from_source", (F.col("i") + 1).alias("number"), "c.*").cache()
    name = lambda r: f"{files.page_name(r['page_num'], count)}_diagram_{r['number']}.jpg"
    made: dict[int, int] = {}
    missing: dict[int, list[int]] = {}

    def note(r, there: bool) -> None:
        if there:
            made[r["page_num"]] = made.get(r["page_num"], 0) + 1
        else:
            missing.setdefault(r["page_num"], []).append(r["number"])
            print(f"diagram {name(r)} could not be cropped", file=sys.stderr)

    placed = rows.filter("from_source").drop("from_source")
    if not placed.isEmpty():
        for r in pdf.crop_regions(spark, path.resolve().as_uri(), placed, scale).toLocalIterator():
            if r["content"] is not None:
                files.write_bytes(folder / "diagrams" / name(r), bytes(r["content"]))
            note(r, r["content"] is not None)
    for r in rows.filter("NOT from_source").toLocalIterator():
        box = tuple(int(r[c]) for c in ("x0", "y0", "x1", "y1"))
        note(r, images.crop_file(spark, (folder / "pages" / f"{files.page_name(r['page_num'], count)}.jpg").resolve(), box, (folder / "diagrams" / name(r)).resolve()))
    return made, missing


def _without_lost(spark: SparkSession, repaired: DataFrame, missing: dict[int, list[int]], count: int) -> DataFrame:
    """The pages without references to diagrams that were not written."""
    if not missing:
        return repaired
    lost = spark.createDataFrame([(p, sorted(n)) for p, n in missing.items()], "page_num int, lost array<int>")
    stem = T.page_stem(F.col("page_num"), F.lit(count))
    lines = F.transform("lost", lambda n: F.concat(F.lit("\n"), T.diagram_reference(stem, n)))
    block = F.concat(F.lit("\n"), F.array_join(lines, ""))
    one_by_one = F.aggregate(lines, F.col("markdown"), lambda text, line: F.replace(text, line, F.lit("")))
    kept = F.when(F.size("lost") == F.size("crops"), F.replace("markdown", block, F.lit(""))).otherwise(one_by_one)
    rows = repaired.join(F.broadcast(lost), "page_num", "left").withColumn("markdown", F.when(F.col("lost").isNull(), F.col("markdown")).otherwise(kept))
    return rows.select(*repaired.columns)


def _run(arguments: argparse.Namespace, spark: SparkSession) -> None:
    path: Path = arguments.pdf_path
    if not path.exists():
        raise Exit(MISSING, f"no such file: {path}")
    if not path.is_file() or not os.access(path, os.R_OK):
        raise Exit(UNREADABLE, f"not a readable file: {path}")
    try:
        config = load_config(path.parent, Path.cwd())
    except ConfigError as error:
        raise Exit(BAD_CONFIG, str(error)) from error
    alive = probe(config.instances)
    if not alive:
        raise Exit(BAD_CONFIG, "no model instance answers")
    folder = path.with_suffix("")
    options = Options(arguments.dpi_scale, arguments.include_comments, arguments.include_links)
    config = type(config)(tuple(alive), config.render_workers, config.timeout)
    run = DocumentPipeline(spark, folder.resolve().as_uri(), config, options)
    facts = pdf.read_facts(spark, path.resolve().as_uri()).cache()
    try:
        unreadable = facts.filter("page_count > 0").isEmpty()
    except PythonException as error:
        if pdf.PdfLibraryMissing.__name__ not in str(error):
            raise
        raise Exit(UNREADABLE, "reading PDF files needs PyMuPDF") from error
    if unreadable:
        raise Exit(UNREADABLE, f"not a readable PDF: {path}")
    known = run.state.documents().collect()  # one document per folder
    count = facts.agg(F.max("page_count")).first()[0]
    name = facts.first()["doc_id"]
    if any(d["doc_id"] != name or d["page_count"] != count for d in known):
        raise Exit(MISMATCH, "the state belongs to another document")
    if arguments.rerun_pages:
        if not known:
            raise Exit(BAD_ARGUMENTS, "nothing has run yet")
        wanted = spark.createDataFrame([(n,) for n in sorted(arguments.rerun_pages)], "page_num int")
        chosen, absent = pages_of.choose_pages(facts.filter("page_num > 0").select("doc_id", "page_num"), wanted)
        for row in absent.collect():
            print(f"page {row[0]} does not exist", file=sys.stderr)
        if chosen.isEmpty():
            raise Exit(BAD_ARGUMENTS, "no page to rerun")
        try:
            files.archive_pages(folder, [r[0] for r in chosen.select("page_num").collect()], count)
        except OSError as error:
            raise Exit(NOT_WRITTEN, str(error)) from error
        run.rerun(chosen)
    elif known and known[0]["combined_done"]:
        print("already complete")
        return
    run.begin(facts)
    pending = pages_of.pending_render(run.state.pages()).select("doc_id", "page_num")
    run.add_images(pdf.render(spark, path.resolve().as_uri(), pending, options.dpi_scale))
    documents = facts.select("doc_id").distinct()
    if pages_of.failure_gates(run.state.pages(), documents).first()["all_renders_failed"]:
        raise Exit(NO_RENDER, "no page could be rendered")
    try:
        files.export_images(run.images(), folder, count)
    except OSError as error:
        raise Exit(NOT_WRITTEN, str(error)) from error
    run.recognise(facts, _ratios(spark, folder, name))
    if pages_of.failure_gates(run.state.pages(), documents).first()["all_recognition_failed"]:
        raise Exit(NO_RECOGNITION, "no page could be recognised")
    repaired = run.repair(facts).cache()
    try:
        made, missing = _export_diagrams(spark, path, repaired, folder, count, options.dpi_scale)
        repaired = _without_lost(spark, repaired, missing, count)
        files.export_pages(repaired, folder, count)
        if made:
            run.state.append(spark.createDataFrame([(name, p, n) for p, n in made.items()], "doc_id string, page_num int, diagram_count int"))
        markdown = run.combine(facts, repaired).first()
        files.write_text(path.with_suffix(".md"), markdown["markdown"] if markdown else "")
        files.export_state(run.state.pages(), folder / "state.json", str(path.resolve()), count, True)
    except OSError as error:
        raise Exit(NOT_WRITTEN, str(error)) from error
    print(pages_of.run_summary(run.state.pages()).first().asDict())


def run(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run and return the exit code."""
    try:
        parsed = parse_arguments(sys.argv[1:] if arguments is None else arguments)
        _run(parsed, spark or SparkSession.builder.appName("pagewright").getOrCreate())
        return OK
    except Exit as end:
        if end.code:
            print(f"error: {end}", file=sys.stderr)
        return end.code


if __name__ == "__main__":
    sys.exit(run())
