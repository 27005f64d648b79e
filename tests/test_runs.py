"""Sources, state store, pipeline, command line and streaming."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from pagewright.plans import cli
from pagewright.plans.pipeline import DocumentPipeline, Options
from pagewright.sources import files, pdf
from pagewright.sources.config import Config, ConfigError, Instance, load_config, parse_config, parse_page_spec
from pagewright.sources.images import crop, white_share
from pagewright.sources.recognition import ReplyError, http_transport, parse_reply, probe, try_instances
from pagewright.sources.state import DocumentState, StateMismatch


def test_page_spec():
    assert parse_page_spec("2, 4-6,5") == {2, 4, 5, 6}
    for bad in ("4-2", "-5", "0", "3,", "1-2-3", "", "a", "1-", ","):
        with pytest.raises(ValueError):
            parse_page_spec(bad)


def test_config(tmp_path):
    assert load_config(tmp_path).instances == (Instance(),)
    (tmp_path / "ollama.json").write_text(json.dumps({"instances": [{"url": "http://h"}], "ocr_timeout": 5}))
    assert load_config(tmp_path).timeout == 5
    for bad in ({}, {"instances": []}, {"instances": [{}]}, {"instances": [{"url": "u"}], "max_render_workers": 0}, {"instances": [{"url": "u"}], "ocr_timeout": -1}, []):
        with pytest.raises(ConfigError):
            parse_config(bad)


def test_replies():
    assert parse_reply('```json\n{"text":"> q\\nr","diagrams":[]}\n```') == ("q\nr", [])
    assert parse_reply('{"text":"x","diagrams":[{"x":1.9,"width":"7"}]}')[1] == [{"x": 1.0, "y": 0.0, "width": 7.0, "height": 0.0}]
    for bad in ('{"text":"x"}', "x", '```json {"text":"","diagrams":[]}```', '{"text":5,"diagrams":[]}', '{"text":"","diagrams":null}', "[]"):
        with pytest.raises(ReplyError):
            parse_reply(bad)


def test_white_share():
    white, grey = bytes([255] * 300 * 300 * 3), bytes([200] * 300 * 300 * 3)
    assert white_share(white, 300, 300, 3) == 1.0 and white_share(grey, 300, 300, 3) == 0.0
    assert white_share(b"", 0, 0, 0) == 0.0 and white_share(None, -1, -1, -1) == 0.0
    assert crop(bytes(range(12)), 4, 3, 1, (1, 1, 3, 9)) == bytes([5, 6, 9, 10])


@pytest.fixture
def server():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/api/tags" else 404)
            self.end_headers()

        def do_POST(self):
            self.rfile.read(int(self.headers["Content-Length"]))
            body = json.dumps({"response": json.dumps({"text": "# Title\nsome\nwords", "diagrams": []})}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    made = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}"
    made.shutdown()


def test_probe_and_rotation(server):
    good, bad = Instance(server), Instance("http://127.0.0.1:9")
    assert probe([bad, Instance("no-scheme"), good]) == [good]
    raw, text, boxes, error = try_instances(1, b"x", [bad, good], 5, http_transport)
    assert text == "# Title\nsome\nwords" and boxes == [] and error is None and raw
    assert try_instances(1, b"x", [bad], 1, http_transport)[3].startswith("http://127.0.0.1:9")


def test_state_document():
    state = DocumentState.fresh("a.pdf", 2)
    assert state.status == "not_started"
    old = json.dumps({"pdf_path": "a.pdf", "page_count": 1, "combined_done": False, "pages": {"1": {"image_done": True}}})
    assert DocumentState.from_json(old).status == "partial"
    assert DocumentState.from_json(state.to_json()) == state
    with pytest.raises(StateMismatch):
        state.check("b.pdf", 2)
    with pytest.raises(TypeError):
        DocumentState.from_json(old.replace("image_done", "unknown"))


def _facts(spark, pages):
    rows = [("d.pdf", pages, n, True, False, None, [(0, 0, 0, "Title", 18.0), (0, 1, 0, "body text " * 5, 11.0)], [], [], [(0, "Text", None, "note")], []) for n in range(1, pages + 1)]
    return spark.createDataFrame(rows, pdf.FACTS)


def test_pipeline_resumes_and_reruns(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def transport(instance, image, timeout):
        (calls / image.decode()).touch()
        if image == b"2":
            raise OSError("down")
        return json.dumps({"text": "# Title\nsome\nwords\n* x", "diagrams": []})

    run = DocumentPipeline(spark, (tmp_path / "out").as_uri(), Config((Instance("http://a"),)), Options(include_comments=True), transport)
    facts = _facts(spark, 3)
    run.begin(facts)
    assert run.state.pages().count() == 3
    run.add_images(spark.createDataFrame([("d.pdf", n, str(n).encode(), None) for n in (1, 2, 3)], "doc_id string, page_num int, content binary, error string"))
    run.recognise(facts)
    state = {r["page_num"]: r for r in run.state.pages().collect()}
    assert state[1]["ocr_done"] and state[2]["ocr_failed"] and not state[2]["ocr_done"]
    assert sorted(p.name for p in calls.iterdir()) == ["1", "2", "3"]
    (calls / "1").unlink()
    run.recognise(facts)  # nothing is pending
    assert sorted(p.name for p in calls.iterdir()) == ["2", "3"]
    text = run.combine(facts, run.repair(facts)).first()["markdown"]
    page = "# Title\nsome words\n- x\n\n## Comments\n\n- **Unknown** (Text): note"
    assert text == f"--- PAGE 1 ---\n{page}\n\n--- PAGE 3 ---\n{page}"
    assert run.state.documents().first()["combined_done"]
    run.rerun(spark.createDataFrame([("d.pdf", 1)], "doc_id string, page_num int"))
    assert not run.state.documents().first()["combined_done"]
    assert not {r["page_num"]: r for r in run.state.pages().collect()}[1]["image_done"]
    assert spark.read.parquet((tmp_path / "out/_archive/v1/replies").as_uri()).count() == 1


def test_blank_pages_skip_the_model(spark, tmp_path):
    def transport(instance, image, timeout):
        raise AssertionError("a blank page reached the model")

    run = DocumentPipeline(spark, (tmp_path / "out").as_uri(), Config((Instance("http://a"),)), transport=transport)
    facts = _facts(spark, 1).withColumn("has_text", F.lit(False))
    run.begin(facts)
    run.add_images(spark.createDataFrame([("d.pdf", 1, b"1", None)], "doc_id string, page_num int, content binary, error string"))
    run.recognise(facts, spark.createDataFrame([("d.pdf", 1, 1.0)], "doc_id string, page_num int, white_ratio double"))
    assert run.repair(facts).first()["markdown"] == "<!-- blank page -->"


def test_command_line(spark, tmp_path, capsys):
    assert cli.run([], spark) == 1
    assert cli.run(["x.pdf", "--dpi-scale", "nan"], spark) == 1
    assert cli.run(["x.pdf", "--rerun-pages", "3-1"], spark) == 1
    assert cli.run([str(tmp_path / "none.pdf")], spark) == 2
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    (tmp_path / "ollama.json").write_text("{")
    assert cli.run([str(tmp_path / "a.pdf")], spark) == 4
    (tmp_path / "ollama.json").write_text(json.dumps({"instances": [{"url": "http://127.0.0.1:9"}]}))
    assert cli.run([str(tmp_path / "a.pdf")], spark) == 4
    capsys.readouterr()


def _jpeg(spark, path, ink=None):
    """A white image of 100 x 80 pixels, with a black box of ink (x, y, width, height)."""
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(100, 80, 1)
    for colour, (x, y, w, h) in ((0xFFFFFF, (0, 0, 100, 80)), *(((0, ink),) if ink else ())):
        for i in range(x, x + w):
            for j in range(y, y + h):
                image.setRGB(i, j, colour)
    jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(path)))
    return path.read_bytes()


def test_run_writes_blank_markers_diagrams_and_archives(spark, tmp_path, monkeypatch):
    from functools import partial

    folder = tmp_path / "book"
    (tmp_path / "book.pdf").write_bytes(b"%PDF")
    (tmp_path / "made").mkdir()
    white, inked = _jpeg(spark, tmp_path / "made/w.jpg"), _jpeg(spark, tmp_path / "made/i.jpg", (10, 10, 30, 20))
    name = (tmp_path / "book.pdf").as_uri()
    page = lambda n, text, rects: (name, 3, n, text, False, None, [], [], [], [], rects)
    facts = spark.createDataFrame([page(1, False, []), page(2, True, []), page(3, True, [(0, 1.0, 2.0, 3.0, 4.0)])], pdf.FACTS)

    def transport(instance, image, timeout):
        if image == white:
            raise AssertionError("a blank page reached the model")
        return json.dumps({"text": "words", "diagrams": [{"x": -5, "y": 10, "width": 40, "height": 20}, {"x": 500, "y": 0, "width": 9, "height": 9}]})

    def render(spark, path, pages, scale):
        made = spark.createDataFrame([(name, n, white if n == 1 else inked, None) for n in (1, 2, 3)], "doc_id string, page_num int, content binary, error string")
        return made.join(pages, ["doc_id", "page_num"], "left_semi")

    monkeypatch.setattr(cli, "probe", list)
    monkeypatch.setattr(cli, "DocumentPipeline", partial(DocumentPipeline, transport=transport))
    monkeypatch.setattr(pdf, "read_facts", lambda *_: facts)
    monkeypatch.setattr(pdf, "render", render)
    monkeypatch.setattr(pdf, "crop_regions", lambda spark, path, boxes, scale: boxes.select("doc_id", "page_num", "number", F.encode(F.concat_ws(",", "x0", "y1"), "UTF-8").alias("content"), F.lit(None).cast("string").alias("error")))
    assert cli.run([str(tmp_path / "book.pdf")], spark) == 0
    assert (folder / "pages/page_1.md").read_text() == "<!-- blank page -->"
    assert sorted(p.name for p in (folder / "diagrams").iterdir()) == ["page_2_diagram_1.jpg", "page_3_diagram_1.jpg"]
    assert (folder / "diagrams/page_3_diagram_1.jpg").read_bytes() == b"1.0,4.0"
    size = spark.read.format("image").load((folder / "diagrams/page_2_diagram_1.jpg").as_uri()).select("image.width", "image.height").first()
    assert tuple(size) == (33, 19)  # 40 x 20, trimmed to 95 %, from -5 clamped to 0
    assert "diagrams/page_2_diagram_1.jpg" in (tmp_path / "book.md").read_text()
    assert "diagram_2" not in (tmp_path / "book.md").read_text() + (folder / "pages/page_2.md").read_text()  # it lies outside the image
    assert {n: p["diagram_count"] for n, p in json.loads((folder / "state.json").read_text())["pages"].items()} == {"1": 0, "2": 1, "3": 1}
    assert cli.run([str(tmp_path / "book.pdf"), "--rerun-pages", "2"], spark) == 0
    archived = {str(p.relative_to(folder / "_archive")).split("/", 1)[1] for p in (folder / "_archive").rglob("*.*") if p.suffix in (".md", ".jpg")}
    assert archived == {"book.md", "pages/page_2.md", "pages/page_2.jpg", "diagrams/page_2_diagram_1.jpg"}
    assert (folder / "diagrams/page_2_diagram_1.jpg").is_file() and (tmp_path / "book.md").is_file()


def test_exit_codes(spark, tmp_path, monkeypatch, capsys):
    from functools import partial

    (tmp_path / "folder.pdf").mkdir()
    assert cli.run([str(tmp_path / "folder.pdf")], spark) == 3
    path = tmp_path / "book.pdf"
    path.write_bytes(b"%PDF")
    monkeypatch.setattr(cli, "probe", list)
    assert cli.run([str(path)], spark) == 3  # without the PDF library
    state = {"facts": 0, "rendered": False, "reply": None}
    row = lambda n: (path.as_uri(), 2, n, True, False, None, [], [], [], [], [])
    monkeypatch.setattr(pdf, "read_facts", lambda *_: spark.createDataFrame([row(n) for n in range(1, state["facts"] + 1)], pdf.FACTS))
    image = _jpeg(spark, tmp_path / "i.jpg", (10, 10, 30, 20))
    render = lambda spark, path, pages, scale: pages.withColumn("content", F.lit(image if state["rendered"] else None).cast("binary")).withColumn("error", F.lit(None).cast("string"))
    monkeypatch.setattr(pdf, "render", render)

    def at(folder, **new):
        state.update(new)
        reply = state["reply"]

        def transport(instance, content, timeout):
            if reply is None:
                raise OSError("down")
            return reply

        monkeypatch.setattr(cli, "DocumentPipeline", partial(DocumentPipeline, transport=transport))
        nonlocal path
        (tmp_path / folder).mkdir(exist_ok=True)
        path = tmp_path / folder / "book.pdf"
        path.write_bytes(b"%PDF")
        return cli.run([str(path)], spark)

    assert at("a") == 3  # no page
    assert at("b", facts=2) == 5
    assert at("c", rendered=True) == 6
    (tmp_path / "d/book.md").mkdir(parents=True)
    assert at("d", reply=json.dumps({"text": "words", "diagrams": []})) == 7
    assert at("e") == 0 and (tmp_path / "e/book.md").read_text().startswith("--- PAGE 1 ---\nwords")
    assert at("e") == 0  # already complete
    row = lambda n: (path.as_uri(), 3, n, True, False, None, [], [], [], [], [])
    assert at("e", facts=3) == 8
    capsys.readouterr()


def test_diagrams_that_were_not_cropped_leave_no_reference(spark):
    ref = "![Diagram {0}](diagrams/page_2_diagram_{0}.jpg)".format
    pages = [(1, "a", 0), (2, "\n".join(["text", "", ref(1), ref(2), ref(3), "", "## Comments"]), 3)]
    frame = spark.createDataFrame(pages, "page_num int, markdown string, n int").select("page_num", "markdown", F.array_repeat(F.lit(1), F.col("n")).alias("crops"))
    text = lambda lost: dict(tuple(r)[:2] for r in cli._without_lost(spark, frame, {2: lost} if lost else {}, 3).collect())
    assert text([])[2] == pages[1][1]
    assert text([2])[2] == "\n".join(["text", "", ref(1), ref(3), "", "## Comments"]) and text([2])[1] == "a"
    assert text([1, 2, 3])[2] == "\n".join(["text", "", "## Comments"])


def test_stream(spark, tmp_path):
    from pagewright.streaming import read_page_stream, write_page_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"doc_id": "d", "page_num": 1, "text": "a\nb"}) + "\n")
    for _ in range(2):  # the second run finds nothing new
        write_page_stream(read_page_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r["markdown"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a b"]


def test_file_layout(spark, tmp_path):
    folder = tmp_path / "book"
    pages = spark.createDataFrame([(1, "a"), (12, "é")], "page_num int, markdown string")
    assert files.export_pages(pages, folder, 12) == 2
    assert (folder / "pages/page_01.md").read_text() == "a"
    assert dict(tuple(r) for r in files.read_pages(spark, folder.as_uri()).collect()) == {1: "a", 12: "é"}
    state = spark.createDataFrame([(1, True, False, True, False, 2, "raw")], "page_num int, image_done boolean, image_failed boolean, ocr_done boolean, ocr_failed boolean, diagram_count int, ocr_response string")
    files.export_state(state, folder / "state.json", "book.pdf", 12, True)
    loaded = files.load_state(folder / "state.json", "book.pdf", 12)
    assert loaded.status == "complete" and loaded.pages["1"].diagram_count == 2 and len(loaded.pages) == 12
    loaded.reset({1})
    assert loaded.status == "not_started"
    with pytest.raises(StateMismatch):
        files.load_state(folder / "state.json", "other.pdf", 12)
    assert files.load_state(folder / "none.json", "x", 1) == DocumentState.fresh("x", 1)
    (tmp_path / "book.md").write_text("all")
    (folder / "diagrams").mkdir()
    (folder / "diagrams/page_01_diagram_1.jpg").write_bytes(b"j")
    target = files.archive_pages(folder, {1, 3}, 12)
    assert target.name == "v1" and sorted(str(p.relative_to(target)) for p in target.rglob("*.*")) == ["book.md", "diagrams/page_01_diagram_1.jpg", "pages/page_01.md"]
    assert files.archive_pages(folder, {1}, 12) is None
    assert files.archive_pages(folder, {12}, 12).name == "v2"


def test_missing_pdf_library_is_named():
    with pytest.raises(pdf.PdfLibraryMissing):
        pdf._library()
