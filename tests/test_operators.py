"""Facts, headings, pages and state on small fixtures."""

from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import facts, headings, pages, repair

SPANS = "doc_id long, page_num int, block_no int, line_no int, span_no int, text string, size double"


def test_heading_scale(spark):
    rows = [(1, 1, 0, 0, 0, "Title", 18.0), (1, 1, 0, 1, 0, "b" * 40, 11.0), (1, 1, 0, 2, 0, "Sub", 14.0), (1, 1, 0, 3, 0, "Footer", 12.0), (1, 1, 0, 4, 0, "  ", 30.0)]
    spans = spark.createDataFrame(rows, SPANS)
    assert [tuple(r) for r in headings.body_size(spans).collect()] == [(1, 11.0)]
    assert sorted(tuple(r) for r in headings.heading_scale(spans).collect()) == [(1, 14.0, 2), (1, 18.0, 1)]
    found = headings.page_headings(spans).first()["headings"]
    assert [tuple(h) for h in found] == [("title", 1), ("sub", 2)]


def test_ties_go_to_the_size_seen_first(spark):
    spans = spark.createDataFrame([(1, 1, 0, 0, 0, "ab", 9.0), (1, 1, 0, 0, 1, "cd", 12.0)], SPANS)
    assert headings.body_size(spans).first()["body_size"] == 9.0
    assert headings.dominant_sizes(spans).first()["size"] == 9.0


def test_enumerate_pages_without_pages(spark):
    found = facts.enumerate_pages(spark.createDataFrame([(1, 0), (2, 12)], "doc_id long, page_count int")).collect()
    assert len(found) == 12 and found[0]["stem"] == "page_01"


def test_clamp_and_trim(spark):
    long = lambda v: F.lit(v).cast("long")
    box = T.clamp_box(long(-10), long(5), T.trim_extent(long(100)), T.trim_extent(long(200)), long(80), long(150))
    assert tuple(spark.range(1).select(box).first()[0]) == (0, 5, 80, 150)


def test_trim_cuts_towards_zero(spark):
    values = [-3, -1, 0, 1, 3, 20, None]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v long").orderBy("i")
    assert [r[0] for r in frame.select(T.trim_extent(F.col("v"))).collect()] == [int((v or 0) * 0.95) for v in values]


def test_combine(spark):
    rows = [(1, 2, False, "x"), (1, 3, True, "![d](diagrams/p.jpg)"), (1, 1, True, "A"), (2, 1, True, None)]
    frame = spark.createDataFrame(rows, "doc_id long, page_num int, ocr_done boolean, markdown string")
    found = dict(tuple(r) for r in pages.combine(frame, F.lit("out")).collect())
    assert found == {1: "--- PAGE 1 ---\nA\n\n--- PAGE 3 ---\n![d](out/diagrams/p.jpg)", 2: "--- PAGE 1 ---\n"}


def test_state_latest_wins_and_gates(spark):
    schema = "doc_id long, page_num int, version long, image_done boolean, image_failed boolean, ocr_done boolean, ocr_failed boolean, diagram_count int, ocr_response string"
    log = spark.createDataFrame([(1, 1, 1, True, False, False, False, 0, None), (1, 1, 2, True, False, False, True, 0, None), (2, 1, 1, False, True, False, False, 0, None)], schema)
    state = pages.latest_state(log)
    documents = spark.createDataFrame([(1, False), (2, False), (3, False)], "doc_id long, combined_done boolean")
    gates = {r[0]: tuple(r)[1:] for r in pages.failure_gates(state, documents).collect()}
    assert gates == {1: (False, True), 2: (True, False), 3: (True, False)}
    assert dict(tuple(r) for r in pages.run_status(state, documents).collect()) == {1: "partial", 2: "partial", 3: "not_started"}


def test_comments_and_links(spark):
    annots = spark.createDataFrame([(1, 1, 0, "Text", None, " hi  you "), (1, 1, 1, "Ink", "a", "no"), (1, 1, 2, "Highlight", "Ann", "x"), (1, 1, 3, "Text", "b", " ")], "doc_id long, page_num int, annot_no int, type string, title string, content string")
    assert facts.page_comments(annots).first()["comments"] == "## Comments\n\n- **Unknown** (Text): hi you\n- **Ann** (Highlight): x"
    links = spark.createDataFrame([(1, 1, 0, "uri", "u2", 0.0, 2.4, "b"), (1, 1, 1, "uri", "u1", 5.0, 2.2, " a  c "), (1, 1, 2, "goto", "x", 0.0, 0.0, "n"), (1, 1, 3, "uri", "", 0.0, 0.0, "n")], "doc_id long, page_num int, link_no int, kind string, uri string, x0 double, y0 double, anchor string")
    assert [tuple(x) for x in facts.page_links(links).first()["links"]] == [("b", "u2"), ("a c", "u1")]


def test_splice_tables_by_position_equals_fold(spark):
    texts = ["x\n| a |\n|---|\ny\n| b |", "| a |", "none", "", "\t| a\n | b\nz\n|c", "x\n\u00a0| a |\n\u2003|b"]
    for tables in (["T1\nT1b", "T2"], ["T1"], [], ["1", "2", "3"]):
        frame = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc_id long, page_num int, text string")
        listed = spark.createDataFrame([(i, 1, tables) for i in range(len(texts))], "doc_id long, page_num int, tables array<string>")
        found = {r["doc_id"]: r["text"] for r in repair.splice_tables_by_position(frame, listed).collect()}
        assert found == {i: repair.L.splice_tables(t, tables) for i, t in enumerate(texts)}


def test_registered_folds(spark):
    repair.register(spark)
    assert spark.sql("SELECT md_normalise_lists(md_reflow('a\nb\n* c'))").first()[0] == "a b\n- c"
