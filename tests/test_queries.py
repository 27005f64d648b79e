"""Registered queries against their SQL, and the entry points."""

import json

import pytest

import __spark_entry__
from pagewright.plans import registry
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    frame = registry.queries()[name](spark, SF)
    if name in registry.oracle_sql():
        assert_same(frame, con.sql(registry.oracle_sql()[name]))
    else:
        assert frame.count() > 0


def test_repaired_pages_has_diagrams_of_both_kinds(spark, con):
    shown = {r["doc_id"]: r["markdown"].count("](diagrams/page_1_diagram_") for r in registry.repaired_pages(spark, SF).collect()}
    n = dict(con.sql(f"select doc_id, case when doc_id % 3 = 1 and min(n) <= 2 then count(*) filter (n <= 2) else count(*) end from ({registry._BOXES}) group by doc_id").fetchall())
    assert all(count == (0 if d % 50 == 7 else n.get(d, 0)) for d, count in shown.items())
    assert any(count for d, count in shown.items() if d % 3 == 1) and any(count for d, count in shown.items() if d % 3 != 1)


def test_parsed_replies_read_each_text_and_box(spark, con, monkeypatch):
    seen = {}
    parse = registry.parse_replies
    monkeypatch.setattr(registry, "parse_replies", lambda rows: (seen.update((r["doc_id"], r["raw"]) for r in rows.collect()), parse(rows))[1])
    texts = dict(con.sql("select doc_id, text from documents").fetchall())
    for r in registry.parsed_replies(spark, SF).collect():
        d = r["doc_id"]
        held = json.loads(seen[d].removeprefix("```json\n").removesuffix("\n```"))
        assert held["text"] == "> " + texts[d]
        assert (r["error"] is None and r["n_boxes"] == d % 4 + 1) if d % 3 < 2 else "diagrams" in r["error"]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["heading_norm", "heading_clean"])
def test_heading_lines_read_whole_texts(spark, con, name):
    lines = con.sql("select count(*) from (select unnest(string_split(text, chr(10))) from documents)").fetchall()[0][0]
    frame = registry.queries()[name](spark, SF)
    assert frame.count() == lines
    longest = con.sql("select max(length(l)) from (select unnest(string_split(text, chr(10))) as l from documents)").fetchall()[0][0]
    column = name.split("_")[1]
    assert max(len(r[0]) for r in frame.select(column).collect()) >= longest - 4  # the ends may lose a mark
