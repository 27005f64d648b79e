"""Named queries over the driver's tables, with DuckDB SQL for the same results.

The driver's tables hold no page facts, so each query derives its facts from them by
plain expressions, which its SQL repeats, and then applies an operator of this package.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import facts, headings, pages, repair
from pagewright.sources.recognition import parse_replies

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        _QUERIES[function.__name__] = function
        if sql:
            _ORACLES[function.__name__] = sql
        return function

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- facts derived from the driver's tables -------------------------------------------------

_TURNS = """
SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page_num, role <> 'system' AS ocr_done,
  CASE WHEN turn % 5 = 4 THEN NULL ELSE text || ' ![Diagram 1](diagrams/page_' || CAST(turn AS VARCHAR(20)) || '_diagram_1.jpg)' END AS markdown
FROM conversations
"""
_LOG = """
SELECT CAST(user_id % 200 AS BIGINT) AS doc_id, CAST(event_id % 40 + 1 AS INT) AS page_num, event_id AS version,
  event_id % 5 <> 0 AS image_done, event_id % 10 = 0 AS image_failed,
  event_id % 5 <> 0 AND event_id % 3 = 0 AS ocr_done, event_id % 5 <> 0 AND event_id % 3 <> 0 AND event_id % 7 = 0 AS ocr_failed,
  CAST(event_id % 4 AS INT) AS diagram_count, CAST(NULL AS VARCHAR(20)) AS ocr_response
FROM events
"""
_SPANS = """
SELECT l_orderkey AS doc_id, CAST(1 + l_linenumber % 2 AS INT) AS page_num, CAST(0 AS INT) AS block_no, CAST(l_linenumber % 3 AS INT) AS line_no,
  CAST(l_linenumber AS BIGINT) * 10000000000 + l_partkey * 10000 + l_suppkey AS span_no, CASE WHEN l_suppkey % 11 = 0 THEN '  ' ELSE ' ' || repeat(l_returnflag || 'x', CAST(l_linenumber AS INT)) || '. ' END AS text,
  CAST(8 + l_partkey % 6 AS DOUBLE) AS size
FROM lineitem
"""
_LINES = """
SELECT doc_id, CAST(1 AS INT) AS page_num, text FROM documents
"""


def _view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The SQL over the tables it names, without registering anything."""
    names = [n for n in ("conversations", "events", "lineitem", "documents", "orders", "pages", "part") if f"FROM {n}" in sql]
    return spark.sql(sql.replace(f"FROM {names[0]}", "FROM {source}").replace("VARCHAR(20)", "STRING"), source=_read(spark, sf_dir, names[0]))


_LATEST = f"""
SELECT doc_id, page_num, image_done, image_failed, ocr_done, ocr_failed, diagram_count
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY version DESC) AS rn FROM ({_LOG})) WHERE rn = 1
"""


# --- assembly and state ----------------------------------------------------------------------

@_query(f"""
SELECT doc_id, string_agg('--- PAGE ' || page_num || ' ---' || chr(10) || replace(coalesce(markdown, ''), '](diagrams/', '](book/diagrams/'),
  chr(10) || chr(10) ORDER BY page_num) AS markdown
FROM ({_TURNS}) WHERE ocr_done GROUP BY doc_id
""")
def combine_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.combine(_view(spark, sf_dir, _TURNS), F.lit("book"))


@_query("""
SELECT doc_id, page_count, page_num, 'page_' || lpad(CAST(page_num AS VARCHAR), CAST(length(CAST(page_count AS VARCHAR)) AS INT), '0') AS stem
FROM (SELECT doc_id, page_count, CAST(unnest(range(1, page_count + 1)) AS INT) AS page_num FROM (SELECT doc_id, CAST(n_chars % 12 AS INT) AS page_count FROM documents))
""")
def page_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 12).cast("int").alias("page_count"))
    return facts.enumerate_pages(documents)


@_query(_LATEST)
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.latest_state(_view(spark, sf_dir, _LOG)).drop("ocr_response")


@_query(f"SELECT doc_id, page_num FROM ({_LATEST}) WHERE NOT image_done AND NOT image_failed")
def pending_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.pending_render(pages.latest_state(_view(spark, sf_dir, _LOG))).select("doc_id", "page_num")


@_query(f"SELECT doc_id, page_num FROM ({_LATEST}) WHERE image_done AND NOT ocr_done AND NOT ocr_failed")
def pending_recognition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.pending_recognition(pages.latest_state(_view(spark, sf_dir, _LOG))).select("doc_id", "page_num")


@_query(f"""
SELECT doc_id, count(*) AS pages, count(*) FILTER (image_done) AS image_done, count(*) FILTER (image_failed) AS image_failed,
  count(*) FILTER (ocr_done) AS ocr_done, count(*) FILTER (ocr_failed) AS ocr_failed
FROM ({_LATEST}) GROUP BY doc_id
""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.run_summary(pages.latest_state(_view(spark, sf_dir, _LOG)), "doc_id")


@_query(f"""
SELECT d.doc_id, CASE WHEN d.doc_id % 10 = 0 THEN 'complete' WHEN t.touched THEN 'partial' ELSE 'not_started' END AS status
FROM (SELECT DISTINCT o_custkey % 300 AS doc_id FROM orders) d
LEFT JOIN (SELECT doc_id, bool_or(image_done OR image_failed OR ocr_done OR ocr_failed) AS touched FROM ({_LATEST}) GROUP BY doc_id) t ON t.doc_id = d.doc_id
""")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "orders").select((F.col("o_custkey") % 300).alias("doc_id")).distinct().withColumn("combined_done", F.col("doc_id") % 10 == 0)
    return pages.run_status(pages.latest_state(_view(spark, sf_dir, _LOG)), documents)


@_query(f"""
SELECT d.doc_id, coalesce(bool_and(s.image_failed), true) AS all_renders_failed,
  coalesce(bool_and(s.ocr_failed) FILTER (s.image_done), false) AS all_recognition_failed
FROM (SELECT DISTINCT o_custkey % 300 AS doc_id FROM orders) d LEFT JOIN ({_LATEST}) s ON s.doc_id = d.doc_id GROUP BY d.doc_id
""")
def failure_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "orders").select((F.col("o_custkey") % 300).alias("doc_id")).distinct()
    return pages.failure_gates(pages.latest_state(_view(spark, sf_dir, _LOG)), documents)


@_query(f"""
SELECT p.doc_id, p.page_num, coalesce(s.image_done, false) AS image_done, coalesce(s.ocr_done, false) AS ocr_done, coalesce(s.diagram_count, 0) AS diagram_count
FROM ({_TURNS}) p LEFT JOIN ({_LATEST}) s ON s.doc_id = p.doc_id AND s.page_num = p.page_num
""")
def page_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _view(spark, sf_dir, _TURNS).select("doc_id", "page_num")
    joined = pages.with_state(turns, pages.latest_state(_view(spark, sf_dir, _LOG)))
    return joined.select("doc_id", "page_num", "image_done", "ocr_done", "diagram_count")


@_query(f"""
SELECT doc_id, page_num, true AS found FROM ({_TURNS}) WHERE page_num IN (2, 4, 5, 6)
UNION ALL SELECT NULL, w, false FROM (SELECT CAST(unnest([2, 4, 5, 6, 90]) AS INT) AS w) WHERE w NOT IN (SELECT page_num FROM ({_TURNS}))
""")
def rerun_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.sources.config import parse_page_spec

    wanted = spark.range(1).select(F.explode(F.array(*(F.lit(n) for n in sorted(parse_page_spec("2, 4-6,5,90"))))).alias("page_num"))
    chosen, absent = pages.choose_pages(_view(spark, sf_dir, _TURNS).select("doc_id", "page_num"), wanted)
    none = absent.select(F.lit(None).cast("long").alias("doc_id"), "page_num", F.lit(False).alias("found"))
    return chosen.withColumn("found", F.lit(True)).unionByName(none)


@_query("""
SELECT doc_id, CAST(turn + 1 AS INT) AS page_num, CASE turn % 3 WHEN 0 THEN 'a,b,c' WHEN 1 THEN 'b,c,a' ELSE 'c,a,b' END AS instances
FROM (SELECT conv_id AS doc_id, turn FROM conversations)
""")
def instance_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _view(spark, sf_dir, _TURNS).select("doc_id", "page_num")
    return turns.withColumn("instances", F.array_join(T.rotate(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.col("page_num")), ","))


@_query("""
SELECT coalesce(max(TRY_CAST(substr(name, 2) AS BIGINT)) FILTER (regexp_full_match(name, 'v[0-9]+')), 0) + 1 AS version
FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'x' || p_size WHEN p_partkey % 3 = 1 THEN 'v' || p_size || 'b' ELSE 'v' || p_size END AS name FROM part)
""")
def archive_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("x"), size)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("v"), size, F.lit("b")))
    return pages.next_archive(_read(spark, sf_dir, "part").select(name.otherwise(F.concat(F.lit("v"), size)).alias("name")))


# --- headings --------------------------------------------------------------------------------

_SIZED = f"""
SELECT doc_id, size, CAST(sum(length(trim(text))) AS BIGINT) AS chars, min(CAST(page_num AS BIGINT) * 100000000000000 + CAST(line_no AS BIGINT) * 1000000000000 + span_no) AS place
FROM ({_SPANS}) WHERE trim(text) <> '' GROUP BY doc_id, size
"""
_BODY = f"SELECT doc_id, size AS body_size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, place) AS rn FROM ({_SIZED})) WHERE rn = 1"
_SCALE = f"""
SELECT s.doc_id, s.size, CAST(least(dense_rank() OVER (PARTITION BY s.doc_id ORDER BY s.size DESC), 6) AS INT) AS level
FROM ({_SIZED}) s JOIN ({_BODY}) b ON b.doc_id = s.doc_id WHERE s.size >= CAST(1.15 AS DOUBLE) * b.body_size
"""
_DOMINANT = f"""
SELECT doc_id, page_num, block_no, line_no, size, text FROM (
  SELECT doc_id, page_num, block_no, line_no, size, row_number() OVER (PARTITION BY doc_id, page_num, block_no, line_no ORDER BY w DESC, first) AS rn
  FROM (SELECT doc_id, page_num, block_no, line_no, size, sum(length(trim(text))) AS w, min(span_no) AS first FROM ({_SPANS}) WHERE trim(text) <> '' GROUP BY ALL))
JOIN (SELECT doc_id, page_num, block_no, line_no, string_agg(text, '' ORDER BY span_no) AS text FROM ({_SPANS}) GROUP BY ALL) USING (doc_id, page_num, block_no, line_no)
WHERE rn = 1
"""


@_query(f"SELECT doc_id, size, chars FROM ({_SIZED})")
def font_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.font_histogram(_view(spark, sf_dir, _SPANS)).drop("first_place")


@_query(_BODY)
def body_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.body_size(_view(spark, sf_dir, _SPANS))


@_query(_SCALE)
def heading_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.heading_scale(_view(spark, sf_dir, _SPANS))


@_query(_DOMINANT)
def dominant_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.dominant_sizes(_view(spark, sf_dir, _SPANS))


@_query(f"""
SELECT d.doc_id, d.page_num, string_agg(c.level || ':' || trim(lower(trim(regexp_replace(d.text, '\\s+', ' ', 'g'))), '.,:;!?-—–'), '|' ORDER BY block_no, line_no) AS headings
FROM ({_DOMINANT}) d JOIN ({_SCALE}) c ON c.doc_id = d.doc_id AND c.size = d.size GROUP BY d.doc_id, d.page_num
""")
def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = headings.page_headings(_view(spark, sf_dir, _SPANS))
    return found.select("doc_id", "page_num", F.array_join(F.transform("headings", lambda h: F.concat(h["level"].cast("string"), F.lit(":"), h["norm"])), "|").alias("headings"))


_HEADING_LINES = """
SELECT doc_id, n, CASE n % 4 WHEN 0 THEN '## **' || line || ':**' WHEN 1 THEN '#  _' || line || '_ ' WHEN 2 THEN '- ' || line || ' * x' ELSE '**a *b** ' || line END AS line
FROM (SELECT doc_id, CAST(i AS INT) AS n, line FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))
"""


def _heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("n", F.col("i") + 1)
    around = [("## **", ":**"), ("#  _", "_ "), ("- ", " * x"), ("**a *b** ", "")]
    made = [F.concat(F.lit(a), "line", F.lit(b)) for a, b in around]
    line = F.when(F.col("n") % 4 == 0, made[0]).when(F.col("n") % 4 == 1, made[1]).when(F.col("n") % 4 == 2, made[2]).otherwise(made[3])
    return rows.select("doc_id", "n", line.alias("line"))


@_query(f"""
SELECT doc_id, n, trim(lower(trim(regexp_replace(regexp_replace(line, '[#*_`]+', '', 'g'), '\\s+', ' ', 'g'))), '.,:;!?-—–') AS norm FROM ({_HEADING_LINES})
""")
def heading_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heading_lines(spark, sf_dir).select("doc_id", "n", T.norm_heading(F.col("line")).alias("norm"))


@_query(f"""
SELECT doc_id, n, trim(coalesce(nullif(regexp_extract(b, '^(?:\\*{{1,3}}([^*]+)\\*{{1,3}})$', 1), ''), nullif(regexp_extract(b, '^(?:_{{1,3}}([^_]+)_{{1,3}})$', 1), ''), b)) AS clean
FROM (SELECT doc_id, n, trim(regexp_replace(line, '^[ \\t]*#{{1,6}}[ \\t]+', '')) AS b FROM ({_HEADING_LINES}))
""")
def heading_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heading_lines(spark, sf_dir).select("doc_id", "n", T.clean_heading(F.col("line")).alias("clean"))


# --- tables, links, comments, diagrams ---------------------------------------------------------

_CELLS = """
SELECT o_custkey AS doc_id, o_orderkey AS n, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE ' ' || o_orderpriority || '  x ' END AS a,
  o_orderstatus || '|' || CAST(o_orderkey AS VARCHAR(20)) AS b, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR(20)) END AS c
FROM orders
"""


@_query(f"""
WITH rows AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS r, trim(regexp_replace(coalesce(a, ''), '\\s+', ' ', 'g')) AS a,
  replace(b, '|', '\\|') AS b, c FROM ({_CELLS})),
sized AS (SELECT doc_id, max(length(a)) AS wa, max(length(b)) AS wb, coalesce(max(length(c)), 0) AS wc, count(c) > 0 AS three FROM rows GROUP BY doc_id),
lines AS (SELECT r.doc_id, r.r, '| ' || rpad(r.a, CAST(wa AS INT), ' ') || ' | ' || rpad(r.b, CAST(wb AS INT), ' ') || CASE WHEN three THEN ' | ' || rpad(coalesce(r.c, ''), CAST(wc AS INT), ' ') ELSE '' END || ' |' AS line,
  '|' || repeat('-', CAST(wa + 2 AS INT)) || '|' || repeat('-', CAST(wb + 2 AS INT)) || '|' || CASE WHEN three THEN repeat('-', CAST(wc + 2 AS INT)) || '|' ELSE '' END AS rule FROM rows r JOIN sized USING (doc_id))
SELECT doc_id, string_agg(CASE WHEN r = 1 THEN line || chr(10) || rule ELSE line END, chr(10) ORDER BY r) AS markdown FROM lines GROUP BY doc_id
""")
def render_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.when(F.col("c").isNull(), F.array("a", "b")).otherwise(F.array("a", "b", "c"))
    rows = _view(spark, sf_dir, _CELLS).select("doc_id", F.struct("n", cells.alias("cells")).alias("row"))
    grouped = rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["cells"]).alias("rows"))
    return grouped.select("doc_id", T.render_table(F.col("rows")).alias("markdown"))


@_query("""
SELECT doc_id, string_agg(md, '&' ORDER BY round_even(y, 0), round_even(x, 0), n) AS tables FROM (
  SELECT l_orderkey AS doc_id, l_linenumber * 1000000 + l_partkey AS n, l_linenumber, l_quantity / 4 AS y, l_tax * 30 AS x, '| ' || l_shipmode || ' |' || chr(10) || '|' || repeat('-', length(l_shipmode) + 2) || '|' AS md
  FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) WHERE l_linenumber % 4 <> 0)
GROUP BY doc_id
""")
def tables_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.when(F.col("l_linenumber") % 4 != 0, F.array(F.array(F.concat("l_returnflag", "l_linestatus")))).otherwise(F.array().cast("array<array<string>>"))
    tables = _read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_num"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("table_no"), (F.col("l_quantity") / 4).alias("y0"), (F.col("l_tax") * 30).alias("x0"), rows.alias("rows")
    )
    return facts.page_tables(tables).select("doc_id", F.array_join("tables", "&").alias("tables"))


@_query("""
WITH lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n([A-M])', chr(10) || '| \\1', 'g'), chr(10)) AS l FROM documents)),
marked AS (SELECT *, starts_with(ltrim(line), '|') AS p FROM lines),
runs AS (SELECT *, p AND NOT coalesce(lag(p) OVER w, false) AS s FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT *, sum(CAST(s AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS b, sum(CAST(s AS INT)) OVER (PARTITION BY doc_id) AS blocks FROM runs),
body AS (SELECT doc_id, any_value(blocks) AS blocks, string_agg(CASE WHEN p AND b <= 2 THEN 'T' || b ELSE line END, chr(10) ORDER BY i) FILTER (NOT p OR b > 2 OR s) AS text FROM numbered GROUP BY doc_id)
SELECT doc_id, text || CASE WHEN blocks = 0 THEN repeat(chr(10), 2) || 'T1' || repeat(chr(10), 2) || 'T2' WHEN blocks = 1 THEN repeat(chr(10), 2) || 'T2' ELSE '' END AS text FROM body
""")
def splice_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _read(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_num"), F.regexp_replace("text", "\n([A-M])", "\n| $1").alias("text"))
    tables = texts.select("doc_id", "page_num", F.array(F.lit("T1"), F.lit("T2")).alias("tables"))
    return repair.splice_tables_by_position(texts, tables).select("doc_id", "text")


@_query("""
SELECT page_id, CAST(n AS INT) AS link_no, regexp_replace(trim(regexp_replace(a, '\\s+', ' ', 'g')), '([\\\\\\[\\]])', '\\\\\\1', 'g') AS anchor, regexp_replace(u, '([\\\\()])', '\\\\\\1', 'g') AS uri
FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS u, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS a,
  generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1), 1) - 1 AS n FROM pages)
WHERE u <> '' AND trim(a) <> ''
""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = F.lit('<a href="([^"]*)">([^<]*)</a>')
    found = F.arrays_zip(F.regexp_extract_all("html", pattern, F.lit(1)).alias("uri"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("anchor"))
    rows = _read(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("link_no", "l")).select(
        "page_id", "link_no", F.lit("uri").alias("kind"), "l.uri", "l.anchor", F.lit(0.0).alias("x0"), F.col("link_no").cast("double").alias("y0")
    )
    return facts.usable_links(rows).select("page_id", "link_no", T.escape_anchor(F.col("anchor")).alias("anchor"), T.escape_uri(F.col("uri")).alias("uri"))


_ANNOTS = """
SELECT user_id AS doc_id, CAST(1 AS INT) AS page_num, event_id AS annot_no, CASE event_id % 4 WHEN 0 THEN 'Text' WHEN 1 THEN 'Highlight' WHEN 2 THEN 'Link' ELSE 'Ink' END AS type,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE ' ' || event_type || '  by  x' END AS title, CASE WHEN event_id % 5 = 0 THEN ' ' ELSE event_type || '   ' || CAST(event_id AS VARCHAR(20)) END AS content
FROM events
"""


@_query(f"""
SELECT doc_id, '## Comments' || chr(10) || chr(10) || string_agg('- **' || coalesce(nullif(trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g')), ''), 'Unknown') || '** (' || type || '): '
  || trim(regexp_replace(content, '\\s+', ' ', 'g')), chr(10) ORDER BY annot_no) AS comments
FROM ({_ANNOTS}) WHERE type IN ('Text', 'FreeText', 'Highlight', 'Underline', 'StrikeOut', 'Squiggly') AND trim(content) <> '' GROUP BY doc_id
""")
def comments_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.page_comments(_view(spark, sf_dir, _ANNOTS)).select("doc_id", "comments")


_BOXES = """
SELECT l_orderkey AS doc_id, l_linenumber AS n, CAST(l_partkey % 300 - 50 AS BIGINT) AS x, CAST(l_suppkey % 200 - 40 AS BIGINT) AS y,
  CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE CAST(floor(l_quantity * 13) AS BIGINT) END AS w, CAST(floor(l_extendedprice) AS BIGINT) % 900 AS h
FROM lineitem
"""


@_query(f"""
SELECT doc_id, n, greatest(0, x) AS x0, greatest(0, y) AS y0, least(400, x + CAST(trunc(coalesce(w, 0) * CAST(0.95 AS DOUBLE)) AS BIGINT)) AS x1,
  least(500, y + CAST(trunc(h * CAST(0.95 AS DOUBLE)) AS BIGINT)) AS y1 FROM ({_BOXES})
""")
def bbox_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.lit(400).cast("long"), F.lit(500).cast("long")
    box = T.clamp_box(F.col("x"), F.col("y"), T.trim_extent(F.col("w")), T.trim_extent(F.col("h")), *wide)
    return _view(spark, sf_dir, _BOXES).select("doc_id", "n", box.alias("b")).select("doc_id", "n", "b.*")


@_query(f"""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 WHEN doc_id % 3 = 1 THEN 2 ELSE n END AS crops, doc_id % 3 = 1 AS from_source,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE list_aggregate(list_transform(range(1, CASE WHEN doc_id % 3 = 1 THEN 3 ELSE n + 1 END),
    lambda i: '![Diagram ' || i || '](diagrams/page_02_diagram_' || i || '.jpg)'), 'string_agg', ' ') END AS refs
FROM (SELECT doc_id, CAST(count(*) AS INT) AS n FROM ({_BOXES}) GROUP BY doc_id)
""")
def diagram_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.struct(*(F.col(a).cast("double").alias(b) for a, b in (("x", "x"), ("y", "y"), ("w", "width"), ("h", "height"))))
    grouped = _view(spark, sf_dir, _BOXES).groupBy("doc_id").agg(F.collect_list(box).alias("all"))
    rect = F.struct(*(F.lit(float(v)).alias(c) for c, v in (("x0", 0), ("y0", 0), ("x1", 9), ("y1", 9))))
    rows = grouped.select(
        "doc_id",
        F.lit(2).alias("page_num"),
        F.lit(12).alias("page_count"),
        F.when(F.col("doc_id") % 3 != 0, F.col("all")).alias("boxes"),
        F.when(F.col("doc_id") % 3 == 1, F.array(rect, rect)).alias("rects"),
    )
    return pages.diagrams(rows).select("doc_id", F.size("crops").alias("crops"), "from_source", F.array_join("references", " ").alias("refs"))


@_query("SELECT doc_id, base64(encode(text)) AS payload FROM documents")
def base64_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", T.base64_payload(F.encode("text", "UTF-8")).alias("payload"))


@_query("""
SELECT doc_id, NOT (has_text OR has_drawings) AND ratio >= CAST(0.999 AS DOUBLE) AS blank
FROM (SELECT doc_id, n_chars % 3 = 0 AS has_text, coalesce(n_chars % 7 = 0, false) AS has_drawings, CASE WHEN n_chars % 2 = 0 THEN CAST(0.999 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS ratio FROM documents)
""")
def blank_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    rows = _read(spark, sf_dir, "documents").select("doc_id", (n % 3 == 0).alias("has_text"), (n % 7 == 0).alias("has_drawings"), F.when(n % 2 == 0, 0.999).otherwise(0.9).alias("white_ratio"))
    return rows.select("doc_id", facts.blank_pages(rows).alias("blank"))


@_query("""
SELECT doc_id, string_agg(CAST(x AS INT) || ',' || CAST(y AS INT), ' ' ORDER BY round_even(y, 0), round_even(x, 0), n) AS rects
FROM (SELECT l_orderkey AS doc_id, l_linenumber * 1000000 + l_partkey AS n, l_linenumber, l_quantity / 4 AS y, l_tax * 30 AS x FROM lineitem) GROUP BY doc_id
""")
def image_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, x = F.col("l_quantity") / 4, F.col("l_tax") * 30
    rows = _read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_num"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("rect_no"), x.alias("x0"), y.alias("y0"), x.alias("x1"), y.alias("y1")
    )
    text = lambda r: F.concat(F.rint(r["x0"]).cast("int").cast("string"), F.lit(","), F.rint(r["y0"]).cast("int").cast("string"))
    return facts.page_image_rects(rows).select("doc_id", F.array_join(F.transform("rects", text), " ").alias("rects"))


# --- lines ---------------------------------------------------------------------------------------

_REF = "regexp_full_match(w, '[.…]*[0-9]{1,4}') OR (length(ltrim(w, '.…')) >= 2 AND regexp_full_match(ltrim(w, '.…'), 'l?x{0,3}(ix|iv|v?i{0,3})'))"


@_query(f"""
SELECT doc_id, CAST(count(*) AS BIGINT) AS tokens, count(*) FILTER ({_REF}) AS refs
FROM (SELECT doc_id, unnest(string_split(replace(text, chr(10), ' ') || ' ' || '..' || doc_id || ' xiv', ' ')) AS w FROM documents) GROUP BY doc_id
""")
def page_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(" .."), F.col("doc_id").cast("string"), F.lit(" xiv"))
    tokens = _read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(text, " ")).alias("w"))
    return tokens.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tokens"), F.count_if(T.is_page_ref(F.col("w"))).alias("refs"))


_TAIL = "regexp_extract(line, '^[ \\t]*\\S.*\\s(\\S+?)[ \\t]*$', 1)"
_CUT = "SELECT doc_id, CAST(i AS INT) AS n, CASE WHEN i % 4 = 0 THEN line || ' ' || doc_id ELSE line END AS line FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


def _numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("n", F.col("i") + 1).drop("i")
    return rows.withColumn("line", F.when(F.col("n") % 4 == 0, F.concat("line", F.lit(" "), F.col("doc_id").cast("string"))).otherwise(F.col("line")))


@_query(f"SELECT doc_id, n, line FROM (SELECT *, {_TAIL} AS w FROM ({_CUT})) WHERE w <> '' AND ({_REF})")
def index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered_lines(spark, sf_dir).filter(T.is_index_entry(F.col("line"))).select("doc_id", "n", "line")


_BOUNDARY = r"""(trim(line) = '' OR regexp_matches(line, '^[ \t]*([-*+]|[0-9]+[.)]|[A-Za-z][.)]|[ivxlcdmIVXLCDM]+[.)])[ \t]+\S') OR regexp_matches(line, '^[ \t]*[|>]')
  OR regexp_matches(line, '^[ \t]*#{1,6}[ \t]') OR regexp_matches(line, '^[ \t]*(`{3,}|~{3,})')
  OR regexp_matches(line, '^[ \t]*(-([ \t]*-){2,}|\*([ \t]*\*){2,}|_([ \t]*_){2,})[ \t]*$'))"""


@_query(f"SELECT doc_id, n, line FROM (SELECT *, {_TAIL} AS w FROM ({_CUT})) WHERE {_BOUNDARY} OR w <> '' AND ({_REF})")
def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered_lines(spark, sf_dir).filter(T.is_boundary(F.col("line"))).select("doc_id", "n", "line")


_PLAIN = "SELECT doc_id, CAST(i AS INT) AS n, line FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


@_query(f"""
WITH marked AS (SELECT *, {_BOUNDARY} OR (w <> '' AND ({_REF})) AS b FROM (SELECT *, {_TAIL} AS w FROM ({_PLAIN}))),
runs AS (SELECT *, sum(CASE WHEN b OR coalesce(lag_b, true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS g
  FROM (SELECT *, lag(b) OVER (PARTITION BY doc_id ORDER BY n) AS lag_b FROM marked)),
joined AS (SELECT doc_id, g, string_agg(CASE WHEN b THEN line ELSE trim(line) END, ' ' ORDER BY n) AS line FROM runs GROUP BY doc_id, g)
SELECT doc_id, string_agg(line, chr(10) ORDER BY g) AS text FROM joined GROUP BY doc_id
""")
def reflow_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, _LINES).select("doc_id", repair.reflow("text").alias("text"))


_FENCED = "CASE WHEN i % 5 = 1 THEN '```' WHEN i % 7 = 3 THEN '~~~~' WHEN i % 11 = 4 THEN '``` x' ELSE line END"


@_query("""
SELECT doc_id, split_part(list_reduce(l, lambda acc, x: CASE
    WHEN split_part(acc, '|', 1) = '' THEN regexp_extract(x, '^[ \\t]*(`{3,}|~{3,})', 1) || '|' || split_part(acc, '|', 2) || CASE WHEN regexp_matches(x, '^[ \\t]*(`{3,}|~{3,})') THEN '1' ELSE '0' END
    WHEN trim(x) <> '' AND trim(x) = regexp_extract(x, '^[ \\t]*(`{3,}|~{3,})', 1) AND x[1] = acc[1] AND length(trim(x)) >= length(split_part(acc, '|', 1)) THEN '|' || split_part(acc, '|', 2) || '1'
    ELSE acc || '1' END, '|'), '|', 2) AS code
FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda line, i: CASE WHEN i % 5 = 1 THEN '```' WHEN i % 7 = 3 THEN '~~~~' WHEN i % 11 = 4 THEN '``` x' ELSE line END) AS l FROM documents)
""")
def fence_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = lambda x, i: F.when((i + 1) % 5 == 1, "```").when((i + 1) % 7 == 3, "~~~~").when((i + 1) % 11 == 4, "``` x").otherwise(x)
    lines = _read(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", "\n"), line).alias("lines"))
    return lines.select("doc_id", F.array_join(F.transform(T.fence_states(F.col("lines")), lambda b: b.cast("int").cast("string")), "").alias("code"))


@_query("""
WITH marked AS (SELECT doc_id, i, starts_with(ltrim(line), '|') AS p FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
  FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n([A-M])', chr(10) || '| \\1', 'g'), chr(10)) AS l FROM documents)))
SELECT doc_id, CAST(min(i) - 1 AS INT) AS first_line, CAST(max(i) AS INT) AS end_line FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked WHERE p) GROUP BY doc_id, g
""")
def table_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    texts = _read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "\n([A-M])", "\n| $1").alias("text"))
    lines = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).filter(T.is_table_row(F.col("line")))
    run = lines.withColumn("g", F.col("i") - F.row_number().over(W.partitionBy("doc_id").orderBy("i")))
    return run.groupBy("doc_id", "g").agg(F.min("i").alias("first_line"), (F.max("i") + 1).alias("end_line")).drop("g")


# --- folds; tests compare those without SQL with worked cases ---------------------------

@_query("""
SELECT doc_id, list_aggregate(list_transform(l, lambda x, i: CASE WHEN i = 1 THEN regexp_replace(x, '^3\\.[ \\t]+(\\S)', '1. \\1')
  WHEN regexp_matches(x, '^  \\*[ \\t]+\\S') THEN CASE WHEN regexp_matches(l[1], '^3\\.[ \\t]+\\S') THEN '   - ' ELSE '- ' END || regexp_replace(x, '^  \\*[ \\t]+', '') ELSE x END), 'string_agg', chr(10)) AS text
FROM (SELECT doc_id, string_split('3. ' || replace(text, chr(10), chr(10) || '  * '), chr(10)) AS l FROM documents)
""")
def normalised_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.regexp_replace("text", "\n", "\n  * ")
    return _read(spark, sf_dir, "documents").select("doc_id", repair.normalise_lists(F.concat(F.lit("3. "), listed)).alias("text"))


@_query(f"""
WITH lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, string_split('Alpha ii Beta iv Gamma 7' || chr(10) || text, chr(10)) AS l FROM documents)),
tokens AS (SELECT *, list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '') AS t FROM lines),
refs AS (SELECT *, list_filter(range(1, len(t) + 1), lambda i: list_transform([t[i]], lambda w: {_REF})[1]) AS p FROM tokens),
runs AS (SELECT *, len(p) >= 3 AND p[-1] = len(t) AND list_max(list_transform(p, lambda e, j: e - CASE WHEN j = 1 THEN 0 ELSE p[j - 1] END)) <= 14 AS run FROM refs)
SELECT doc_id, string_agg(CASE WHEN run THEN list_aggregate(list_transform(p, lambda e, j: list_aggregate(t[CASE WHEN j = 1 THEN 1 ELSE p[j - 1] + 1 END:e], 'string_agg', ' ')), 'string_agg', chr(10))
  ELSE line END, chr(10) ORDER BY n) AS text FROM runs GROUP BY doc_id
""")
def split_index_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = F.concat(F.lit("Alpha ii Beta iv Gamma 7\n"), F.col("text"))
    return _read(spark, sf_dir, "documents").select("doc_id", repair.split_index_runs(run).alias("text"))


@_query()
def spliced_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.slice(F.split(F.col("text"), "[ \n]"), 2, 3)
    links = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.struct(w.alias("anchor"), F.concat(F.lit("https://x.example/"), w).alias("uri")))
    return _read(spark, sf_dir, "documents").select("doc_id", repair.splice_links("text", links).alias("text"))


@_query()
def fixed_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.array(F.struct(T.norm_heading(F.element_at(F.split("text", "\n"), 1)).alias("norm"), F.lit(2).alias("level")))
    return _read(spark, sf_dir, "documents").select("doc_id", repair.fix_headings("text", found, F.lit(True)).alias("text"))


@_query("""
SELECT doc_id, CAST(1 AS INT) AS page_num, CASE WHEN doc_id % 3 < 2 THEN list_aggregate(list_transform(string_split(regexp_replace('> ' || text, '\\n$', ''), chr(10)), lambda x: regexp_replace(x, '^> ', '')), 'string_agg', chr(10)) END AS text,
  CASE WHEN doc_id % 3 < 2 THEN CAST(doc_id % 4 + 1 AS INT) END AS n_boxes, CASE WHEN doc_id % 3 = 2 THEN '''text'' or ''diagrams'' is missing' END AS error
FROM documents
""")
def parsed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = F.concat(F.lit("> "), F.col("text")).alias("text")
    box = lambda i: F.struct((i * 10).alias("x"), (F.col("n_chars") % 700).alias("y"), F.col("n_chars").alias("width"), i.alias("height"))
    body = F.to_json(F.struct(quoted, F.transform(F.sequence(F.lit(1), F.col("doc_id") % 4 + 1), box).alias("diagrams")))
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("doc_id") % 3 == 1, body).otherwise(F.to_json(F.struct(quoted)))  # malformed: no diagrams
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_num"), raw.alias("raw"))
    return parse_replies(rows).select("doc_id", "page_num", "text", F.size("boxes").alias("n_boxes"), "error")


def _boxes_of(places: DataFrame) -> DataFrame:
    """doc_id and the model's boxes, in order, of the places ``_BOXES``."""
    box = F.struct(*(F.col(a).cast("double").alias(b) for a, b in (("x", "x"), ("y", "y"), ("w", "width"), ("h", "height"))))
    grouped = places.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", box.alias("box")))).alias("all"))
    return grouped.select("doc_id", F.transform("all", lambda b: b["box"]).alias("boxes"))


@_query()
def repaired_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page assembly with all facts: the flagship query."""
    texts = _view(spark, sf_dir, _LINES)
    places = _view(spark, sf_dir, _BOXES)
    replies = texts.join(_boxes_of(places), "doc_id", "left").select("doc_id", "page_num", F.lit(1).alias("page_count"), "text", "boxes", (F.col("doc_id") % 50 == 7).alias("is_blank"))
    sides = (("x", "x0"), ("y", "y0"), (F.col("x") + F.coalesce("w", F.lit(0)), "x1"), (F.col("y") + F.col("h"), "y1"))
    placed = places.filter("doc_id % 3 = 1 AND n <= 2").select("doc_id", F.lit(1).alias("page_num"), F.col("n").alias("rect_no"), *((F.col(c) if isinstance(c, str) else c).cast("double").alias(a) for c, a in sides))
    rects = placed.join(texts.select("doc_id"), "doc_id", "left_semi")
    cells = _view(spark, sf_dir, _CELLS)
    tables = cells.select("doc_id", F.lit(1).alias("page_num"), F.col("n").alias("table_no"), F.lit(0.0).alias("x0"), F.col("n").cast("double").alias("y0"), F.array(F.array("a", "b")).alias("rows"))
    links = texts.select(
        "doc_id", "page_num", F.lit(0).alias("link_no"), F.lit("uri").alias("kind"), F.lit("https://x.example/a").alias("uri"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.element_at(F.split("text", " "), 1).alias("anchor")
    )
    spans = _view(spark, sf_dir, _SPANS)
    return repair.repair_pages(replies, spans, tables, links, _view(spark, sf_dir, _ANNOTS), rects, include_links=True, include_comments=True).select("doc_id", "page_num", "markdown")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_pages(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
