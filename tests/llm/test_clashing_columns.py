"""Extra columns under the operators' own working names change no result, and stay where rows pass through."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pagewright.llm import ann, chat, decontamination, html, licenses, minhash, packing, quality, urls, warc

#: Names that the operators give to columns of their own.
NAMES = (
    "text_hash hash _hash _id _text_hash _gone_id _gone_hash _gone_count digest n_shingles bands cls label first rows n u v a b m key part parts group own i j left right "
    "shingles wanted copies least stands gone seen found score predicted held_out fold stats statistics features item_id start length of of_folded form slots coverage items "
    "host path rule verdict grams weight bucket tier tokens token_ids sequence_id offset ids_crc32 doc_tokens vec query query_id rank list centroid distance norm vector dim "
    "turns segments formatted state role_ids conv n_turns spans labels words n_words payload payload_digest payload_bytes record_type refers_to origin segment total n_chars value id e x y"
).split()
PROSE = "Quiet rivers carry old songs past the mill, and the miller counts each one by lamp light until morning. "
ITEM = "A baker sells 24 loaves each day and 36 on market days. How many loaves does the baker sell in a week with two market days?"
DOCUMENTS = [(1, PROSE * 3), (2, PROSE * 3), (2, PROSE * 3), (2, ITEM), (None, "MIT License text here"), (4, ""), (5, None), (6, "Short one")]


def _crowded(frame):
    """The frame with a column of every working name that it has not."""
    return frame.select("*", *(F.lit("x").alias(n) for n in NAMES if n not in frame.columns))


def _rows(frame, columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


def _documents(spark):
    return spark.createDataFrame(DOCUMENTS, "doc_id long, text string")


def _benchmark(spark):
    return spark.createDataFrame([(7, ITEM), (8, None)], "item_id long, text string")


def _labels(spark):
    return spark.createDataFrame([(n, n % 2) for n in range(12)], "doc_id long, quality int")


@pytest.mark.parametrize(
    "operator",
    [
        lambda s, d: packing.pack_documents(d, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens"),
        lambda s, d: quality.classify(d, _labels(s)),
        lambda s, d: licenses.scan_licenses(d),
        lambda s, d: minhash.near_duplicates(d, k=2),
        lambda s, d: decontamination.find_leaks(d, _benchmark(s)),
    ],
    ids=["packing", "quality", "licenses", "near_duplicates", "leaks"],
)
def test_documents(spark, operator):
    plain = operator(spark, _documents(spark))
    assert _rows(operator(spark, _crowded(_documents(spark))), plain.columns) == _rows(plain, plain.columns)


@pytest.mark.parametrize(
    "stage",
    [
        lambda s, d: quality.accepted(d, _crowded(_labels(s))),
        lambda s, d: minhash.remove_near_duplicates(d),
        lambda s, d: decontamination.remove_leaks(d, _crowded(_benchmark(s))),
    ],
    ids=["accepted", "near_duplicates", "leaks"],
)
def test_rows_that_pass_keep_all_columns(spark, stage):
    crowded = _crowded(_documents(spark))
    kept = stage(spark, crowded)
    assert kept.columns == crowded.columns
    assert _rows(kept, ["doc_id", "text"]) == _rows(stage(spark, _documents(spark)), ["doc_id", "text"])
    assert kept.filter("label <> 'x' OR _id <> 'x' OR _hash <> 'x' OR _text_hash <> 'x' OR text_hash <> 'x'").isEmpty()


def test_vectors(spark):
    rows = spark.createDataFrame([(n, [float(n % 7 + 1), float(n % 3), 1.0]) for n in range(120)], "vec_id long, embedding array<double>")
    find = lambda v: ann.nearest_neighbours(v, F.col("vec_id") % 50 == 0)
    columns = ["query_id", "rank", "vec_id", "score"]
    assert _rows(find(_crowded(rows)), columns) == _rows(find(rows), columns)


@pytest.mark.parametrize(
    ("operator", "columns"),
    [
        (urls.judge_urls, ["page_id", "host", "path", "rule", "verdict"]),
        (html.extract_main_text, ["page_id", "url", "text", "n_chars"]),
        (warc.archive_and_read, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]),
    ],
    ids=["urls", "html", "warc"],
)
def test_pages(spark, operator, columns):
    page = f"<html><body><div><p>{PROSE}</p><p>{PROSE}</p></div></body></html>"
    rows = [(1, "https://a.org/x", page), (2, "http://b.de/y?z", page), (3, None, None), (3, "", ""), (4, "http://c.example.org/es/1", "<p>x</p>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert _rows(operator(_crowded(frame)), columns) == _rows(operator(frame), columns)


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "assistant", None), (3, None, None, "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plain = chat.format_conversations(frame)
    assert _rows(chat.format_conversations(_crowded(frame)), plain.columns) == _rows(plain, plain.columns)
