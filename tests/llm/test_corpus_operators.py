"""Packing, neighbours, near duplicates, WARC, decontamination and the pipeline: brute force and round trips."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.llm import ann, minhash, packing, warc
from pagewright.llm import decontamination as D
from pagewright.llm.common import scratch
from pagewright.llm.queries_ann import op2_neighbours
from pagewright.llm.queries_decontamination import op9_decontamination
from pagewright.llm.queries_packing import op1_packing
from pagewright.llm.registry import oracle_sql, queries
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_against_sql(spark, name):
    assert_same(queries()[name](spark, SF), connect(SF).sql(oracle_sql()[name]))


# --- packing ---

def _tokens(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def _check_packing(rows, texts):
    pieces = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(texts)
    for doc_id, own in pieces.items():
        ids, at = _tokens(texts[doc_id]), 0
        for r in sorted(own, key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert r["start"] == at and r["length"] == len(part) > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = total = 0
    groups = collections.Counter()
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == own[0]["sequence_length"] <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
        total += at
        groups[own[0]["step_group"]] += at
    assert padding <= 0.01 * total
    assert max(groups.values()) <= 65_536
    assert all(len({r["sequence_length"] for r in rows if r["step_group"] == g}) == 1 for g in groups)


def test_packing_query(spark):
    _check_packing(op1_packing(spark, SF).collect(), dict(connect(SF).sql("select doc_id, text from documents").fetchall()))


def test_packing_edge_cases(spark):
    texts = {0: None, 1: "", 2: "a<|endoftext|>b", 3: "word " * 30_000, 4: "\x00é\U0001f600", 5: "x"}
    frame = spark.createDataFrame([(i, t, 9) for i, t in texts.items()], "doc_id long, text string, start int")
    _check_packing(packing.pack_documents(frame, public_tokenizers.path("byte_bpe_50k.json")).collect(), texts)
    assert packing.pack_documents(frame.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    twice = packing.pack_documents(frame.union(frame), public_tokenizers.path("byte_bpe_50k.json"))
    assert twice.agg(F.sum("length")).first()[0] == 2 * sum(len(_tokens(t)) for t in texts.values())
    none = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    assert packing.pack_documents(none, public_tokenizers.path("byte_bpe_50k.json")).first()["doc_id"] is None


def test_ids_are_those_of_the_plain_call():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing._encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(7)
    parts = ["<|endoftext|>", "<|endoftext|", " ", "\n", "word", " more", "É", "'s", "12", "  ", "\u3000", "<|"]
    texts = ["some text <|endoftext|> more", "<|endoftext|>" * 3, *("".join(rng.choices(parts, k=12)) for _ in range(500))]
    assert len(encode(texts[0])) == 5
    assert all(encode(t) == plain.encode(t, add_special_tokens=False).ids for t in texts)


@pytest.mark.parametrize("kind", ["smallint", "decimal(9,0)", "date", "string"])
def test_packing_keeps_any_type_of_id(spark, kind):
    value = {"date": "DATE'2020-01-01'"}.get(kind, "7")
    rows = packing.pack_documents(spark.sql(f"SELECT CAST({value} AS {kind}) AS doc_id, 'a b' AS text"), public_tokenizers.path("byte_bpe_50k.json"))
    assert dict(rows.dtypes)["doc_id"] == kind and rows.first()["doc_id"] is not None


def test_gaps_are_filled_from_shorter_tiers():
    packer = packing.Packer((128, 256, 512, 1024), pool=4)
    rng = random.Random(3)
    windows, lengths = [], [rng.randint(1, 3000) for _ in range(300)]
    for i, n in enumerate(lengths):
        windows += packer.add(i, np.arange(n, dtype="<u4").tobytes())
    windows += packer.finish()
    sizes = [sum(map(len, w)) for w in windows]
    assert sum(sizes) == sum(lengths) and all(s & (s - 1) == 0 for s in sizes)
    assert sum(len(w) for w in windows) < 2 * len(lengths) + sum(n // 1024 for n in lengths)


# --- neighbours ---

def _brute_neighbours(vectors, k):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], float)
    out = {}
    for q in ids[ids % 50 == 0]:
        own = x[ids == q][0]
        s = (x * own).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((own * own).sum()))
        keep = ids != q
        order = np.lexsort((ids[keep], -s[keep]))[:k]
        out[int(q)] = [(int(ids[keep][j]), float(s[keep][j])) for j in order]
    return out


def test_neighbours_recall(spark):
    sf = "/root/testdata/sf0.1"
    vectors = connect(sf).sql("select vec_id, embedding from embeddings").fetchall()
    wanted = _brute_neighbours(vectors, 5)
    found = collections.defaultdict(list)
    for r in op2_neighbours(spark, sf).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(found[r["query_id"]]) + 1
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = [len({v for v, _ in found[q]} & {v for v, _ in near}) / len(near) for q, near in wanted.items()]
    assert np.mean(hits) >= 0.9 and all(len(f) == 5 for f in found.values())
    exact = {(q, v): s for q, near in wanted.items() for v, s in near}
    assert all(abs(exact[q, v] - s) < 1e-12 for q, f in found.items() for v, s in f if (q, v) in exact)


@pytest.mark.parametrize("sf", ["sf0.1", "check_s"])
def test_lists_are_many_and_balanced_and_half_of_the_rows_suffice(sf):
    import glob

    import pyarrow.parquet as pq

    path = f"/root/testdata/{sf}/embeddings.parquet"
    table = pq.read_table(path if not glob.glob(path + "/*") else path)
    ids = table["vec_id"].to_numpy()
    x = ann._scaled(ann._matrix(table["embedding"]))
    p = ann.IndexParameters()
    centroids = ann.fit_centroids(x, max(len(x) // p.list_rows, p.least_lists))
    near, close = ann.assigned(x, centroids, p.replicas, p.boundary_ratio)
    sizes = np.bincount(near[close], minlength=len(centroids))
    assert len(centroids) >= 128 and sizes.max() <= 6 * len(x) / len(centroids)
    ratio, usual = ann.pruning(x, centroids, p, 5)
    graph = ann.CentroidGraph(centroids, p.degree)
    hits, read = [], []
    for q in np.flatnonzero(ids % 50 == 0):
        lists = graph.within(x[q], ratio, usual, sizes, 6)
        score = x @ x[q]
        score[q] = -np.inf
        hits.append((np.isin(near[best := np.argsort(-score)[:5]], lists) & close[best]).any(axis=1).mean())
        read.append(sizes[lists].sum() / len(x))
    assert np.mean(hits) >= 0.9 and np.mean(read) < 0.5


def test_vectors_of_several_lengths(spark):
    rows = [(i, [float(i), 1.0]) for i in range(6)] + [(50 * i, [1.0, float(i), 0.5]) for i in range(1, 4)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = collections.Counter(r["query_id"] for r in ann.nearest_neighbours(frame, F.col("vec_id") % 50 == 0).collect())
    assert found == {0: 5, 50: 2, 100: 2, 150: 2}


def test_neighbours_edge_cases(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 0.0]), (50, [0.0, -1e-30]), (None, [1.0, 1.0]), (8, [1.0])]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    found = [tuple(r) for r in ann.nearest_neighbours(frame, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 50, 0.0), (50, 1, 0, 0.0), (50, 2, 1, 0.0), (50, 3, 2, 0.0)]
    assert ann.nearest_neighbours(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.nearest_neighbours(frame.filter("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_repeated_rows_push_no_neighbour_out(spark):
    x = np.random.default_rng(4).normal(size=(300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    asked = F.col("vec_id") % 50 == 0
    one_list = ann.IndexParameters(list_rows=10_000, least_lists=1)
    tiny_lists = ann.IndexParameters(list_rows=4, block_rows=16, wanted=0.0, boundary_ratio=1.0)
    for copies in (1, 2, 5):
        frame = spark.createDataFrame(rows * copies, "vec_id long, embedding array<double>")
        wanted = _brute_neighbours([(i, v) for i, v in enumerate(x)], 5)
        found = collections.defaultdict(list)
        for r in ann.nearest_neighbours(frame, asked, 5, one_list).orderBy("query_id", "rank").collect():
            found[r["query_id"]].append(r["vec_id"])
        assert found == {q: [v for v, _ in near] for q, near in wanted.items()}
        assert ann.nearest_neighbours(frame, asked, 5, tiny_lists).count() == 5 * len(wanted)


def test_neighbours_with_many_lists_and_blocks(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 3000)] + 0.3 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[1000:2000] = x[1000]  # a third of all rows is one vector
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    small = ann.IndexParameters(sample_rows=500, list_rows=100, least_lists=1, block_rows=64, query_rows=8)
    found = collections.defaultdict(list)
    for r in ann.nearest_neighbours(frame, F.col("vec_id") % 50 == 0, 5, small).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    wanted = _brute_neighbours([(i, v) for i, v in enumerate(x)], 5)
    assert np.mean([len({v for v, _ in found[q]} & {v for v, _ in w}) / 5 for q, w in wanted.items()]) >= 0.9
    assert [v for v, _ in found[1000]] == [1001, 1002, 1003, 1004, 1005]


# --- near duplicates ---

def _brute_components(rows, k, percent):
    sets = []
    for _, text in rows:
        words = minhash.words_of(text)
        n = min(k, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def _near_rows():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(120)]
    texts = []
    for _ in range(150):  # a group of near copies, many of them linked with a few others only
        copy = list(base)
        for _ in range(rng.randint(1, 14)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    texts += [texts[0]] * 60 + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    texts += [None, "", "  \n", "one", "ONE", "one two", "One\ttwo ", "a a a a", "a a", "x y z", " ", "É é"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_against_brute_force(spark, k):
    rows = _near_rows()
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, label int")
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame, k).collect())
    assert found == sorted(_brute_components(rows, k, 80))


def test_block_comparison_alone_finds_all_links(spark, monkeypatch):
    monkeypatch.setattr(minhash, "_star_pairs", lambda members, labels, choose, percent: members.select(F.col("cls").alias("a"), F.col("cls").alias("b")).limit(0))
    rows = _near_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame, 2).collect())
    assert found == sorted(_brute_components(rows, 2, 80))


def test_near_duplicate_edge_cases(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other text that is quite different"), (None, "a b c d e f"), (None, "null ids only here"), (None, "null ids only here"), (2, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(frame, 2).collect()), key=repr)
    assert found == sorted([(1, 1, True)] * 3 + [(None, 1, False), (None, None, True), (None, None, True), (2, 2, True)], key=repr)
    assert minhash.near_duplicates(frame.limit(0), 2).count() == 0


def test_circulant_estimate():
    known = minhash._Words()
    a = minhash.shingle_hashes(" ".join(f"w{i}" for i in range(1000)), 1, known)
    b = minhash.shingle_hashes(" ".join(f"w{i}" for i in range(111, 1111)), 1, known)
    same = (minhash.signature(a, 960) == minhash.signature(b, 960)).mean()
    assert abs(same - 889 / 1111) < 0.05


def test_components_of_long_chains(spark):
    node = lambda i: b"%04d" % i
    edges = [(node(i), node(i + 1)) for i in range(60)] + [(node(100), node(i)) for i in range(101, 140)]
    frame = spark.createDataFrame(edges, "a binary, b binary")
    found = {bytes(r["cls"]): bytes(r["label"]) for r in minhash.labels_of(minhash.contracted(frame)).collect()}
    assert found == {node(i): node(0) for i in range(61)} | {node(i): node(100) for i in range(100, 140)}


# --- WARC ---

def test_warc_round_trip(spark):
    pages = [(1, "http://a", "x" * 50_000), (2, "http://b\r\nX: y", "é\r\n\r\nWARC/1.0\r\n" * 3000), (3, None, None), (4, "", ""), (9, "u", "x" * 50_000), (5, "u", "same"), (5, "u", "same"), (5, "v", "x" * 50_000), (None, "n", "same"), (None, "n", "\x00" + "y" * 40_000)]
    frame = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, payload string")
    path = scratch(spark, "test-warc")
    warc.write_archives(frame, path, segment=4096, chunk=1000, per_file=7)
    found = warc.read_archives(spark, path).collect()
    key = lambda p: tuple((x is not None, x) for x in p)
    kinds = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in found), key=key)
    size = lambda t: len((t or "").encode())
    wanted = [(1, 50_000, "response", None), (2, size(pages[1][2]), "response", None), (3, 0, "response", None), (4, 0, "revisit", 3), (9, 50_000, "revisit", 1), (5, 4, "response", None), (5, 4, "response", None), (5, 50_000, "revisit", 1), (None, 4, "response", None), (None, 40_001, "response", None)]
    assert kinds == sorted(wanted, key=key)
    payloads = {r["page_id"]: bytes(r["payload"]) for r in found if r["record_type"] == "response" and r["page_id"] in (1, 2, 3)}
    assert payloads == {i: (t or "").encode() for i, _, t in pages if i in (1, 2, 3)}
    assert all(r["payload_digest"] == warc.base32_sha1((t or "").encode()) for r in found for i, _, t in pages if i == r["page_id"] and i in (1, 2, 3, 4, 9))
    assert warc.archive_and_read(frame.limit(0)).count() == 0


def test_minimum_of_revisits(spark):
    frame = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    assert {r["page_id"]: r["record_type"] for r in warc.archive_and_read(frame, 3).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_broken_archives_are_refused(spark, tmp_path):
    import gzip

    records = warc.build_records("r", 1, "u", b"p" * 5000, warc.base32_sha1(b"p" * 5000), None, 1000, 300)
    for broken in (records[:-1], records[:2] + records[3:], [records[0][:-40]], [*records, records[1]]):
        folder = tmp_path / str(len(list(tmp_path.iterdir())))
        folder.mkdir()
        (folder / "a.txt.gz").write_bytes(gzip.compress(b"".join(broken)))
        with pytest.raises(Exception):
            warc.read_archives(spark, folder.as_uri()).collect()
    again = lambda page, refers, digest, length: warc.build_records("v", page, "u", b"p" * length, digest, refers, 9000, 300, "u")
    whole, good = warc.build_records("r", 1, "u", b"pp", warc.base32_sha1(b"pp"), None, 9000, 300), warc.base32_sha1(b"pp")
    for revisit, fits in ((again(2, 1, good, 2), True), (again(2, 3, good, 2), False), (again(2, 1, warc.base32_sha1(b"q"), 2), False), (again(2, 1, good, 3), False)):
        folder = tmp_path / str(len(list(tmp_path.iterdir())))
        folder.mkdir()
        (folder / "a.txt.gz").write_bytes(gzip.compress(b"".join([warc.info_record(0), *whole, *revisit])))
        if fits:
            rows = {r["page_id"]: r for r in warc.read_archives(spark, folder.as_uri()).collect()}
            assert len(rows) == 2 and rows[2]["refers_to"] == 1 and rows[2]["payload_bytes"] == 2
        else:
            with pytest.raises(Exception):
                warc.read_archives(spark, folder.as_uri()).collect()
    shuffled = tmp_path / "good"
    shuffled.mkdir()
    for i, r in enumerate(reversed(records)):  # any order, any file
        (shuffled / f"{i}.txt.gz").write_bytes(gzip.compress(r))
    assert bytes(warc.read_archives(spark, shuffled.as_uri()).first()["payload"]) == b"p" * 5000
    for bad in (b"zz\r\n", b"5\r\nab", b"3\r\nabcXX0\r\n\r\n", b"-1\r\n", b""):
        with pytest.raises(ValueError):
            warc.unchunked(bad)
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc"


# --- decontamination ---

ITEM = "A train leaves Boston at 9 with 120 kg of apples and reaches Denver after 14 hours. How many kg per hour does Mary carry from Boston to Denver if 120 kg is all she has"


def _leaks(spark, texts, items=(ITEM,)):
    documents = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)], "item_id long, text string, doc_id int")
    return sorted((r["doc_id"], r["item_id"]) for r in D.find_leaks(documents, benchmark).collect())


def test_reparameterised_items_are_found(spark):
    other = ITEM.replace("Boston", "Paris").replace("Denver", "Rome").replace("Mary", "Anna").replace("120", "75").replace("14", "3.5")
    clash = ITEM.replace("Boston at", "Paris at")  # one name has two values
    clash = clash.replace("120 kg is", "7 kg is")
    half = " ".join(ITEM.split()[:8])
    texts = [ITEM, other, "before that. " + other.upper() + " after", "Some words, " + ITEM + " and more", clash, half, None, "", "plain " * 100, "long words here " * 20_000 + ITEM]
    assert _leaks(spark, texts) == [(0, 0), (1, 0), (3, 0), (9, 0)]
    assert _leaks(spark, texts, ()) == [] and _leaks(spark, [], (ITEM,)) == []
    assert _leaks(spark, ["five short words stand here now"], ("Five short words stand here", "too short item", None)) == [(0, 0)]


def test_two_variants_in_one_document(spark):
    other = ITEM.replace("Boston", "Paris").replace("120", "75")
    assert _leaks(spark, [ITEM + ". " + other]) == [(0, 0)]


def test_emptied_vocabulary_gives_the_same_windows(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(("Anna", "9", "kg", "walks", "home.")) + str(rng.randrange(300)) for _ in range(200)) for _ in range(40)]
    usual = D._Vocabulary()
    wanted = [D.Canonical(t, usual).windows(8)[1].tolist() for t in texts]
    monkeypatch.setattr(D._Vocabulary, "most", 50)
    small = D._Vocabulary()
    assert [D.Canonical(t, small).windows(8)[1].tolist() for t in texts] == wanted


def test_decontamination_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    con = connect(sf)
    import re

    flat = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    items = [flat(t) for (t,) in con.sql("select text from benchmark").fetchall()]
    wanted = {d for d, t in con.sql("select doc_id, text from documents").fetchall() if any(i in flat(t) for i in items)}
    found = {r["doc_id"] for r in op9_decontamination(spark, sf).collect()}
    assert wanted and found == wanted


def test_copies_in_any_case_are_found(spark):
    names = "Then Anna Berg met Carl Dorn and Emma Falk near Gent Hafen Ilm Jena Kiel after Lena Moor left Nora Oster there"
    texts = ["so it was, " + t + " and on" for x in (ITEM, names) for t in (x.upper(), x.title(), x.lower())]
    assert _leaks(spark, texts, (ITEM, names)) == [(i, i // 3) for i in range(6)]
    renumbered = ITEM.replace("120", "75").replace("9", "4")  # numbers stay slots in the folded form, also before units in capitals
    assert _leaks(spark, [renumbered.upper(), renumbered.lower(), "A NOTE. " + ITEM.replace("120 kg is", "7 kg is").upper()]) == [(0, 0), (1, 0)]


def test_items_of_numbers_are_found_verbatim(spark):
    sums = "12 and 7 19 25 plus 31 56 40 kg 16 kg 90 less 3 is 87 5 km 8 km 13"
    other = sums.replace("12", "13").replace("25", "26").replace("40", "41").replace("87", "88").replace("56", "57")
    assert _leaks(spark, ["So: " + sums + " as was said", other, "1 2 3 4 5 6 7 8 9 10 " * 50, "X. " + sums.upper()], (sums, ITEM)) == [(0, 0), (3, 0)]


def test_no_whole_item_of_a_larger_table_is_missed(spark):
    import re

    sf = "/root/testdata/sf0.1"
    con = connect(sf)
    flat = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    items = [(i, flat(t)) for i, t in con.sql("select item_id, text from benchmark").fetchall()]
    wanted = {(d, i) for d, t in con.sql("select doc_id, text from documents").fetchall() for flat_t in (flat(t),) for i, x in items if x in flat_t}
    documents, benchmark = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    found = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(documents, benchmark).collect()}
    assert len(wanted) > 200 and not wanted - found


def test_short_items_are_found_by_their_words(spark):
    items = ("Who wrote Hamlet", "42", "", "...", "five short words stand here")
    texts = ["So: WHO wrote hamlet?", "who wrote it", "it is 42", "it is 421", "plain", None, "Five short words, stand here."]
    assert _leaks(spark, texts, items) == [(0, 0), (2, 1), (6, 4)]


def test_bitmap_holds_all_hashes_and_no_other(spark):
    items = spark.createDataFrame([(h,) for h in (0, 1, 7, 8, 32_767, 32_768, (1 << 26) - 1, -1, 1 << 40)], "hash long")
    bits = np.unpackbits(np.frombuffer(D._bitmap(items), np.uint8), bitorder="little")
    assert len(bits) == 1 << 26 and np.flatnonzero(bits).tolist() == [0, 1, 7, 8, 32_767, 32_768, (1 << 26) - 1]


def test_leaks_with_other_types_of_ids(spark):
    documents = spark.createDataFrame([(1, ITEM), (2, "no")], "doc_id short, text string")
    benchmark = spark.createDataFrame([("q", ITEM)], "item_id string, text string")
    assert [tuple(r)[:2] for r in D.find_leaks(documents, benchmark).collect()] == [(1, "q")]


# --- pipeline ---

def test_stages_decide_on_rows_not_on_ids(spark):
    a, b = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight nine"
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (None, a, "x"), (None, ITEM, "x"), (None, ITEM, "x"), (3, "", "x"), (3, "", "x"), (3, None, "x"), (4, b + " ten", "y"), (4, b + " ten", "z"), (4, "short", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label string")
    kept = sorted(((r["doc_id"], r["text"]) for r in minhash.remove_near_duplicates(frame).collect()), key=repr)
    assert kept == sorted([(1, a), (2, b), (None, ITEM), (3, ""), (3, ""), (3, None), (4, "short")], key=repr)
    only = frame.filter("doc_id = 4")
    assert sorted(r["text"] for r in minhash.remove_near_duplicates(only).collect()) == [b + " ten", "short"]
    clean = D.remove_leaks(frame.unionByName(spark.createDataFrame([(1, ITEM.upper(), "x")], frame.schema)), spark.createDataFrame([(0, ITEM)], "item_id long, text string"))
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=repr) == sorted(((d, t) for d, t, _ in rows if t != ITEM), key=repr)
    assert clean.columns == frame.columns


def test_joins_on_hot_keys_are_exact(spark, monkeypatch):
    from pagewright.llm import common

    monkeypatch.setattr(common, "LEAST_HOT", 4)
    monkeypatch.setattr(common, "HOT_KEYS", 16)
    rows = [(k % 40 if k % 3 else 7, k, "t") for k in range(500)]
    left = spark.createDataFrame(rows, "key long, n long, part string")
    counted = left.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    right = spark.range(30).select(F.col("id").alias("key"), (F.col("id") * 2).alias("twice"))
    hot = common.hot_keys(counted, ["key"], 500).collect()
    assert [r["key"] for r in hot] == [7] and hot[0]["parts"] >= 5
    found = sorted((r["key"], r["n"], r["twice"]) for r in common.skew_join(left.drop("part"), right, ["key"], counted, 500).collect())
    assert found == sorted((k, n, 2 * k) for k, n, _ in rows if k < 30)



def test_pipeline_against_brute_force(spark):
    con = connect(SF)
    rows = con.sql("select doc_id, text from documents").fetchall()
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "packing"]
    quality = dict(corpus_pipeline.STAGES)["quality"](spark, documents, SF)
    assert quality.columns == documents.columns
    good = {r["doc_id"] for r in quality.select("doc_id").collect()}
    labels = dict(con.sql("select doc_id, quality from labels").fetchall())
    assert all((d in good) == bool(q) for d, q in labels.items())
    accepted = [(d, t) for d, t in rows if d in good]
    kept = {d for d, _, c in _brute_components(accepted, 5, 80) if d == c}
    dirty = {r["doc_id"] for r in D.find_leaks(documents, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    final = {d: t for d, t in accepted if d in kept and d not in dirty}
    _check_packing(corpus_pipeline.run(spark, SF).collect(), final)


def test_pipeline_on_empty_and_null_rows(spark, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "text without an id", "en", "s", 3), (3, "a text", "en", "s", 5)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert None in found  # without labels no model rejects, but a score of 0.5 reaches the threshold of 0.5
    empty = tmp_path / "empty"
    for name in ("labels", "benchmark", "documents"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(empty / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
