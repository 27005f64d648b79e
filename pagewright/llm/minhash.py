"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard verification.

Circulant MinHash needs two permutations only: the first scatters shingles over a
ring, the second gives ring positions their ranks, and shifting it by k positions gives the k-th
coordinate. All coordinates of a shingle are then one contiguous run of ranks.

1. One Arrow pass reduces every document to its shingle set's size and 128-bit digest, and to
   its band keys. Documents of one digest are one class; only classes go on, under numbers of 64 bits.
2. Classes that share a band key are candidates. Buckets are never expanded into pairs:
   each is linked to one member (round 1: to the one that is found in most buckets, round 2: to the
   smallest), links are verified on full sets, and components are contracted as far as one step goes. In round 3 the buckets
   whose members are still in different components are compared in blocks of bounded size: all members outside a
   bucket's largest component meet all its members inside a task, and only links come out. So
   no link between candidates is lost.
3. Components come from alternating large-star and small-star steps; edges and labels stay distributed.

Buckets, groups, hubs, components and classes may hold a third of all rows: joins on them deal a hot key to many parts.

With b bands of r coordinates a link at similarity s is missed with probability
(1 - s^r)^b: 5e-6 at 0.8 for 40 bands of 6, less above.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import release, skew_join, small_side, stored, text_batches, text_hash, told_apart, without

_RING_BITS = 20
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FIRST = np.uint64(0xD6E8FEB86659FD93)  # odd: a permutation of 64-bit numbers


class _Words(dict):
    """Word -> 64-bit hash, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; bytes' lower() and split() know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(text: str | None, k: int, known: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of fewer words the sequence is the one shingle."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(k, len(words))
    n = len(words) - k + 1
    total = np.full(n, k * int(_STEP) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(k):
        total = (total ^ hashes[i : i + n]) * _MIX
        total ^= total >> np.uint64(32)
    return np.unique(total)


@lru_cache(maxsize=2)
def _ranks(coordinates: int) -> np.ndarray:
    """Row p: the ranks of position p under all shifts; a view of one permutation of the ring."""
    ring = np.random.Generator(np.random.PCG64(20)).permutation(1 << _RING_BITS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate((ring, ring[:coordinates])), coordinates)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """All coordinates of a set of at least one shingle."""
    ranks = _ranks(coordinates)
    places = ((shingles * _FIRST) >> np.uint64(64 - _RING_BITS)).astype(np.int64)
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(places), 1024):
        np.minimum(least, ranks[places[at : at + 1024]].min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band; keys of different bands don't meet."""
    grid = least.reshape(bands, rows).astype(np.uint64)
    keys = np.arange(1, bands + 1, dtype=np.uint64) * _STEP
    for r in range(rows):
        keys = (keys ^ grid[:, r]) * _MIX
        keys ^= keys >> np.uint64(32)
    return keys


def sketch(documents: DataFrame, k: int, bands: int = 40, rows: int = 6) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest of the shingle set (null if empty) and bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in text_batches(batches):
            sizes, digests, keys = [], [], []
            for text in batch.column(2):
                found = shingle_hashes(text.as_py(), k, known)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                keys.append(band_keys(signature(found, bands * rows), bands, rows).view(np.int64) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n_shingles", "digest", "bands"],
            )

    frame = documents.select("doc_id", text_hash(F.col("text")).alias("text_hash"), "text")
    return frame.mapInArrow(run, f"doc_id {dict(frame.dtypes)['doc_id']}, text_hash long, n_shingles long, digest binary, bands array<long>")


def shingle_sets(documents: DataFrame, k: int) -> DataFrame:
    """digest and shingles of every row that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in text_batches(batches, 2 << 20):
            found = [s for t in batch.column(0) if len(s := shingle_hashes(t.as_py(), k, known))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))],
                ["digest", "shingles"],
            )

    return documents.select("text").mapInArrow(run, "digest binary, shingles array<long>")


def contracted(edges: DataFrame, full: bool = True) -> DataFrame:
    """Stored edges (a, b), a > b, of the same components as the given ones, contracted by large-star and small-star steps.

    Contracted fully, every component is a star: each node but the smallest has one edge, to the smallest.
    Otherwise one pair of steps is made, which is enough for stars. Every step's edges are written, so a lost
    executor costs one step. Neighbourhoods are reduced to their minimum by partial aggregation, never collected.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("rows")).select("u", F.least("least", "u").alias("m"), "rows")
        large = skew_join(both.filter("v > u"), least.select("u", "m"), ["u"], least, 2 * now.count())
        large = stored(large.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large-star")
        release(now)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("rows"))
        small = skew_join(large, least.select("u", "m"), ["u"], least, large.count())
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = stored(small.select("e.*").filter("u <> v").distinct(), "small-star")
        release(large)
        if not full or _are_stars(now):
            out = now.select(F.col("u").alias("a"), F.col("v").alias("b"))
            out.scratch_path = now.scratch_path
            return out


def _are_stars(edges: DataFrame) -> bool:
    """Whether no node has two edges down, or edges both down and up."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 OR down = 1 AND up = 1").isEmpty()


def labels_of(edges: DataFrame) -> DataFrame:
    """(cls, label) of every node of contracted edges: nodes of one label are in one component."""
    nodes = edges.select(F.col("a").alias("cls"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("cls"), F.col("b").alias("label")))
    return nodes.groupBy("cls").agg(F.min("label").alias("label"))


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80, bands: int = 40, rows: int = 6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of
    k-word shingles. component_id is the smallest doc_id that links reach; kept marks that one.

    Edge cases: null, empty and blank texts have no shingles, are linked with nothing and kept;
    fewer than k words are one shingle. Rows with equal sets are one class, whatever their number.
    Rows that repeat a doc_id are handled by their own texts. A null doc_id never names a component
    with other ids; a component of null ids only has a null component_id and is kept. Other columns are
    ignored; an empty table gives no row.
    """
    out = _resolved(documents, k, percent, bands, rows).select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("component_id").isNull() | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _resolved(documents: DataFrame, k: int, percent: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, n_shingles and first of every row.

    ``first`` is the row that stands for the component: (null id last, doc_id, text_hash), the smallest. A row without shingles stands for itself.
    """
    sketches = stored(sketch(documents, k, bands, rows), "sketches")
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    grouped = sketches.filter("digest IS NOT NULL").groupBy("digest")
    grouped = grouped.agg(F.min(own).alias("first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("rows"))
    classes = stored(grouped.withColumn("cls", F.monotonically_increasing_id()), "classes")  # numbered as they are written, so the numbers stay
    edges = _linked(documents, classes, k, percent)
    labels = labels_of(edges)
    named = classes.select("digest", "cls", "first", "rows").join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    least = named.groupBy("label").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("rows"))
    named = skew_join(named.select("digest", "label", F.col("rows").alias("copies")), least.select("label", "least"), ["label"], least, classes.count())
    named = stored(named.select("digest", F.col("least").alias("first"), F.col("copies").alias("rows")), "named")
    alone = sketches.filter("digest IS NULL").select("doc_id", "text_hash", "n_shingles", own.alias("first"))
    some = sketches.filter("digest IS NOT NULL").select("doc_id", "text_hash", "n_shingles", "digest")
    out = skew_join(some, named.select("digest", "first"), ["digest"], named, sketches.count()).drop("digest")
    release(classes, edges)
    return alone.unionByName(out)


def _linked(documents: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Fully contracted edges (a, b) between classes of one component."""
    spark = documents.sparkSession
    keyed = classes.select("cls", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    bare = stored(skew_join(keyed, shared.select("key"), ["key"], shared, 40 * classes.count()), "members")
    facts = bare.groupBy("cls").agg(F.count(F.lit(1)).alias("buckets"))
    candidates = stored(classes.select("cls", "digest", F.col("first.doc_id").alias("doc_id"), "n").join(facts, "cls"), "candidates")
    members = stored(bare.join(candidates.select("cls", "n", "buckets"), "cls"), "bucket-members")
    sets = _candidate_sets(documents, candidates, k)
    release(bare, candidates)
    edges = spark.createDataFrame([], "a long, b long")
    for choose in ("medoid", "smallest", "blocks"):
        labels = labels_of(edges)
        if choose == "blocks":
            pairs = stored(_open_members(members, labels), "open-members")
            found = _block_links(pairs, sets, percent)
        else:
            pairs = stored(_star_pairs(members, labels, choose, percent), "pairs")
            found = _verified(pairs, sets, percent)
        links = stored(found, "links")
        before, edges = edges, contracted(edges.unionByName(links), full=choose == "blocks")
        release(pairs, links, before)
    release(members, sets)
    return edges


def _candidate_sets(documents: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """cls and full shingle set of the candidate classes, from one document of each."""
    wanted = small_side(candidates.select(F.col("doc_id").alias("wanted")).distinct())
    texts = documents.select("doc_id", "text")
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
    once = shingle_sets(texts, k).dropDuplicates(["digest"])
    return stored(once.join(candidates.select("cls", "digest"), "digest").select("cls", "shingles"), "sets")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))


def _centres(rows: DataFrame) -> DataFrame:
    """Of each bucket that holds more than one component: the member found in most buckets, the smallest, and its number of rows."""
    split = rows.groupBy("key").agg(
        F.min("label").alias("low"),
        F.max("label").alias("high"),
        F.max(F.struct("buckets", "cls", "n", "label")).alias("medoid"),
        F.min(F.struct("cls", "n", "label")).alias("smallest"),
        F.count(F.lit(1)).alias("rows"),
    )
    return split.filter("low < high").select("key", "medoid", "smallest", "rows")


def _star_pairs(members: DataFrame, labels: DataFrame, choose: str, percent: int) -> DataFrame:
    """Each member (a) with its bucket's centre (b), if in different components and if their sizes allow the similarity."""
    rows = _labelled(members, labels)
    centres = _centres(rows)
    chosen = centres.select("key", *(F.col(f"{choose}.{c}").alias(f"{c}_2") for c in ("cls", "n", "label")))
    joined = skew_join(rows.select("key", "cls", "n", "label"), chosen, ["key"], centres, members.count())
    fits = (F.col("label") != F.col("label_2")) & (100 * F.least("n", "n_2") >= percent * F.greatest("n", "n_2"))
    return joined.filter(fits).select(F.col("cls").alias("a"), F.col("cls_2").alias("b")).distinct()


def _open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """group, cls, label, n of all members of buckets that hold more than one component.

    Buckets with the same medoid are one group: the buckets of a set of similar classes mostly share theirs, so a
    class is in few groups, not in one for each band.
    """
    rows = _labelled(members, labels)
    centres = _centres(rows)
    joined = skew_join(rows.select("key", "cls", "label", "n"), centres.select("key", F.col("medoid.cls").alias("group")), ["key"], centres, members.count())
    return joined.select("group", "cls", "label", "n").distinct()


def _block_links(rows: DataFrame, sets: DataFrame, percent: int, block: int = 128, most_shingles: int = 500_000) -> DataFrame:
    """Links between members of a group in different components, at least one for each two components linked there.

    Members outside the group's largest component meet all members, block by block and each two blocks once. A block holds about
    ``block`` members, fewer if their sets have more than ``most_shingles`` together, either of the largest component or of the others.
    """
    sizes = rows.groupBy("group", "label").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingled"))
    sizes = sizes.groupBy("group").agg(
        F.max(F.struct("members", "label", "shingled")).alias("largest"),
        F.sum("members").alias("members"),
        F.sum("shingled").alias("shingled"),
    )
    counted = sizes.select("group", F.col("members").alias("rows"))
    cut = lambda members, shingled: F.greatest(F.ceil(members / block), F.ceil(shingled / most_shingles)).cast("int")
    sizes = sizes.select(
        "group",
        F.col("largest.label").alias("major"),
        cut(F.col("members") - F.col("largest.members"), F.col("shingled") - F.col("largest.shingled")).alias("minor_blocks"),
        cut(F.col("largest.members"), F.col("largest.shingled")).alias("major_blocks"),
    ).filter("minor_blocks > 0")
    held = skew_join(rows.drop("n"), sizes, ["group"], counted, rows.count()).join(sets, "cls")
    among = lambda n: F.pmod(F.xxhash64("cls"), n.cast("long")).cast("int")
    minor = F.col("label") != F.col("major")
    own = F.when(minor, among(F.col("minor_blocks"))).otherwise(F.col("minor_blocks") + among(F.col("major_blocks")))
    held = held.withColumn("own", own)
    left = held.filter(minor).select(
        "group", F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.col("minor_blocks") + F.col("major_blocks") - 1)).alias("j"), "cls", "label", "shingles"
    )
    again = [F.col(c).alias(c) for c in ("group", "cls", "label", "shingles")]  # new columns, else the two sides can't be told apart
    right = held.select(*again, F.explode(F.sequence(F.lit(0), F.least("own", F.col("minor_blocks") - 1))).alias("i"), F.col("own").alias("j"))
    keys = ["group", "i", "j"]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        pairs = _compare(left, right, percent) if left.num_rows and right.num_rows else []
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "a long, b long").distinct()


def _compare(left: pa.Table, right: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Linked pairs across labels, one for each left row and right label; sizes of intersections are exact."""
    column = right["shingles"].combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    known, places = np.unique(values, return_inverse=True)
    sizes = np.diff(ends, prepend=0)
    right_cls, right_label = right["cls"].to_pylist(), right["label"].to_pylist()
    flags = np.zeros(len(known), np.uint8)
    out = []
    for cls, label, own in zip(left["cls"].to_pylist(), left["label"].to_pylist(), left["shingles"]):
        own = own.values.to_numpy(zero_copy_only=False)
        at = np.searchsorted(known, own)
        at = at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == own)]
        flags[at] = 1
        both = np.add.reduceat(flags[places], ends - sizes, dtype=np.int64)  # no set is empty
        flags[at] = 0
        met = set()
        for k in np.flatnonzero(100 * both >= percent * (len(own) + sizes - both)).tolist():
            if right_label[k] != label and right_label[k] not in met:
                met.add(right_label[k])
                out.append((min(cls, right_cls[k]), max(cls, right_cls[k])))
    return out


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a member, b centre) whose full sets are similar enough."""
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y"))
    centres = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("rows"))
    near = skew_join(pairs, right, ["b"], centres, pairs.count())
    both = F.size(F.array_intersect("x", "y"))
    return near.join(left, "a").filter(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def remove_near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, with all columns.

    The row of the smallest doc_id stays (null ids come last; of one doc_id the text with the smallest hash), and of rows that repeat
    both doc_id and text any one. So rows (1, A), (2, A), (2, B) give (1, A) and (2, B).

    Edge cases: rows without words (null, empty, blank texts) all stay; an empty table gives none; long texts are read
    whole; columns of any names pass through.
    """
    rows = _resolved(documents, k, percent, 40, 6).filter("n_shingles > 0")
    stands = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    keys = rows.select("doc_id", "text_hash", stands.alias("stands")).groupBy("doc_id", "text_hash").agg(F.first("stands").alias("stands"), F.count(F.lit(1)).alias("n"))
    gone = stored(keys.filter("NOT stands OR n > 1"), "near-duplicates")
    out = without(documents, gone)
    repeated = gone.filter("stands").select("doc_id", "text_hash")
    if repeated.isEmpty():
        return out
    once = told_apart(documents, repeated, "left_semi").dropDuplicates(["doc_id", "text"])
    return out.unionByName(once)
