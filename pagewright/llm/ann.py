"""Approximate nearest neighbours by balanced posting lists.

Centroids come from a balanced bisection of a bounded sample and one round of means, which keeps the lists
about equally long. Every vector is written to its nearest cluster's posting list, and a boundary vector also to the
next cluster if that is nearly as near. Centroids stay in memory: a neighbour
graph over them, made once, is searched best first, and a query reads all lists whose
centroid is within a ratio of the nearest one's distance (or of a usual nearest distance, if that is more). The ratio is the
least that finds a wanted share of the neighbours within the sample. Neighbouring lists share a block, and a list longer than a
block is cut into several, so a hot region is many tasks and a query travels once per block. Scores are exact cosines of the
original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.llm.common import stored


@dataclass(frozen=True)
class IndexParameters:
    """Sizes of the index.

    The fit sees at most ``sample_rows`` rows and ``sample_bytes`` bytes; every row is indexed. There is a list for
    each ``list_rows`` rows, but not fewer than ``least_lists`` unless they would hold fewer than 8 rows.
    """

    sample_rows: int = 32_768
    sample_bytes: int = 64 << 20
    list_rows: int = 32
    least_lists: int = 256
    most_lists: int = 4_096
    block_rows: int = 4_096
    query_rows: int = 1_024
    replicas: int = 2
    boundary_ratio: float = 1.02
    wanted: float = 0.93
    degree: int = 16


def usable(embedding: Column) -> Column:
    """Neither null nor zero nor with a null or non-finite component."""
    finite = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.coalesce(embedding.isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _halve(points: np.ndarray, members: np.ndarray, depth: int, out: list[np.ndarray]) -> None:
    """Split members into 2**depth parts of equal size along the axes between two means."""
    if depth == 0 or len(members) < 2:
        out.append(members)
        return
    own = points[members]
    low, high = own[0], own[np.argmin(own @ own[0])]
    for _ in range(6):
        side = own @ (high - low)
        right = side > np.median(side)
        if right.all() or not right.any():
            break
        low, high = own[~right].mean(0), own[right].mean(0)
    order = np.argsort(own @ (high - low), kind="stable")
    half = len(order) // 2
    _halve(points, members[order[:half]], depth - 1, out)
    _halve(points, members[order[half:]], depth - 1, out)


def fit_centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """At most ``lists`` unit centroids (a power of two) of unit vectors; those that follow each other are near."""
    parts: list[np.ndarray] = []
    _halve(sample, np.arange(len(sample)), max(0, lists - 1).bit_length(), parts)
    centroids = _unit(np.stack([sample[p].mean(0) for p in parts if len(p)]))
    nearest = np.concatenate([np.argmax(sample[at : at + 4096] @ centroids.T, axis=1) for at in range(0, len(sample), 4096)])
    sums = np.zeros_like(centroids)
    np.add.at(sums, nearest, sample)
    held = np.bincount(nearest, minlength=len(centroids)) > 0
    centroids[held] = _unit(sums[held])
    return centroids


def assigned(x: np.ndarray, centroids: np.ndarray, replicas: int, boundary_ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroids of unit vectors, nearest first, and which of them each vector is written to."""
    distance = _distances(x, centroids)
    keep = min(replicas, len(centroids))
    near = np.argpartition(distance, keep - 1, axis=1)[:, :keep]
    held = np.take_along_axis(distance, near, 1)
    order = np.lexsort((near, held), axis=1)
    near, held = np.take_along_axis(near, order, 1), np.take_along_axis(held, order, 1)
    close = held <= boundary_ratio * held[:, :1]
    close[:, 0] = True
    return near, close


def pruning(sample: np.ndarray, centroids: np.ndarray, p: IndexParameters, k: int) -> tuple[float, float]:
    """The least ratio that finds the wanted share of the k nearest, and the usual nearest distance, of sampled queries among the sample."""
    asked = np.linspace(0, len(sample) - 1, min(512, len(sample))).astype(np.int64)
    distance = _distances(sample[asked], centroids)
    usual = max(1e-9, float(np.median(distance.min(axis=1))))
    k = min(k, len(sample) - 1)
    if k < 1:
        return 1.0, usual
    score = sample[asked] @ sample.T
    score[np.arange(len(asked)), asked] = -np.inf
    best = np.argpartition(score, -k, axis=1)[:, -k:]
    near, close = (x.reshape(*best.shape, -1) for x in assigned(sample[best.ravel()], centroids, p.replicas, p.boundary_ratio))
    there = np.take_along_axis(np.repeat(distance[:, None, :], k, axis=1), near, axis=2)
    needed = np.where(close, there, np.inf).min(axis=2) / np.maximum(distance.min(axis=1), usual)[:, None]
    return max(1.0, float(np.quantile(needed, p.wanted))), usual


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of unit vectors."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ y.T)))


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


class CentroidGraph:
    """A graph over unit centroids: each is linked with its nearest ones and with those before and after it."""

    def __init__(self, centroids: np.ndarray, degree: int):
        self.centroids = centroids
        n = len(centroids)
        ring = np.stack([(np.arange(n) + 1) % n, (np.arange(n) - 1) % n], axis=1)
        degree = min(degree, n - 1)
        near = [np.argpartition(-(centroids[at : at + 1024] @ centroids.T), degree, axis=1)[:, : degree + 1] for at in range(0, n, 1024)]
        self.links = np.concatenate([np.concatenate(near), ring], axis=1).astype(np.int32)
        self.entry = int(np.argmax(centroids @ centroids.mean(0)))

    def within(self, query: np.ndarray, ratio: float, usual: float, sizes: np.ndarray, least_rows: int) -> np.ndarray:
        """Centroids within ``ratio`` times the nearest one's distance, or ``usual`` if that is more, and more until their ``sizes`` add up to ``least_rows``.

        Best first, in waves: all nodes that could still lead to one within the ratio are expanded together.
        """
        n = len(self.centroids)
        distance = np.full(n, np.inf)
        distance[self.entry] = _distances(query[None], self.centroids[[self.entry]])[0, 0]
        waiting = np.zeros(n, bool)
        waiting[self.entry] = True
        slack = 1.0 + 1.25 * (ratio - 1.0)  # the walk may pass through somewhat farther centroids
        while True:
            open_nodes = np.flatnonzero(waiting)
            wave = open_nodes[distance[open_nodes] <= slack * max(distance.min(), usual)]
            if not len(wave):
                seen = np.isfinite(distance)
                if not len(open_nodes) or sizes[seen].sum() >= least_rows:
                    break
                wave = open_nodes[[np.argmin(distance[open_nodes])]]
            waiting[wave] = False
            fresh = np.unique(self.links[wave])
            fresh = fresh[~np.isfinite(distance[fresh])]
            distance[fresh] = _distances(query[None], self.centroids[fresh])[0]
            waiting[fresh] = True
        order = np.argsort(distance, kind="stable")[: int(np.isfinite(distance).sum())]
        enough = int(np.searchsorted(np.cumsum(sizes[order]), least_rows)) + 1
        return order[: max(enough, int((distance <= ratio * max(distance.min(), usual)).sum()))]


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _scaled(rows: np.ndarray) -> np.ndarray:
    return _unit(rows / np.abs(rows).max(axis=1, keepdims=True)) if len(rows) else rows


def nearest_neighbours(vectors: DataFrame, queries: Column, k: int = 5, parameters: IndexParameters | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine that are found for each query row.

    ``vectors`` has vec_id and embedding; ``queries`` is a predicate on vec_id. Candidates are all rows
    but those of the query's own vec_id. Ties go to the smaller vec_id.

    Edge cases: rows with a null vec_id or an unusable vector (null, zero, null or non-finite
    components) take no part; vectors of different lengths have no cosine, so each length has an index of its own; of rows that
    repeat a vec_id the best counts. With fewer than k candidates all are returned; an empty table gives no row.
    """
    p = parameters or IndexParameters()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    counted = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect()  # one row per length
    found = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    for c in counted:
        found = found.unionByName(_search(rows.filter(F.size("embedding") == c["dim"]), c["dim"], c["n"], queries, k, p))
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def _looked_up(numbers, place: Column) -> Column:
    """A number from a literal that holds one per list or block."""
    return F.get(F.split(F.lit(",".join(str(int(n)) for n in numbers)), ",").cast("array<int>"), place)


def _search(rows: DataFrame, dim: int, total: int, queries: Column, k: int, p: IndexParameters) -> DataFrame:
    """query_id, vec_id, score: candidates of vectors of one length, k of each block that a query meets."""
    spark = rows.sparkSession
    wanted = min(p.sample_rows, max(1, p.sample_bytes // (8 * dim)))
    share = 1 << 30
    sample = rows if total <= wanted else rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(share)) < int(share * wanted / total))
    drawn = sample.select("embedding").limit(2 * wanted).toArrow()  # about ``wanted`` rows; the limit bounds chance
    lists = min(p.most_lists, max(-(-total // p.list_rows), min(p.least_lists, total // 8), 1), max(1, drawn.num_rows))
    sampled = _scaled(_matrix(drawn.column(0))) if drawn.num_rows else np.eye(1, dim)
    centroids = fit_centroids(sampled, lists)
    ratio, usual = pruning(sampled, centroids, p, k)
    shared = spark.sparkContext.broadcast((centroids, CentroidGraph(centroids, p.degree)))  # at most most_lists rows
    del drawn, sample, sampled

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                near, close = assigned(_scaled(_matrix(part.column(1))), shared.value[0], p.replicas, p.boundary_ratio)
                row, order = np.nonzero(close)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(near[row, order].astype(np.int32)), pa.array(order == 0)], ["vec_id", "embedding", "list", "primary"])

    kind = dict(rows.dtypes)["embedding"]
    postings = stored(rows.mapInArrow(assign, f"vec_id long, embedding {kind}, list int, primary boolean"), "postings")
    held, own = (np.zeros(len(centroids), np.int64) for _ in range(2))  # own: vec_ids, each counted in one list
    for r in postings.groupBy("list").count().collect():  # one row per centroid
        held[r["list"]] = r["count"]
    for r in postings.filter("primary").groupBy("vec_id").agg(F.min("list").alias("list")).groupBy("list").count().collect():
        own[r["list"]] = r["count"]
    shelf = shelves(held, p.block_rows)
    on_shelf = np.bincount(shelf, weights=held)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = shared.value[1]
        for batch in batches:
            row, shelf_of, lists_of = [], [], []
            for i, x in enumerate(_scaled(_matrix(batch.column(1)))):
                found = np.sort(graph.within(x, ratio, usual, own, k + 1))
                for part in np.split(found, np.flatnonzero(np.diff(shelf[found])) + 1):
                    row.append(i)
                    shelf_of.append(shelf[part[0]])
                    lists_of.append(part)
            taken = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(shelf_of, pa.int32()), pa.array(lists_of, pa.list_(pa.int32()))], ["vec_id", "embedding", "shelf", "lists"]
            )

    asked = postings.filter(F.col("primary") & queries).select("vec_id", "embedding")
    routed = stored(asked.mapInArrow(route, f"vec_id long, embedding {kind}, shelf int, lists array<int>"), "routed")
    asking = np.zeros(len(on_shelf), np.int64)
    for r in routed.groupBy("shelf").count().collect():
        asking[r["shelf"]] = r["count"]
    blocks = [_looked_up(np.maximum(1, -(-n // size)), F.col("shelf")) for n, size in ((on_shelf, p.block_rows), (asking, p.query_rows))]

    def dealt(frame: DataFrame, column: str, mine: int) -> DataFrame:
        at = F.pmod(F.xxhash64("vec_id"), blocks[mine].cast("long")).cast("int")
        every = F.explode(F.sequence(F.lit(0), blocks[1 - mine] - 1))  # a shelf that no query asks for has one empty block
        names = ("block", "query_block") if mine == 0 else ("query_block", "block")
        return frame.select("vec_id", "embedding", "shelf", column, at.alias(names[0]), every.alias(names[1]))

    left = dealt(postings.withColumn("shelf", _looked_up(shelf, F.col("list"))), "list", 0)
    right = dealt(routed, "lists", 1)

    def compare(_, postings_of: pa.Table, queries_of: pa.Table) -> pa.Table:
        if not postings_of.num_rows or not queries_of.num_rows:
            return _found([], [], [])
        return _found(*_nearest(postings_of, queries_of, k))

    groups = ["shelf", "block", "query_block"]
    return left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInArrow(compare, "query_id long, vec_id long, score double")


def shelves(held: np.ndarray, rows: int) -> np.ndarray:
    """A number for each list: lists that follow each other share one as long as they have at most ``rows`` rows together."""
    out, number, full = np.zeros(len(held), np.int64), 0, 0
    for i, n in enumerate(held.tolist()):
        if full and full + n > rows:
            number, full = number + 1, 0
        out[i] = number
        full += n
    return out


def _nearest(postings_of: pa.Table, queries_of: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of queries and of their k nearest rows in the lists that each query reads, with exact cosines."""
    x, q = _matrix(postings_of["embedding"]), _matrix(queries_of["embedding"])
    xi, qi, of_list = postings_of["vec_id"].to_numpy(), queries_of["vec_id"].to_numpy(), postings_of["list"].to_numpy()
    order = np.lexsort((of_list, xi))
    x, xi, of_list = x[order], xi[order], of_list[order]
    first = np.flatnonzero(np.append(True, xi[1:] != xi[:-1]))  # rows of one vec_id lie together
    xu, qu = _scaled(x), _scaled(q)
    known, place = np.unique(of_list, return_inverse=True)
    members = [np.flatnonzero(place == n) for n in range(len(known))]
    lists = queries_of["lists"].combine_chunks()
    reads = np.zeros((len(q), len(known)), bool)
    asked, by = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(zero_copy_only=False)
    here = np.isin(by, known)
    reads[asked[here], np.searchsorted(known, by[here])] = True
    out_q, out_x, out_s = [], [], []
    for at in range(0, len(q), 256):
        near = np.full((min(256, len(q) - at), len(x)), -np.inf)
        for n, rows in enumerate(members):
            some = np.flatnonzero(reads[at : at + 256, n])
            if len(some):
                near[some[:, None], rows] = qu[at + some] @ xu[rows].T
        near[qi[at : at + 256, None] == xi[None, :]] = -np.inf
        best = near if len(first) == len(xi) else np.maximum.reduceat(near, first, axis=1)  # of each vec_id, so that repeats push nothing out
        last = np.partition(best, max(0, best.shape[1] - k), axis=1)[:, max(0, best.shape[1] - k)]
        r, c = np.nonzero((near >= last[:, None] - 1e-9) & np.isfinite(near))
        out_q.append(r + at)
        out_x.append(c)
    r, c = np.concatenate(out_q), np.concatenate(out_x)
    for at in range(0, len(r), 65_536):
        a, b = q[r[at : at + 65_536]], x[c[at : at + 65_536]]
        out_s.append((a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))))
    score = np.concatenate(out_s) if out_s else np.zeros(0)
    asked, ids = qi[r], xi[c]
    order = np.lexsort((-score, ids, asked))
    asked, ids, score = asked[order], ids[order], score[order]
    once = np.append(True, (asked[1:] != asked[:-1]) | (ids[1:] != ids[:-1]))[: len(score)]  # the best of each pair of ids
    asked, ids, score = asked[once], ids[once], score[once]
    order = np.lexsort((ids, -score, asked))
    asked, ids, score = asked[order], ids[order], score[order]
    kept = np.arange(len(asked)) - np.searchsorted(asked, asked, side="left") < k
    return asked[kept], ids[kept], score[kept]


def _found(queries, ids, scores) -> pa.Table:
    return pa.table({"query_id": pa.array(queries, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.float64())})
