"""Helpers that several operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most this many bytes may be broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the data folder, pruned to the columns that a query needs."""
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Where ``spark.checkpoint.dir`` is unset on a single machine (tests), a temporary
    folder is made and removed at exit; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="pagewright-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{named}")
        return f"file://{named}"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame, written once to the shared folder and read back.

    Cuts the lineage, so that a lost executor costs no recomputation, and keeps
    the partition files columnar: later reads touch only the columns they need.
    """
    spark = frame.sparkSession
    path = scratch(spark, name)
    frame.write.parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out.scratch_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(*frames: DataFrame | None) -> None:
    """Delete what ``stored`` wrote for frames that nothing reads any more; others are left alone."""
    for frame in frames:
        path = getattr(frame, "scratch_path", None)
        if path:
            remove(frame.sparkSession, path)


def measured_bytes(frame: DataFrame) -> int:
    """About how much memory the rows take: 16 bytes a field, and what strings, binaries and nested values hold."""
    fixed = 16 * len(frame.columns) + 16
    held = F.lit(0).cast("long")
    for name, kind in frame.dtypes:
        if kind in ("string", "binary"):
            held += F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
        elif kind.startswith(("array", "struct", "map")):
            held += 4 * F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{name}`")))), F.lit(0))
    return frame.agg(F.coalesce(F.sum(held + fixed), F.lit(0))).first()[0]


def small_side(frame: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a side for broadcast if its measured size fits the limit, else leave the join to shuffles."""
    return F.broadcast(frame) if measured_bytes(frame) <= limit else frame.hint("shuffle_merge")


#: A key with more than this share of the rows is hot, so there are at most so many hot keys; a few rows are never hot.
HOT_KEYS, LEAST_HOT = 1024, 64


def hot_keys(counted: DataFrame, keys: Sequence[str], total: int) -> DataFrame:
    """Keys that hold more than 1 / ``HOT_KEYS`` of ``total`` rows, and into how many parts they are dealt; at most ``HOT_KEYS`` rows.

    ``counted`` has one row per key, with its number of rows in ``rows``.
    """
    part = max(LEAST_HOT, total // HOT_KEYS)
    return counted.filter(F.col("rows") > part).select(*keys, F.ceil(F.col("rows") / part).cast("int").alias("parts"))


def skew_join(left: DataFrame, right: DataFrame, keys: Sequence[str], counted: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """An inner or left join in which no task gets all rows of a hot key of the left side.

    Rows of a hot key are dealt to parts by their own values, so a repeated task deals them alike, and the right side's
    rows of that key are repeated for each part: at most ``2 * HOT_KEYS`` parts in all.
    """
    keys = list(keys)
    hot = F.broadcast(hot_keys(counted, keys, total))
    parts = F.coalesce("parts", F.lit(1))
    dealt = left.join(hot, keys, "left").withColumn("part", F.pmod(F.xxhash64(*left.columns), parts.cast("long")).cast("int")).drop("parts")
    again = right.join(hot, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return dealt.join(again, [*keys, "part"], how).drop("part")


def told_apart(documents: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """The documents that have (``left_semi``) or lack (``left_anti``) their doc_id and text in ``rows`` (doc_id, text_hash).

    What decides on a row is its text, so rows that repeat a doc_id are told apart by a 64-bit hash of theirs; ids may be null.
    Both sides are named, as documents may have columns of any names.
    """
    marked = small_side(rows.select("doc_id", "text_hash")).alias("_marked")
    same = F.col("_documents.doc_id").eqNullSafe(F.col("_marked.doc_id")) & (text_hash(F.col("_documents.text")) == F.col("_marked.text_hash"))
    return documents.alias("_documents").join(marked, same, how)


def without(documents: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows but those whose doc_id and text are in ``gone`` (doc_id, text_hash); all columns, null ids and texts included."""
    return told_apart(documents, gone, "left_anti")


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def text_batches(batches: Iterator, max_chars: int = 4 << 20) -> Iterator:
    """Arrow batches, re-cut so that no slice holds many more than ``max_chars`` bytes of data.

    At the end of a task what Arrow keeps for later is given back, as a worker goes on to other operators.
    """
    for batch in batches:
        size = batch.nbytes
        if size <= max_chars or batch.num_rows <= 1:
            yield batch
            continue
        step = max(1, batch.num_rows * max_chars // size)
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
    pa.default_memory_pool().release_unused()
